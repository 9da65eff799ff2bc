"""Staged tables go when a job says that its results are written."""

import os
import re

from tastegrid.session import CLEANUP, drop_stage, drop_stages, shared_dir, stage


def test_drop_stages_leaves_nothing(spark):
    drop_stages(spark)
    before = set(os.listdir(shared_dir(spark)))
    df = stage(spark.range(10), "mine")
    assert df.count() == 10 and set(os.listdir(shared_dir(spark))) - before
    assert drop_stages(spark) == 1
    assert set(os.listdir(shared_dir(spark))) <= before


def test_staging_keeps_no_shuffle_files_and_one_table_can_go(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {m[1] for k in range(files.size()) if (m := re.match(r"shuffle_(\d+)_", files.apply(k).getName()))}
    before, conf = shuffles(), spark.conf.get(CLEANUP, None)
    left, right = (stage(spark.range(1000).repartition(7).groupBy("id").count(), n) for n in ("left", "right"))
    assert not shuffles() - before and spark.conf.get(CLEANUP, None) == conf
    drop_stage(left)
    names = os.listdir(shared_dir(spark))
    assert os.path.basename(right._staged) in names and os.path.basename(left._staged) not in names
    assert right.count() == 1000
