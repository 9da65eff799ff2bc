"""The pipeline's stages, each on its own input, against plain Python."""

import corpus_pipeline
import pytest

from tastegrid.session import stage
from test_dedup import simhash_brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(SF + "/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns_and_rows(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[0].columns == stages[-1].columns[:5]


def test_near_copies(stages):
    """One document of each group of fingerprints linked at 4 bits, by a plain search over all pairs."""
    before, after = texts(stages[1]), texts(stages[2])
    prints = {d: simhash_brute(t) for d, t in sorted(before.items())}
    group = {d: d for d in prints}

    def find(d):
        while group[d] != d:
            d = group[d]
        return d
    for a, x in prints.items():
        for b, y in prints.items():
            if a < b and (x ^ y).bit_count() <= 4:
                p, q = sorted((find(a), find(b)))
                group[q] = p
    assert set(after) == {d for d in prints if find(d) == d} and len(after) < len(before)


def test_repeats_cut_but_first_kept(stages):
    before, after = texts(stages[2]), texts(stages[3])
    assert set(before) == set(after)
    seen = set()
    for d in sorted(before):
        raw = before[d].encode()
        windows = {raw[k:k + 200] for k in range(len(raw) - 199)}
        if not windows & seen and len(windows) == max(len(raw) - 199, 0):
            assert after[d] == before[d]
        seen |= windows
    own = [{b[k:k + 210] for k in range(len(b) - 209)} for b in (t.encode() for t in after.values())]
    total = [w for x in own for w in x]
    assert len(total) == len(set(total))


def test_leaks_go(spark, stages):
    bench = [r.text.lower().split() for r in spark.read.parquet(SF + "/benchmark.parquet").collect()]
    after = [" ".join(t.lower().split()) for t in texts(stages[4]).values()]
    assert not [b for b in bench if any(" ".join(b) in t for t in after)]
    assert stages[4].count() >= 0.9 * stages[3].count()


def test_tokens_decode(stages):
    assert stages[5].count() == stages[4].count() and stages[5].filter("not decodes").count() == 0


def test_run_gives_the_same_rows(spark, stages):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "text", "ids").collect()
    want = stages[5].select("doc_id", "text", "ids").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_chain_on_odd_and_empty_tables(spark, odd_docs, no_docs, odd_rows):
    for docs in (odd_docs, no_docs):
        columns = docs.columns
        for name, step in corpus_pipeline.STAGES:
            docs = stage(step(spark, docs, SF))
            assert [c for c in columns if c not in docs.columns] == [], name
        rows = docs.select("doc_id", "text", "n_tokens", "decodes").collect()
        assert len(rows) <= len(odd_rows) and all(r.decodes for r in rows)
        assert docs.columns[-3:] == ["ids", "n_tokens", "decodes"]
    assert rows == []
