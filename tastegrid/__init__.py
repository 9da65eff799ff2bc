"""tastegrid: rating-table analytics and recommendation jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task code travels with the job, so executors need no copy of this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
