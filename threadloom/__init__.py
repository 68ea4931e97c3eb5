"""threadloom: question-and-answer corpora on Spark.

Every operator takes and returns DataFrames (or Columns); Spark SQL, Spark ML and Structured
Streaming do the work.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python tasks travel with the job, so executors need no copy of
# this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
