"""A code-graph and tabular query engine on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel whole, so workers need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
