"""Search, link and text analytics over DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions travel to the executors with their code, so the package needn't be installed there.
register_pickle_by_value(sys.modules[__name__])
