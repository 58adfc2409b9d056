"""Customer-support and product-catalogue analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers travel by value, so executors do not need
# this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
