"""wanderframe: mobility analytics and corpus processing on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that no path has to be set there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
