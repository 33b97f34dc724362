"""Spark-native profiling, slicing and rendering of dense arrays and numeric columns."""

import sys

from pyspark import cloudpickle

# data sources and Arrow functions reach executors by value: they need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
