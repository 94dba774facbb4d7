"""Spark-native analysis of two-dimensional text layouts and their stability."""

import sys

from pyspark import cloudpickle

# task functions travel with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
