"""Spark-native analytics over immutable, typed, versioned records."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package that run on executors travel by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
