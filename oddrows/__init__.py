"""oddrows: find, explain and benchmark odd rows in tables, on Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task code travels by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
