"""Operators of a training-data pipeline; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# functions of this package go to the executors by value: they need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
