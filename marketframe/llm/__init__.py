"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value: they need not have the package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
