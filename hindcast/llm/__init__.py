"""Operators of a training-data pipeline."""

import sys

from pyspark import cloudpickle

# Python workers get these functions by value, so an executor needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
