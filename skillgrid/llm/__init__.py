"""Operators for preparing large text corpora. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors by value: tasks need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
