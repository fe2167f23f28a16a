"""Relationship and communication analytics as composable Spark operators."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so that a cluster needs no copy of this package on its nodes.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
