"""Spark-native queries over oriented point clouds, meshes and analytic shapes."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
