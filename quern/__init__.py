"""Quern: evidence retrieval, knowledge-graph and verdict analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions go to the Python workers by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
