"""Marquee: a Spark-native engine for cultural-event knowledge."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a cluster
# needs no copy of it on the workers' paths.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
