"""Emergent-pattern analytics over dated text records, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that they run where
# the package is not installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
