"""Behavioural spending analytics on Spark."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the workers by value: executors need no copy of the repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
