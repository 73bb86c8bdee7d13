"""Tessera: interval, sequence, taxonomy and association analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Kernels and data sources travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
