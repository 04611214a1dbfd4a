"""Corvane: evaluation, data-quality and corpus analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that a job
# needs no installation of the package there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
