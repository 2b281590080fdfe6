"""Candidate-screening analytics on Spark: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

# Functions go to the workers by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
