"""City-model analytics on Spark DataFrames."""

from pyspark import cloudpickle

from urbanframe.functions import kernels

# Ship the batch functions by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(kernels)
