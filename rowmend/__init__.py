"""Record matching and data cleaning on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
