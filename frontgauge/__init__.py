"""Judge surrogate models used in multi-objective optimisation, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The Python helpers below run inside tasks. Shipping them by value means the
# executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
