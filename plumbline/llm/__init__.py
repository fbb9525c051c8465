"""Training-data operators on Spark DataFrames. Nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Workers get this package's functions with the tasks, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
