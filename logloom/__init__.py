"""Journal analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks: executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
