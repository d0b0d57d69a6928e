"""weftline: declarative batch analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code, so executors need no copy of the library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
