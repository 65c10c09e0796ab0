"""memlake: long-term-memory analytics as PySpark DataFrame and streaming jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel with their code, so executors need no
# copy of this package and no particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
