"""duosig: comparing two conditions of replicated, read-level signal data on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the job, so that executors
# need no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
