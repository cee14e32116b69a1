"""Block-structured byte relations, scans and entropy codes as Spark plans."""

import sys

from pyspark import cloudpickle

# Python workers get these functions with the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
