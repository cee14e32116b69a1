"""Operators that prepare text corpora for training language models.

Nothing outside this folder imports it; ``queries.py`` registers its queries.
"""

import sys

from pyspark import cloudpickle

# Python workers get these functions with the task, so executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
