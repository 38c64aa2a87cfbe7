"""Operators that prepare text corpora for language-model training, and the queries over them.

Functions of this package travel to executors by value, so workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
