"""Operators for preparing language-model training data.

Self-contained: the rest of the library never imports this package.
"""

import sys

from pyspark import cloudpickle

# Tasks get this package's functions by value: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
