"""Operators that prepare text and vectors for training language models.

Nothing outside this subpackage imports it.
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value, so that executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
