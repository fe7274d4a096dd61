"""Operators for preparing training data.

Functions of this package travel to the executors by value, so that tasks run
where the package is not installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
