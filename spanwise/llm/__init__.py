"""Operators for preparing training data for language models.

Functions that run in tasks travel with the task by value, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
