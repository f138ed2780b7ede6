"""Operators for preparing text corpora. Their functions travel to the executors with the tasks that call them."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
