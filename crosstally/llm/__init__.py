"""Operators for corpora of training text.

Functions of this subpackage that run in Spark's Python workers travel with the job, so executors
need no copy of it on their path.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
