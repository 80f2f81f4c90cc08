"""Plumbline: listing-quality and assistant-visibility analytics expressed as Spark DataFrame jobs.

Functions that run inside Python tasks are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
