"""Hybrid (sparse + dense) document retrieval as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry this package with them, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
