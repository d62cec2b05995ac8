"""Selective extraction on Spark: slice, page, select, audit and reassemble tables and file sets."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
