"""refrain: repeated passages in large collections of text and source code, found with Spark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package
