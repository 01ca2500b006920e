"""Property-graph, retrieval and text-processing operators on Spark DataFrames.

Operators take and return DataFrames; nothing runs until the caller acts on
the result, except where an operator documents that it materialises a stage.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
