"""tessera: a PySpark-native engine for retrieval, evidence graphs and corpus analytics.

Functions that run in Python workers are shipped by value, so executors need no
installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
