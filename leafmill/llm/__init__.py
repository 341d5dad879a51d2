"""Training-data operators. Nothing else in the package imports this folder.

Functions that run inside Python workers are pickled by value, so a cluster
needs no copy of the repository on its executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
