"""lexmill: text-corpus and vocabulary analytics expressed as Spark plans.

Functions of this package that run in Python workers are pickled by value, so
a job needs no installed copy of the package on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
