"""Operators for text corpora. Nothing else in the library imports this folder."""

import sys

from pyspark import cloudpickle

# task functions travel with their code, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
