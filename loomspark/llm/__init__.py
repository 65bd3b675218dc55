"""Operators for preparing training text at scale; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions travel to executors with their code, so that these need no installation of the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])
