"""Scored-text and speech-transcript analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
