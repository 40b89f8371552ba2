"""Spark jobs over tables of captured images, detected regions and pixel masks."""

import sys

from pyspark import cloudpickle

# The few Python functions travel to the executors by value, so that workers need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
