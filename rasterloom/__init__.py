"""Spark-native raster analytics: pixels are rows, palettes and layouts are small dimension tables."""

import sys

from pyspark import cloudpickle

# Functions travel to executors with their code: these need not have the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
