"""Spark-native analytics for road graphs: rasters, points, graphs and graph metrics over many tiles at once."""

import sys

from pyspark import cloudpickle

# Python tasks carry the package's small helpers with them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
