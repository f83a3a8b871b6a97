"""Spark-native hybrid search and ranking over property listings.

Queries are rows, so one search and a thousand searches share one plan.
"""

import sys

from pyspark import cloudpickle

# Functions of this package that run on executors travel by value: a cluster
# needs no copy of the package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
