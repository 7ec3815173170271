"""Spark-native sequence analytics: DataFrame operators, sources, plans and streams."""

import sys

from pyspark import cloudpickle

# Workers get functions of this package by value, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
