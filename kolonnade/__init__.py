"""kolonnade: schema-ambiguity analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to the executors by value, so a cluster needs no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
