"""Price-index, cost-escalation and training-data analytics as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors by value, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
