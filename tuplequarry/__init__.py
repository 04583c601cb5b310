"""tuplequarry: offline analytics over PostgreSQL-family heap storage on Spark."""

import sys

from pyspark import cloudpickle

# Python workers do not inherit the driver's sys.path, so everything of this package travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
