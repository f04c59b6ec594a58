"""skyfold: a Spark-first engine for curating scientific catalogues."""

import sys

from pyspark import cloudpickle

# Python functions reach the executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
