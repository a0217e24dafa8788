"""A PySpark library for routing, admitting, redacting, archiving and metering application logs."""

import sys

from pyspark import cloudpickle

# The few Arrow helpers travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
