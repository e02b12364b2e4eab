"""quire: annotated-record analytics as plain DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions are shipped by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
