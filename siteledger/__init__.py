"""Audit of structured web data on Spark: declared modules against page markup."""

import sys

from pyspark import cloudpickle

# The few Python leaf functions travel to the executors inside the job, so the package
# need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
