"""Run analytics on Spark: time series recorded while programs run on real hardware."""

import sys

from pyspark import cloudpickle

# Batch helpers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
