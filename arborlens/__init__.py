"""Source-corpus curation and review analytics, written as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few Python functions that run in tasks travel with the job; executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
