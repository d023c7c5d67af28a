"""Job-search analytics operators for Spark."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: the few Python functions that run
# inside tasks travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
