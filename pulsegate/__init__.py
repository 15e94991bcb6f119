"""Rule, window and pattern evaluation over customer event streams, on Spark."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the plan, so executors
# need no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
