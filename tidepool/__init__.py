"""tidepool: a Spark-native analytics engine (DataFrame, SQL, Structured Streaming)."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that no path has to be shared.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
