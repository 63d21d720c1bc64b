"""Evidence and change analytics over document collections, as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

# Helpers that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
