"""Investigation analytics and training-data preparation as PySpark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a job runs
# on workers that do not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
