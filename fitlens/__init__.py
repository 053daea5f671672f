"""Spark-first matching of semi-structured text postings against profile documents."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel with their code, so the package needs to be
# installed where the driver runs only.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
