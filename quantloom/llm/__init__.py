"""Operators of a training-data pipeline: deduplication, decontamination, classifiers, scans, mixing and sharding.

Each module holds one operator with its own general interface; ``queries`` registers one query for each of them. Nothing
else in the library imports this package. Functions that run inside Python tasks are shipped by value, so executors
need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
