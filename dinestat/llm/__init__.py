"""Operators for preparing training text: scoring, filtering, deduplication, packing.

Functions of this package run inside Spark tasks. They travel with the job by value,
so executors need Spark's Python libraries but not an installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
