"""Operators of a training-data pipeline: scoring, deduplication, filters, mixing and formatting.

Nothing else in the library imports this package, so it can be removed as a whole.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job; executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
