"""Operators for text corpora: filters, deduplication, scans, sharding and packing.

Nothing outside this subpackage and ``corpus_pipeline.py`` imports it. Its functions travel to executors by value, so executors need no copy
of the package, only the libraries.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
