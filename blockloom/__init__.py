"""Corpus preparation on Spark: read, extract, filter, deduplicate, tokenize, pack, split, write, sample.

Every public function takes and returns DataFrames, so whole pipelines stay lazy until they are written.
"""

import sys

from pyspark import cloudpickle

# The few functions that run inside Python workers travel with the task, so a cluster needs no extra --py-files.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
