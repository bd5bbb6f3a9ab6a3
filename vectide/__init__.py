"""Corpus preparation, embedding, vector tables and batch similarity search as Spark jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions defined in this package travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
