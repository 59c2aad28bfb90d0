"""Scoring of drawing-extraction runs (boxes, texts, field values) as Spark jobs."""

import sys

from pyspark import cloudpickle

# Python tasks get the few functions they need with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
