"""Caption-timeline analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

from captrail.config import CaptionConfig

# Kernels travel to executors by value, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["CaptionConfig"]
