"""Geodata layers as lazy Spark plans."""

import sys

from pyspark import cloudpickle

from .model import Bounds, Layer

# Functions that run in Python workers travel with the plan, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Bounds", "Layer"]
