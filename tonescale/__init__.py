"""Continuous-scale text annotation (valence / arousal / dominance) as Spark jobs."""

import sys

from pyspark import cloudpickle

from tonescale.session import build_session

# Functions that run inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
