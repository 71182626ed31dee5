"""marlstone: a PySpark-native engine for daily financial time series.

Subpackages
-----------
``functions``   column expressions and small numeric kernels (no Spark actions)
``operators``   DataFrame -> DataFrame operators (panels, returns, risk, ...)
``sources``     parsers, stores, registries, upserts
``plans``       multi-operator plans: backtests, walk-forward, quality reports
``streaming``   Structured Streaming twins of the incremental operators
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
