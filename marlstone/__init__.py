"""Labelled-clip datasets and detector evaluation as Spark jobs.

Functions take DataFrames and column names and return lazy DataFrames; nothing here starts a session.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to Python workers carry their own code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
