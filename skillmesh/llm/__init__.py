"""Operators for preparing training text: one module per operator.

``registry`` lists the queries over the test tables and their oracle SQL.
Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Spark's Python workers travel with the job, so that
# executors need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
