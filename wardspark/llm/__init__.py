"""Operators of a training-data pipeline over ``documents``-shaped tables.

One module per operator; ``queries`` registers one query for each. Nothing outside this
folder (but the guarded hook in ``__spark_entry__.py`` and ``corpus_pipeline.py``) imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so workers needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
