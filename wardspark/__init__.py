"""wardspark: admission/event cohorts, labelled event sequences and federated table
operators expressed as Spark DataFrame plans.

Layout
------
sources/    readers, writers, stage cuts and the fixture views over the test tables
functions/  column-expression builders (pure ``Column -> Column``)
operators/  DataFrame -> DataFrame operators (cohort, codes, events, tokens, folds, fed, metrics)
plans/      the query catalog used by ``__spark_entry__`` and the DuckDB oracle texts
"""

import sys

from pyspark import cloudpickle

from wardspark.session import get_session, checkpoint_dir  # noqa: F401

# Functions sent to executors travel by value, so workers needn't have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
