"""tabsight: Spark-native tabular profiling, checking and plan-driven aggregation.

Subpackages
-----------
sources    file, payload, ZIP and table readers (batch)
streaming  folder ingest with Structured Streaming
functions  Column-level building blocks (aggregates with pandas semantics,
           plan predicates, name rules, display formats)
operators  profile, inclusion dependencies, quality rules, insights,
           describe with exact quantiles, window analytics
plans      JSON aggregation plan -> DataFrame executor, plan validation and
           rule-made plans
sinks      CSV/JSON/parquet result writers with a manifest
"""

import sys as _sys

try:  # ship Python helpers (pandas UDFs, mapInPandas functions) with their code, so
    # executors need no installed copy of this package
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

from tabsight.session import get_spark, checkpoint_root  # noqa: F401,E402
from tabsight.catalog import TableSet, load_tables  # noqa: F401,E402

__version__ = "0.1.0"
