"""Registered checks: each entry is a Spark query over the driver tables plus the
equivalent SQL that DuckDB runs on the same Parquet files (the oracle).

``REGISTRY[name] = Check(spark_fn, sql)``; ``sql`` is None where the result is not
SQL-expressible (then only row counts are compared)."""

from tabsight.suite.base import REGISTRY, Check  # noqa: F401
from tabsight.suite import (analytics_checks, ingest_checks, output_checks, plan_checks,  # noqa: F401
                            profile_checks, quality_checks, sketch_checks)
