"""JSON aggregation plan -> lazy DataFrames.

A plan is the JSON dict a planner (LLM or the rule planner in ``plans.rules``)
emits.  Each op becomes one DataFrame built from the DataFrame API; Catalyst is
the optimizer (filters reach the Parquet scan, unused columns are pruned,
``orderBy().limit()`` becomes a top-k).  Building an op runs small jobs only where its
operators need them: value ranges of quantile columns, row counts of a table's files for
file order.  Build-time checks against the schema replace run-time failures, and an op that
cannot be analysed is an error of its own: one bad op never stops the others (Q6).

Semantics kept from the reference (pandas):
* ``!=`` keeps nulls; ``== null`` matches nothing; mismatched types -> no rows (==)
  or an op error (<, >);
* rows with a null group key are dropped; groups come back in key order;
* output columns are ``<column>_<function>``; group size is ``count`` when no
  aggregate column is valid;
* sort puts nulls last in both directions.
Decided differently (see README): every sort key is used, a missing table is an
error unless ``strict=False``, global aggregates take lists, a string
``group_by`` is one column, table steps run on their own table.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsight.catalog import ROW_ID, TableSet, data_columns, edge_rows
from tabsight.functions.aggregates import PlanError, nan_as_null
from tabsight.functions.predicates import build_filter
from tabsight.operators.grouped import function_call, grouped_aggregate, needs_file_order, present

ISSUE_SCHEMA = "op string, severity string, message string"


@dataclass
class OpResult:
    key: str
    df: DataFrame | None = None
    table: str | None = None
    operation: str = "aggregation"
    error: str | None = None
    order: list[tuple[str, bool]] = field(default_factory=list)   # (column, ascending): output order (G13)

    @property
    def ok(self) -> bool:
        return self.error is None

    def ordered(self) -> DataFrame:
        """Result in the order the reference would list its records."""
        if self.df is None:
            raise PlanError(self.error or "no result")
        return self.df.orderBy(*_order_cols(self.df, self.order)) if self.order else self.df


@dataclass
class PlanRun:
    results: dict[str, OpResult]
    issues: list[tuple[str, str, str]]
    tables: TableSet
    persisted: list = field(default_factory=list)

    def release(self) -> None:
        """Unpersist tables cached for scan reuse."""
        for df in self.persisted:
            df.unpersist()
        self.persisted = []

    def issues_df(self, spark: SparkSession) -> DataFrame:
        rows = list(self.issues) + [(k, "error", r.error) for k, r in self.results.items() if r.error]
        return spark.createDataFrame(rows, ISSUE_SCHEMA)

    def summary_df(self, spark: SparkSession) -> DataFrame:
        """Q4: one row per op: key, operation, table, rows, columns, error.

        Row counts are computed by Spark (one count job per op result)."""
        parts = []
        for k, r in self.results.items():
            if r.df is not None:
                parts.append(r.df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(k).alias("op"), F.lit(r.operation).alias("operation"),
                    F.lit(r.table).alias("table"), F.col("rows"),
                    F.array(*[F.lit(c) for c in r.df.columns]).cast("array<string>").alias("columns"),
                    F.lit(None).cast("string").alias("error")))
            else:
                parts.append(spark.createDataFrame(
                    [(k, r.operation, r.table, None, None, r.error)],
                    "op string, operation string, table string, rows bigint, columns array<string>, error string"))
        return reduce(DataFrame.unionByName, parts)

    def metadata_df(self, spark: SparkSession) -> DataFrame:
        """Q5: tables processed, ops executed, total input rows (summed by Spark)."""
        from tabsight.operators.profile import row_counts
        total = row_counts(self.tables).agg(F.sum("row_count").alias("total_rows_processed"))
        return total.select(F.lit(len(self.tables)).alias("tables_processed"),
                            F.lit(len(self.results)).alias("aggregations_executed"),
                            F.col("total_rows_processed"))


def _as_list(v) -> list:
    if v is None:
        return []
    if isinstance(v, (list, tuple)):
        return list(v)
    return [v]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _named_columns(op: dict) -> set | None:
    """Columns that an aggregating op names (with ``_row_id`` if a function needs file order); None for an op that
    returns whole rows."""
    aggs = op.get("aggregate") or op.get("agg_functions")
    if not isinstance(aggs, dict):
        return None
    out = {c for c in aggs} | {g for g in _as_list(op.get("group_by") or op.get("groupby")) if isinstance(g, str)}
    out |= {f.get("column") for f in _as_list(op.get("filters")) if isinstance(f, dict)}
    functions = [f for fs in aggs.values() for f in _as_list(fs)]
    try:
        if needs_file_order(functions):
            out.add(ROW_ID)
    except PlanError:
        pass    # reported when the op is built
    return out


def _order_cols(df: DataFrame, order: list[tuple[str, bool]]) -> list[Column]:
    """Sort columns with pandas' placement of missing values, NaN included: last in both directions."""
    out = []
    for c, asc in order:
        x = nan_as_null(_q(c), df.schema[c].dataType)
        out.append(x.asc_nulls_last() if asc else x.desc_nulls_last())
    return out


class PlanExecutor:
    """Builds DataFrames for plan ops over a :class:`TableSet`."""

    def __init__(self, tables: TableSet, strict: bool = False, reuse_scans: bool = False):
        self.tables = tables
        self.strict = strict
        self.reuse_scans = reuse_scans
        self._shared: dict[str, DataFrame] = {}

    # ------------------------------------------------------------------ dispatch (Q1)
    def run(self, plan: dict) -> PlanRun:
        issues: list[tuple[str, str, str]] = []
        results: dict[str, OpResult] = {}
        if not isinstance(plan, dict):
            raise PlanError("plan must be a JSON object")
        persisted = self._persist_shared(plan) if self.reuse_scans else []
        if "aggregations" in plan:
            for i, op in enumerate(_as_list(plan["aggregations"])):
                key = f"aggregation_{i + 1}"
                results[key] = self._safe(key, op, issues)
        elif "operations" in plan:
            for i, op in enumerate(_as_list(plan["operations"])):
                key = f"operation_{i + 1}"
                results[key] = self._safe(key, op, issues)
        elif "tables" in plan:
            for tname, steps in (plan["tables"] or {}).items():
                if self.tables.resolve(tname) is None:
                    issues.append((tname, "info", f"table '{tname}' not found, steps skipped"))
                    continue
                for i, step in enumerate(_as_list(steps)):
                    key = f"{tname}.step_{i + 1}"
                    spec = dict(step) if isinstance(step, dict) else step
                    if isinstance(spec, dict):
                        spec.setdefault("table", tname)   # Q7: the step runs on its own table
                    results[key] = self._safe(key, spec, issues)
        else:
            results["main_aggregation"] = self._flexible(plan)
        run = PlanRun(results, issues, self.tables)
        run.persisted = persisted
        return run

    def _persist_shared(self, plan: dict) -> list[DataFrame]:
        """Common scan reuse: the columns that two or more aggregating ops of one table name are persisted once
        (memory, spilling to disk; lost blocks are recomputed from the deterministic lineage).  Ops that return whole
        rows keep their own pruned and pushed-down scan.  Call :meth:`PlanRun.release` when the results are used."""
        from pyspark import StorageLevel
        ops = plan.get("operations") or plan.get("aggregations") or []
        used: dict[str, list[set]] = {}
        for op in ops if isinstance(ops, list) else []:
            key = self.tables.resolve(op.get("table")) or self.tables.first() if isinstance(op, dict) else None
            cols = _named_columns(op) if key is not None else None
            if cols is not None:
                used.setdefault(key, []).append(cols)
        persisted, frames = [], {}
        for k, sets in used.items():
            if len(sets) < 2:
                continue
            ordered = any(ROW_ID in c for c in sets)
            df = self.tables[k] if ordered else self.tables.plain(k)
            keep = [c for c in df.columns if c == ROW_ID or any(c in s for s in sets)]
            frames[k] = df.select(*[_q(c) for c in keep]).persist(StorageLevel.MEMORY_AND_DISK)
            persisted.append(frames[k])
        self._shared = frames
        return persisted

    def _safe(self, key: str, spec, issues) -> OpResult:
        try:
            return self.build(spec, key=key, issues=issues)
        except (PlanError, PySparkException) as e:   # Q6: isolate the failing op
            return OpResult(key, None, spec.get("table") if isinstance(spec, dict) else None,
                            spec.get("type", "aggregation") if isinstance(spec, dict) else "aggregation",
                            str(e).split("\n")[0])

    def _flexible(self, plan: dict) -> OpResult:
        """Q8: describe the first table's numeric columns, or return it untouched."""
        from tabsight.operators.describe import describe
        first = self.tables.first()
        if first is None:
            return OpResult("main_aggregation", None, None, "flexible_execution", "no tables")
        df = self.tables.plain(first)
        if not plan or not any(k in plan for k in ("group_by", "aggregate", "filters")):
            return OpResult("main_aggregation", describe(df), first, "flexible_execution")
        return OpResult("main_aggregation", df, first, "flexible_execution")

    # ------------------------------------------------------------------ one op
    def resolve(self, name: str | None, key: str, issues) -> str:
        """Q2: exact or normalized name; otherwise the first table (non-strict) or an error."""
        found = self.tables.resolve(name)
        if found is not None:
            return found
        if self.strict or self.tables.first() is None:
            raise PlanError(f"table '{name}' not found; available: {list(self.tables)}")
        first = self.tables.first()
        if name:
            issues.append((key, "warning", f"table '{name}' not found, using '{first}'"))
        return first

    def build(self, spec: dict, key: str = "op", issues: list | None = None) -> OpResult:
        issues = [] if issues is None else issues
        if not isinstance(spec, dict):
            raise PlanError(f"op must be an object, got {type(spec).__name__}")
        table = self.resolve(spec.get("table"), key, issues)
        group = spec.get("group_by") or spec.get("groupby")
        aggs = spec.get("aggregate") or spec.get("agg_functions")
        wants = _named_columns(spec)
        names = set(self.tables.plain(table).columns)
        if group and wants is not None and not any(g in names for g in _as_list(group) if isinstance(g, str)):
            wants = None     # G12: no valid key, the op returns whole rows
        if table in self._shared and wants is not None:
            df = self._shared[table]
            full = self.tables.plain(table).schema
        else:
            df = self.tables[table] if wants is None or ROW_ID in wants else self.tables.plain(table)
            full = df.schema
            if not (group and aggs) and not aggs and not spec.get("filters") and not spec.get("sort"):
                df = self._first_rows(table, df, spec.get("limit"))
        has_row_id = ROW_ID in df.columns
        schema = T.StructType([f for f in full.fields if f.name != ROW_ID])

        # filters (F1-F10): one conjunction, Catalyst pushes it to the scan
        preds = []
        for fspec in _as_list(spec.get("filters")):
            if not isinstance(fspec, dict):
                raise PlanError(f"filter must be an object, got {fspec!r}")
            out = build_filter(schema, fspec)
            if out.issue:
                issues.append((key, "info", out.issue))
            if out.predicate is not None:
                preds.append(out.predicate)
        if preds:
            df = df.filter(reduce(lambda a, b: a & b, preds))

        order: list[tuple[str, bool]] = []
        kind = "pass"
        if group and aggs:
            df, order, kind = self._grouped(df, schema, _as_list(group), aggs, has_row_id, key, issues)
        elif aggs:
            df = self._global(df, schema, aggs, has_row_id, key, issues)
            kind = "global"
        if kind == "pass" and has_row_id:
            order = [(ROW_ID, True)]

        df, order = self._sort_limit(df, spec, order, key, issues)
        if ROW_ID in df.columns:
            df = df.drop(ROW_ID)
            order = [o for o in order if o[0] != ROW_ID]
        return OpResult(key, df, table, spec.get("type", "aggregation"), None, order)

    def _first_rows(self, table: str, df: DataFrame, limit) -> DataFrame:
        """A bare ``limit`` over a file scan reads only the files that hold the first rows."""
        scan = self.tables.scan(table)
        if scan is None or isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
            return df
        return edge_rows(scan, limit, 0)

    def _specs(self, schema: T.StructType, aggs, key, issues) -> list[tuple[str, str]]:
        """Valid (column, function) pairs in plan order."""
        if not isinstance(aggs, dict):
            raise PlanError(f"aggregations must map column -> function(s), got {aggs!r}")
        names = {f.name for f in schema.fields}
        out = []
        for col, funcs in aggs.items():
            if col not in names:
                issues.append((key, "info", f"aggregate skipped: unknown column '{col}'"))
                continue
            for fn in _as_list(funcs):
                function_call(fn)
                out.append((col, fn))
        return out

    def _grouped(self, df, schema, group, aggs, has_row_id, key, issues):
        types = {f.name: f.dataType for f in schema.fields}
        keys = [g for g in group if isinstance(g, str) and g in types]
        for g in group:
            if g not in keys:
                issues.append((key, "info", f"group column skipped: '{g}'"))
        if not keys:   # G12: no valid key -> table unaggregated (every column, in file order)
            issues.append((key, "info", "no valid group column: table returned unaggregated"))
            return df, [], "pass"
        df = df.filter(reduce(lambda a, b: a & b, [present(k, types[k]) for k in keys]))  # G1: null and NaN keys go
        specs = self._specs(schema, aggs, key, issues)
        if specs:
            out = grouped_aggregate(df, keys, specs, ROW_ID if has_row_id else None)
        else:   # G11
            out = df.groupBy(*[_q(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
        return out, [(k, True) for k in keys], "group"

    def _global(self, df, schema, aggs, has_row_id, key, issues):
        specs = self._specs(schema, aggs, key, issues)
        if not specs:
            # the reference returns an empty frame: no valid aggregate column
            return df.limit(0).select()
        return grouped_aggregate(df, [], specs, ROW_ID if has_row_id else None)

    def _sort_limit(self, df: DataFrame, spec: dict, order: list[tuple[str, bool]], key, issues):
        sort_cfg = spec.get("sort")
        sort_cols: list[tuple[str, bool]] = []
        if sort_cfg is not None:
            entries = sort_cfg if isinstance(sort_cfg, list) else [sort_cfg]
            visible = set(data_columns(df))
            for s in entries:
                if not isinstance(s, dict):
                    issues.append((key, "info", f"sort entry skipped: {s!r}"))
                    continue
                c = s.get("column")
                if c not in visible:
                    issues.append((key, "info", f"sort skipped: unknown column '{c}'"))
                    continue
                sort_cols.append((c, bool(s.get("ascending", True))))
        if sort_cols:
            order = sort_cols + [o for o in order if o[0] not in {c for c, _ in sort_cols}]  # tie-break
        limit = spec.get("limit")
        if limit is not None:
            if isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
                raise PlanError(f"limit must be a non-negative integer, got {limit!r}")
            df = (df.orderBy(*_order_cols(df, order)) if order else df).limit(limit)
        return df, order


def execute_plan(tables: TableSet, plan: dict, strict: bool = False) -> PlanRun:
    """Convenience wrapper: build every op of ``plan`` over ``tables``."""
    return PlanExecutor(tables, strict=strict).run(plan)
