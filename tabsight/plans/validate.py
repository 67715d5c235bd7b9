"""Plan validation against the table schemas, before anything runs.

The reference's planner prompt asks for 3-4 ops, only ``sum/mean/count/min/max/
std/median``, existing tables and columns, a sort and a limit of 5-20 rows.  The
executor itself accepts more (see ``functions.aggregates.SUPPORTED_AGGS``); this
check reports every deviation as an issue row instead of failing the run.
Plan checking is schema-level work: no data is read.
"""

from __future__ import annotations

from tabsight.catalog import TableSet
from tabsight.functions.aggregates import SUPPORTED_AGGS, PlanError
from tabsight.operators.grouped import function_call

# The planner constraints of the reference prompt.
PROMPT_FUNCTIONS = ("sum", "mean", "count", "min", "max", "std", "median")
MIN_OPS, MAX_OPS = 3, 4
MIN_LIMIT, MAX_LIMIT = 5, 20


def _ops(plan: dict) -> list[tuple[str, dict]]:
    if "operations" in plan:
        return [(f"operation_{i + 1}", op) for i, op in enumerate(plan.get("operations") or [])]
    if "aggregations" in plan:
        return [(f"aggregation_{i + 1}", op) for i, op in enumerate(plan.get("aggregations") or [])]
    if "tables" in plan:
        return [(f"{t}.step_{i + 1}", {**s, "table": s.get("table", t)} if isinstance(s, dict) else s)
                for t, steps in (plan.get("tables") or {}).items() for i, s in enumerate(steps or [])]
    return [("main_aggregation", plan)]


def validate_plan(plan: dict, tables: TableSet, strict_prompt: bool = True) -> list[tuple[str, str, str]]:
    """Issues (op, severity, message); severity ``error`` = the op cannot run."""
    issues: list[tuple[str, str, str]] = []
    if not isinstance(plan, dict):
        return [("plan", "error", "plan must be a JSON object")]
    ops = _ops(plan)
    if strict_prompt and "operations" in plan and not (MIN_OPS <= len(ops) <= MAX_OPS):
        issues.append(("plan", "warning", f"plan has {len(ops)} operations, expected {MIN_OPS}-{MAX_OPS}"))
    for key, op in ops:
        if not isinstance(op, dict):
            issues.append((key, "error", "operation must be an object"))
            continue
        tname = tables.resolve(op.get("table"))
        if tname is None:
            issues.append((key, "error", f"unknown table '{op.get('table')}'"))
            continue
        cols = set(tables.plain(tname).columns)
        group = op.get("group_by") or op.get("groupby") or []
        group = [group] if isinstance(group, str) else list(group)
        for g in group:
            if g not in cols:
                issues.append((key, "error", f"unknown group column '{g}'"))
        aggs = op.get("aggregate") or op.get("agg_functions") or {}
        out_cols = set(group)
        if not isinstance(aggs, dict):
            issues.append((key, "error", "aggregations must map column -> functions"))
            aggs = {}
        for col, fns in aggs.items():
            if col not in cols:
                issues.append((key, "error", f"unknown aggregate column '{col}'"))
            for fn in (fns if isinstance(fns, list) else [fns]):
                try:
                    called = function_call(fn)[0]
                except PlanError:
                    called = None
                if called not in (*SUPPORTED_AGGS, "nth"):
                    issues.append((key, "error", f"unsupported function '{fn}'"))
                elif strict_prompt and fn not in PROMPT_FUNCTIONS:
                    issues.append((key, "warning", f"function '{fn}' is outside the planner's allowed list"))
                out_cols.add(f"{col}_{fn}")
        if not aggs:
            out_cols = cols
        for f in op.get("filters") or []:
            if isinstance(f, dict) and f.get("column") not in cols:
                issues.append((key, "warning", f"filter column '{f.get('column')}' does not exist"))
        sort = op.get("sort")
        entries = sort if isinstance(sort, list) else ([sort] if sort else [])
        if strict_prompt and not entries:
            issues.append((key, "warning", "operation has no sort"))
        for s in entries:
            if isinstance(s, dict) and s.get("column") not in out_cols:
                issues.append((key, "warning", f"sort column '{s.get('column')}' is not in the result"))
        limit = op.get("limit")
        if limit is None:
            if strict_prompt:
                issues.append((key, "warning", "operation has no limit"))
        elif isinstance(limit, bool) or not isinstance(limit, int) or limit < 0:
            issues.append((key, "error", f"invalid limit {limit!r}"))
        elif strict_prompt and not (MIN_LIMIT <= limit <= MAX_LIMIT):
            issues.append((key, "warning", f"limit {limit} outside {MIN_LIMIT}-{MAX_LIMIT}"))
    return issues

