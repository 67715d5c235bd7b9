"""A rule-made aggregation plan in place of the external LLM planner.

The profile (one Spark job over all tables) is reduced to one row per column and
brought to the driver: its size is the number of columns, not rows.  Rules:

* group keys: string columns with 2..``max_groups`` distinct values;
* measures: KPI-named numeric columns (X7), else numeric columns that are not
  primary-key candidates;
* one op per (key, measure), measures ``sum/mean/count``, sorted by the sum, the first
  ``limit`` groups (a top-k report).

Columns that the rules leave out, and ops beyond an optional ``max_ops``, are listed with their
reason under ``skipped``.
"""

from __future__ import annotations

from tabsight.catalog import TableSet
from tabsight.operators.insights import KPI_KEYWORDS
from tabsight.operators.profile import profile_columns


def rule_plan(tables: TableSet, names: list[str] | None = None, max_groups: int = 50, max_ops: int | None = None,
              limit: int | None = 10) -> dict:
    names = names or list(tables)
    prof = (profile_columns(tables, names, samples=False)
            .select("file_name", "column_name", "ordinal", "data_type", "unique_count", "is_pk_candidate")
            .collect())
    by_table: dict[str, list] = {}
    for r in prof:
        by_table.setdefault(r["file_name"], []).append(r)
    ops, skipped = [], []
    for t in names:
        cols = sorted(by_table.get(t, []), key=lambda r: r["ordinal"])
        keys = []
        for r in cols:
            if r["data_type"] != "string":
                continue
            if 2 <= r["unique_count"] <= max_groups:
                keys.append(r["column_name"])
            else:
                skipped.append((t, r["column_name"], f"{r['unique_count']} distinct values, a group key has 2 to {max_groups}"))
        numeric = [r for r in cols if r["data_type"] in ("int", "float")]
        measures = [r["column_name"] for r in numeric
                    if any(k in r["column_name"].lower() for k in KPI_KEYWORDS)]
        if not measures:
            measures = [r["column_name"] for r in numeric if not r["is_pk_candidate"]]
        for k in keys:
            for m in measures:
                op = {"name": f"{m}_by_{k}", "type": "groupby", "table": t, "groupby": [k],
                      "agg_functions": {m: ["sum", "mean", "count"]},
                      "sort": [{"column": f"{m}_sum", "ascending": False}], "output_name": f"{m}_by_{k}"}
                ops.append({**op, "limit": limit} if limit is not None else op)
    if max_ops is not None:
        skipped += [(op["table"], op["name"], f"beyond the first {max_ops} operations") for op in ops[max_ops:]]
    return {"operations": ops[:max_ops], "skipped": skipped}
