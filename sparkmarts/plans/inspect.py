"""Plan inspection: read a DataFrame's physical plan and check the properties the engine
relies on at scale (no cartesian products, pruned scans, pushed filters, bounded joins)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

_READ_SCHEMA = re.compile(r"ReadSchema: struct<(.*)>")
_PUSHED = re.compile(r"PushedFilters: \[(.*)\]")
_PARTITION_FILTERS = re.compile(r"PartitionFilters: \[(.*)\]")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """The physical plan as text (what ``df.explain(mode)`` prints)."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def scanned_columns(plan: str) -> list[list[str]]:
    """Column names read by each file scan, in plan order."""
    out = []
    for fields in _READ_SCHEMA.findall(plan):
        names, depth, current = [], 0, ""
        for ch in fields:
            if ch == "<":
                depth += 1
            elif ch == ">":
                depth -= 1
            if ch == "," and depth == 0:
                names.append(current.split(":")[0])
                current = ""
            else:
                current += ch
        if current:
            names.append(current.split(":")[0])
        out.append(names)
    return out


def pushed_filters(plan: str) -> list[str]:
    return _PUSHED.findall(plan)


def partition_filters(plan: str) -> list[str]:
    return _PARTITION_FILTERS.findall(plan)


def count_nodes(plan: str, node: str) -> int:
    """Occurrences of a physical operator in the formatted plan's tree section."""
    tree = plan.split("\n\n", 1)[0]
    return len(re.findall(rf"\b{re.escape(node)}\b", tree))


UNBOUNDED_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def unbounded_joins(plan: str) -> list[str]:
    """Join operators that pair rows without an equality key."""
    return [j for j in UNBOUNDED_JOINS if j in plan]


def shuffled_rows(df: DataFrame) -> int:
    """Rows that ``df`` writes to all its shuffles when it runs (it is run, with adaptive plans off)."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fresh = df.select("*")
        execution = fresh._jdf.queryExecution()
        execution.executedPlan().executeCollect()
        total, nodes = 0, [execution.executedPlan()]
        while nodes:
            node = nodes.pop()
            if node.nodeName() == "Exchange":
                total += node.metrics().apply("shuffleRecordsWritten").value()
            children = node.children()
            nodes += [children.apply(i) for i in range(children.size())]
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
