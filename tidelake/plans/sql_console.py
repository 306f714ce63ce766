"""Read-only SQL over registered versions."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Functions that run code of the JVM's.
REFUSED = frozenset("reflect try_reflect java_method".split())
#: Names before a dot under which Spark reads files by their path.
FORMATS = frozenset("parquet csv json orc text avro xml binaryfile delta jdbc tidelake_excel".split())
_CALL = re.compile(r"(?:([A-Za-z_]\w*)|`([^`]*)`)\s*\(")
_TREE = "org.apache.spark.sql.catalyst."
#: Nodes of a parsed statement that aren't a query's; commands that only tell something are told by their names.
_NO_QUERY = (_TREE + "plans.logical.Command", _TREE + "plans.logical.ParsedStatement", _TREE + "plans.logical.CompoundPlanStatement", _TREE + "analysis.UnresolvedExecuteImmediate")
MOST_ROWS = 50


class QueryRefused(ValueError):
    pass


def _bare(query: str) -> str:
    """The query without comments and string literals."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|--[^\n]*|/\*.*?\*/", " ", query, flags=re.S)


def _nodes(plan):
    """All nodes of a parsed plan: children, named queries and subqueries in expressions."""
    yield plan
    for inner in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for i in range(inner.size()):
            if hasattr(inner.apply(i), "children"):
                yield from _nodes(inner.apply(i))


def run(spark: SparkSession, query: str) -> DataFrame:
    """The result of one reading statement; anything else, tables named by path, and functions that call into the JVM are refused before
    they run. What a statement does is read from the plan that Spark's own parser makes of it, so words may be used as names."""
    bare = _bare(query).strip().rstrip(";").strip()
    if not bare or ";" in bare:
        raise QueryRefused("one statement at a time")
    jvm = spark.sparkContext._jvm
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(query.strip().rstrip(";"))
    refused = [jvm.java.lang.Class.forName(c, False, spark._jsparkSession.getClass().getClassLoader()) for c in _NO_QUERY]
    for node in _nodes(plan):
        name = node.getClass().getSimpleName()
        if name.startswith(("Show", "Describe")) and node.equals(plan):
            continue
        if any(c.isInstance(node) for c in refused):
            raise QueryRefused("only reading statements are run")
        if name == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if len(parts) > 1 and (parts[0].lower() in FORMATS or any(x in parts[-1] for x in "/:\\")):
                raise QueryRefused("tables are named, not read by path")
    calls = {(a or b).lower() for a, b in _CALL.findall(bare)}
    if calls & REFUSED:
        raise QueryRefused(f"not for queries: {', '.join(sorted(calls & REFUSED))}")
    return spark.sql(query.strip().rstrip(";"))


def answer(spark: SparkSession, query: str, most: int = MOST_ROWS) -> str:
    """The first rows as a Markdown table, with a note of the total."""
    df = run(spark, query)
    rows = df.limit(most + 1).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    lines += ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"\nFirst {most} of {df.count()} rows.")
    return "\n".join(lines)
