"""What a query really did: the executed plan with its row counts, and checks on its shape.

Works on the final adaptive plan of a classic (non-Connect) session.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass
class Node:
    """A physical operator: its name, its description, its metrics by name, and its inputs."""

    name: str
    detail: str
    metrics: dict[str, int]
    children: list[Node] = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        yield self
        for child in self.children:
            yield from child.walk()

    @property
    def rows(self) -> int | None:
        """Rows out; operators that count none give their input's."""
        for key in ("numOutputRows", "shuffleRecordsWritten"):
            if key in self.metrics:
                return self.metrics[key]
        return self.children[0].rows if len(self.children) == 1 else None


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _node(plan) -> Node:
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _node(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _node(plan.plan())
    children = [_node(c) for c in _items(plan.children())]
    if name in ("WholeStageCodegenExec", "InputAdapter") and len(children) == 1:
        return children[0]
    metrics = {}
    found = plan.metrics().iterator()
    while found.hasNext():
        pair = found.next()
        metrics[pair._1()] = pair._2().value()
    return Node(name.removesuffix("Exec"), plan.simpleString(200), metrics, children)


def executed(df: DataFrame) -> tuple[Node, int]:
    """Runs ``df`` to its end without keeping its rows; returns the plan that ran and the number of rows."""
    jdf = df._jdf
    rows = jdf.queryExecution().executedPlan()
    count = rows.execute().count()
    return _node(rows), count


def explain_analyze(df: DataFrame) -> DataFrame:
    """The executed plan as rows of ``QUERY PLAN``: operators, rows out, and the times and bytes they report."""
    root, count = executed(df)
    lines = []

    def put(node: Node, depth: int) -> None:
        rows = node.rows
        extra = ", ".join(f"{k} {v}" for k, v in sorted(node.metrics.items()) if v and k not in ("numOutputRows",) and re.search("Time|Size|Bytes|spill", k))
        lines.append((len(lines), "  " * depth + node.name + (f" (rows {rows})" if rows is not None else "") + (f" [{extra}]" if extra else "")))
        for child in node.children:
            put(child, depth + 1)

    put(root, 0)
    lines.append((len(lines), f"Rows returned: {count}"))
    return df.sparkSession.createDataFrame(lines, "line int, `QUERY PLAN` string").orderBy("line")


def operators(df: DataFrame) -> Counter[str]:
    """How often each physical operator stands in the plan as it would start."""
    return Counter(n.name for n in _node(df._jdf.queryExecution().executedPlan()).walk())


def scans(df: DataFrame) -> list[dict[str, str]]:
    """Of each file scan, what reached it: columns read, filters pushed down and partition filters."""
    found = []

    def visit(plan) -> None:
        name = plan.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            visit(plan.executedPlan())
        elif name.endswith("QueryStageExec"):
            visit(plan.plan())
        elif name == "FileSourceScanExec":
            about = plan.metadata()
            get = lambda key: about.apply(key) if about.contains(key) else ""
            found.append({"pushed": get("PushedFilters"), "partition": get("PartitionFilters"), "columns": get("ReadSchema")})
        for child in _items(plan.children()):
            visit(child)

    visit(df._jdf.queryExecution().executedPlan())
    return found


@dataclass(frozen=True)
class Work:
    """What Spark measured of a query: rows that its operators put out, and bytes that it shuffled and spilled."""

    rows: int
    shuffled: int
    spilled: int


def work(df: DataFrame) -> Work:
    """Runs ``df`` to its end and sums up what its operators report."""
    root, count = executed(df)
    nodes = list(root.walk())
    summed = lambda key: sum(n.metrics.get(key, 0) for n in nodes)
    return Work(count + summed("numOutputRows"), summed("shuffleBytesWritten"), summed("spillSize"))
