"""The Spark session with the settings that the library's semantics rest on."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

#: ANSI arithmetic and casts, one time zone, recursion as deep as 1000 levels, maps that keep the last of equal keys.
SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.cteRecursionLevelLimit": "1000",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    """A session with ``SETTINGS``; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName("querywright").config(map=SETTINGS | more)
    if master:
        cores = os.cpu_count() or 8
        builder = builder.master(master).config(map={"spark.sql.shuffle.partitions": str(more.get("spark.sql.shuffle.partitions", cores)), "spark.ui.enabled": "false"})
    return builder.getOrCreate()


def create_views(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for name in names:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


#: Quoted text, comments, a semicolon, or any other single character.
_TOKEN = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`)|(--[^\n]*|/\*.*?\*/)|(;)|.""", re.DOTALL)


def statements(text: str) -> list[str]:
    """The statements of a script, cut at semicolons outside quotes and comments; comments become a space."""
    found, now = [], []
    for token in _TOKEN.finditer(text):
        if token[3]:
            found.append("".join(now).strip())
            now = []
        else:
            now.append(" " if token[2] else token[0])
    return [s for s in [*found, "".join(now).strip()] if s]


def only_reads(spark: SparkSession, statement: str) -> bool:
    """Whether a statement is a query or a catalog report, by Spark's own parse of it: no node of the plan writes or sets anything."""
    classes = spark._jvm.java.lang.Class
    acting = [classes.forName(f"org.apache.spark.sql.catalyst.plans.logical.{name}") for name in ("Command", "ParsedStatement")]
    nodes = [spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)]
    while nodes:
        node = nodes.pop()
        if any(c.isInstance(node) for c in acting):
            return node.getClass().getSimpleName().startswith(REPORTS)
        children = node.children()
        nodes.extend(children.apply(k) for k in range(children.size()))
    return True


#: Commands that only report.
REPORTS = ("Show", "Describe", "Explain")


def run_script(spark: SparkSession, text: str, *, read_only: bool = False) -> list[DataFrame]:
    """Runs statements separated by ``;`` and returns a result for each.

    With ``read_only`` only queries and catalog reports are let through; the whole script is looked at before any of it runs.
    """
    found = statements(text)
    if read_only:
        for statement in found:
            if not only_reads(spark, statement):
                raise PermissionError(f"READ_ONLY: not a reading statement: {statement[:80]}")
    return [spark.sql(statement) for statement in found]
