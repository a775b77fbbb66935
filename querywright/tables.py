"""The tables and the registry of queries: a Spark side and the DuckDB SQL it is compared with."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_NAMED = re.compile(r"\b(" + "|".join(TABLES) + r")\b", re.IGNORECASE)

Query = Callable[[SparkSession, str], DataFrame]


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share for cut points: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary one; on a cluster that is an error.
    """
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = found or tempfile.mkdtemp(prefix="querywright-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(text: str) -> Query:
    """A query over the tables that its text names, read as views."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in {m.lower() for m in _NAMED.findall(text)}:
            load(spark, sf_dir, name).createOrReplaceTempView(name)
        return spark.sql(text)

    return run


@dataclass
class Registry:
    """Queries by name; ``twin`` is absent where SQL cannot express one."""

    queries: dict[str, Query] = field(default_factory=dict)
    twins: dict[str, str] = field(default_factory=dict)

    def same(self, **texts: str) -> None:
        """Texts that both engines read alike."""
        for name, text in texts.items():
            self.pair(name, text, text)

    def pair(self, name: str, ours: str, theirs: str) -> None:
        self.add(name, sql(ours), theirs)

    def add(self, name: str, query: Query, twin: str | None = None) -> None:
        assert name not in self.queries, name
        self.queries[name] = query
        if twin:
            self.twins[name] = twin

    def frame(self, twin: str | None = None) -> Callable[[Query], Query]:
        """Registers a DataFrame query under its function's name."""

        def keep(query: Query) -> Query:
            self.add(query.__name__, query, twin)
            return query

        return keep
