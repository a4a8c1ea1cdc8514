"""Registry of named queries, their input views and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tourlog.session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# tables of long texts, whose rules are bound by CPU rather than by reading
TEXT_TABLES = ("documents", "conversations")

# tasks for each partition of a view whose rules read every text several times
PIECES = 16

QUERIES: dict[str, Callable[["Inputs"], DataFrame]] = {}
ORACLES: dict[str, tuple[str, tuple[str, ...]]] = {}
CTES: dict[str, tuple[str, tuple[str, ...]]] = {}
VIEWS: dict[str, Callable[["Inputs"], DataFrame]] = {}


class Inputs:
    """Lazily built DataFrames over one data directory.

    ``inputs.t("orders")`` is a raw table, ``inputs.v("records")`` a derived
    view.  Nothing is cached: a view is a logical plan that Catalyst prunes per
    query.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._built: dict[str, DataFrame] = {}

    def t(self, name: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(table) if name in TEXT_TABLES else table

    def v(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = VIEWS[name](self)
        return self._built[name]

    def sql(self, text: str, *tables: str) -> DataFrame:
        """Run SQL whose table names are raw tables of this directory."""
        return self.spark.sql(
            _braced(text, tables), **{name: self.t(name) for name in tables}
        )


def _braced(text: str, tables: tuple[str, ...]) -> str:
    for name in tables:
        text = text.replace(f"from {name}", "from {" + name + "}")
        text = text.replace(f"join {name}", "join {" + name + "}")
    return text


def view(name: str):
    def wrap(fn):
        VIEWS[name] = fn
        return fn

    return wrap


def shared_view(name: str, sql: str, *tables: str, spread_out: bool = False) -> None:
    """A view whose text is valid in both Spark SQL and the check engine."""
    VIEWS[name] = lambda inputs: spread(inputs.sql(sql, *tables), PIECES) if spread_out else inputs.sql(sql, *tables)
    CTES[name] = (sql, ())


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (sql, deps)


def compose(sql: str, uses: tuple[str, ...]) -> str:
    """Prefix ``sql`` with the common table expressions it needs, in order."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for dep in CTES[name][1]:
            visit(dep)
        ordered.append(name)

    for name in uses:
        visit(name)
    if not ordered:
        return sql
    body = ",\n".join(f"{name} as ({CTES[name][0]})" for name in ordered)
    return f"with {body}\n{sql}"


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = (oracle, uses)
        return fn

    return wrap


def derived_view(name: str, sql: str, *deps: str, spark_names: dict[str, str] | None = None) -> None:
    """A view over other views with one text for both engines.

    ``sha256(x)`` is spelled ``sha2(x, 256)`` for Spark; ``spark_names`` maps a
    view name in the text to the Spark view that provides it.
    """
    import re

    spark_names = spark_names or {}
    spark_text = re.sub(r"sha256\(([^()]*)\)", r"sha2(\1, 256)", sql)

    def build(inputs: Inputs) -> DataFrame:
        frames = {d: inputs.v(spark_names.get(d, d)) for d in deps}
        return inputs.spark.sql(_braced(spark_text, deps), **frames)

    VIEWS[name] = build
    CTES[name] = (sql, deps)
