"""Query name -> callable and query name -> DuckDB SQL, for the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(name: str, sql: str | None = None) -> Callable:
    """Registers a query; its callable takes a function from table name to DataFrame."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def stored(name: str, sql: str | None = None) -> Callable:
    """Registers a query whose callable takes the session and the folder of the tables itself."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql is not None:
            ORACLE_SQL[name] = sql
        return build

    return register


def relational(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Registers a query that both engines take as SQL; ``{table}`` stands for a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = spark_sql or sql
        used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in text}
        return spark.sql(text, **used)

    QUERIES[name] = run
    ORACLE_SQL[name] = sql.format(**{t: t for t in _TABLES})


from marginalia.plans import analysis_queries, answering_queries, bridge_queries, document_queries, evidence_queries, hits_queries, metadata_queries, ranking_queries, relational_queries, splitting_queries, table_queries  # noqa: E402,F401
