"""Registry of the checked queries: each has a Spark callable and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- finding view -------------------------------------------------------------------------------

FINDINGS_SQL = """findings AS (
  SELECT 'P' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS program,
         'SOL-' || lpad(CAST(1 + l_partkey % 90 AS VARCHAR), 3, '0') AS id,
         'T' || l_returnflag || l_linestatus AS vuln_type,
         CASE WHEN l_linestatus = 'O' THEN 'Authorization' ELSE 'Heuristic' END AS category,
         least(5, l_linenumber) AS severity,
         CASE least(5, l_linenumber) WHEN 5 THEN 'CRITICAL' WHEN 4 THEN 'HIGH' WHEN 3 THEN 'MEDIUM'
              WHEN 2 THEN 'LOW' ELSE 'INFO' END AS severity_label,
         'src/mod_' || CAST(l_partkey % 40 AS VARCHAR) || CASE WHEN l_suppkey % 7 = 0 THEN '_test.rs' ELSE '.rs' END AS location,
         CASE WHEN l_returnflag = 'N' THEN '' ELSE 'fn_' || lower(l_returnflag) || CAST(l_linenumber AS VARCHAR) END AS function_name,
         l_linenumber - 1 AS line_number,
         'qty ' || CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' for ' || l_returnflag AS description,
         CASE WHEN l_returnflag = 'A' THEN 'ctx: Context<Deposit>, authority.set_ x' WHEN l_returnflag = 'R'
              THEN 'a + b as u64 reward' ELSE 'let x = y.unwrap()' END AS vulnerable_code,
         CAST(least(95, greatest(15, l_quantity * 2)) AS INTEGER) AS confidence,
         l_orderkey AS origin,
         {'a': l_orderkey, 'b': l_linenumber, 'c': l_partkey, 'd': l_suppkey, 'e': l_extendedprice, 'f': l_quantity} AS seq
  FROM lineitem)"""


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Finding-shaped view of every line item."""
    li = table(spark, sf, "lineitem")
    sev = F.least(F.lit(5), F.col("l_linenumber"))
    flag = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("P"), F.lpad(F.col("l_suppkey").cast("string"), 6, "0")).alias("program"),
        F.concat(F.lit("SOL-"), F.lpad((F.col("l_partkey") % 90 + 1).cast("string"), 3, "0")).alias("id"),
        F.concat(F.lit("T"), flag, F.col("l_linestatus")).alias("vuln_type"),
        F.when(F.col("l_linestatus") == "O", "Authorization").otherwise("Heuristic").alias("category"),
        sev.alias("severity"),
        F.when(sev == 5, "CRITICAL").when(sev == 4, "HIGH").when(sev == 3, "MEDIUM").when(sev == 2, "LOW")
        .otherwise("INFO").alias("severity_label"),
        F.concat(
            F.lit("src/mod_"), (F.col("l_partkey") % 40).cast("string"),
            F.when(F.col("l_suppkey") % 7 == 0, "_test.rs").otherwise(".rs"),
        ).alias("location"),
        F.when(flag == "N", "").otherwise(
            F.concat(F.lit("fn_"), F.lower(flag), F.col("l_linenumber").cast("string"))).alias("function_name"),
        (F.col("l_linenumber") - 1).alias("line_number"),
        F.concat(F.lit("qty "), F.col("l_quantity").cast("int").cast("string"), F.lit(" for "), flag).alias("description"),
        F.when(flag == "A", "ctx: Context<Deposit>, authority.set_ x").when(flag == "R", "a + b as u64 reward")
        .otherwise("let x = y.unwrap()").alias("vulnerable_code"),
        F.least(F.lit(95), F.greatest(F.lit(15), F.col("l_quantity") * 2)).cast("int").alias("confidence"),
        F.col("l_orderkey").alias("origin"),
        F.struct(
            F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"),
            F.col("l_suppkey").alias("d"), F.col("l_extendedprice").alias("e"), F.col("l_quantity").alias("f"),
        ).alias("seq"),
    )


def call_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Directed call graph of all lines: supplier -> part on an accepted one, part -> supplier on any other."""
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    supp = F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    out = F.col("l_returnflag") != "A"
    li = table(spark, sf, "lineitem")
    return li.select(F.when(out, part).otherwise(supp).alias("src"), F.when(out, supp).otherwise(part).alias("dst")).distinct()


EDGES_SQL = """edges AS (SELECT DISTINCT CASE WHEN l_returnflag <> 'A' THEN 'p' || l_partkey ELSE 's' || l_suppkey END AS src,
  CASE WHEN l_returnflag <> 'A' THEN 's' || l_suppkey ELSE 'p' || l_partkey END AS dst FROM lineitem)"""


def user_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the previous event type of the same user."""
    from auditlake.operators.ordered import with_previous

    e = table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return with_previous(e, "user_id", ["ts", "event_id"], ["event_type"], F.to_date("ts"), "_prev")


def user_graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(edges, entries): observed successions of event types per user, and each user's first type."""
    steps = user_steps(spark, sf)
    edges = steps.filter("_prev is not null").select("user_id", F.col("_prev.event_type").alias("src"), F.col("event_type").alias("dst")).distinct()
    return edges, steps.filter("_prev is null").select("user_id", F.col("event_type").alias("node"))


STEPS_SQL = """steps AS (SELECT user_id, event_id, ts, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events),
 edges AS (SELECT DISTINCT user_id, prev AS src, event_type AS dst FROM steps WHERE prev IS NOT NULL),
 entries AS (SELECT user_id, event_type AS node FROM steps WHERE prev IS NULL)"""
