"""Finding files and report exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.numbers import export_rank
from auditlake.functions.text import ellipsis
from auditlake.schemas import DEFAULT_CONFIDENCE, FINDING

#: Rows that go into one exported document; larger reports become several documents.
DOCUMENT_ROWS = 5_000


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """Findings from JSON files that hold arrays of finding objects; missing confidence becomes the default."""
    df = spark.read.schema(FINDING).option("multiLine", True).json(path)
    return df.withColumn("confidence", F.coalesce("confidence", F.lit(DEFAULT_CONFIDENCE)))


def write_findings(findings: DataFrame, path: str, by: str | None = None, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Files of findings, in one folder for each value of by. Rows of a folder meet before they are written, so that a task doesn't
    leave a file in every folder; a folder of very many rows is dealt over several tasks."""
    writer = (findings.hint("rebalance", by) if by else findings).write.mode(mode)
    (writer.partitionBy(by) if by else writer).format(fmt).save(path)


def level(severity: Column) -> Column:
    return F.when(severity >= 4, "error").when(severity == 3, "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """One JSON result per finding."""
    result = F.to_json(F.struct(
        F.col("id").alias("ruleId"), level(F.col("severity")).alias("level"), export_rank(F.col("severity")).alias("rank"),
        F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(
            F.struct(F.col("location").alias("uri")).alias("artifactLocation"),
            F.struct(F.greatest(F.col("line_number"), F.lit(1)).alias("startLine")).alias("region"),
        ).alias("physicalLocation"))).alias("locations"),
    ))
    return findings.withColumn("result", result)


def sarif_rules(findings: DataFrame, by: list[str]) -> DataFrame:
    """One JSON rule per distinct id of a run."""
    rules = findings.groupBy(*by, "id").agg(F.min("vuln_type").alias("name"), F.max("severity").alias("severity"))
    rule = F.to_json(F.struct("id", "name", F.struct(level(F.col("severity")).alias("level")).alias("defaultConfiguration")))
    return rules.withColumn("rule", rule)


def _chunked(df: DataFrame, by: list[str], key: Column, rows: int) -> DataFrame:
    """Split each group into documents of about `rows` rows by a hash of the row's key."""
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("_parts"))
    return df.join(sizes, by).withColumn("part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).drop("_parts")


def to_sarif(findings: DataFrame, by: list[str], key: Column, tool: str = "auditlake", rows: int = DOCUMENT_ROWS) -> DataFrame:
    """SARIF-shaped documents, one per (run, part); a run's rules are those of the part's results."""
    parts = _chunked(sarif_results(findings), by, key, rows)
    keys = [*by, "part"]
    results = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("result")).alias("_results"))
    rules = sarif_rules(parts, keys).groupBy(*keys).agg(F.array_sort(F.collect_list("rule")).alias("_rules"))
    doc = F.concat(
        F.lit('{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"' + tool + '","rules":['), F.array_join("_rules", ","),
        F.lit(']}},"results":['), F.array_join("_results", ","), F.lit("]}]}"),
    )
    return results.join(rules, keys).select(*keys, F.size("_results").alias("n_results"), F.size("_rules").alias("n_rules"), doc.alias("document"))


def to_annotations(findings: DataFrame) -> DataFrame:
    """Code-review annotations."""
    kind = F.when(F.col("severity") >= 4, "failure").when(F.col("severity") == 3, "warning").otherwise("notice")
    at = F.greatest(F.col("line_number"), F.lit(1))
    return findings.select(
        F.col("location").alias("path"), at.alias("start_line"), at.alias("end_line"), kind.alias("annotation_level"),
        F.concat(F.lit("["), F.col("id"), F.lit("] "), F.col("vuln_type")).alias("title"), F.col("description").alias("message"))


API_DESCRIPTION, API_TEXT, API_ROWS = 1000, 500, 200


def confidence_label(confidence: Column) -> Column:
    return F.when(confidence >= 70, "confirmed").when(confidence >= 40, "likely").otherwise("possible")


def to_api_findings(findings: DataFrame, limit: int = API_ROWS, order=("seq",), text_cols=("vulnerable_code", "secure_fix")) -> DataFrame:
    """First findings of a report, long texts cut for display."""
    cut = {c: ellipsis(F.col(c), API_TEXT) for c in text_cols if c in findings.columns}
    shown = findings.withColumns({
        "description": ellipsis(F.col("description"), API_DESCRIPTION), **cut,
        "confidence_label": confidence_label(F.col("confidence"))})
    return shown.orderBy(*order).limit(limit)


def graph_to_json(nodes: DataFrame, edges: DataFrame, by: list[str], rows: int = DOCUMENT_ROWS) -> DataFrame:
    """Node and link documents per graph, split into parts when a graph is large."""
    def parts(df, kind):
        body = F.to_json(F.struct(*[c for c in df.columns if c not in by]))
        chunked = _chunked(df.withColumn("_j", body), by, F.col("_j"), rows)
        return chunked.groupBy(*by, "part").agg(F.array_sort(F.collect_list("_j")).alias("_l")).select(
            *by, F.lit(kind).alias("kind"), "part", F.size("_l").alias("n"), F.concat(F.lit("["), F.array_join("_l", ","), F.lit("]")).alias("document"))

    return parts(nodes, "nodes").unionByName(parts(edges, "links"))


def metrics_to_json(metrics: DataFrame, by: list[str], name: str = "name") -> DataFrame:
    """One JSON object per group: metric name -> its aggregated values (one row per name and group)."""
    cols = [c for c in metrics.columns if c not in (*by, name)]
    entry = F.struct(F.col(name), F.struct(*cols))
    return metrics.groupBy(*by).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("document"))


def export_invariants(mined: DataFrame, by: list[str]) -> DataFrame:
    """Invariant id -> expression per file, or per coarser by; of several expressions of one id the smallest."""
    mined = mined.groupBy(*by, "invariant_id").agg(F.min("expression").alias("expression"))
    entries = F.array_sort(F.collect_list(F.struct("invariant_id", "expression")))
    return mined.groupBy(*by).agg(F.map_from_entries(entries).alias("invariants"))
