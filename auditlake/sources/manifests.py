"""Dependency manifests as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.text import line_array
from auditlake.schemas import ADVISORY, NPM_MANIFEST

SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def read_npm_manifests(df: DataFrame, text: str = "content", path: str = "file_path") -> DataFrame:
    """Dependencies of package manifests: manifest, package, section, name, version, ecosystem.
    Manifests below node_modules/ and unreadable ones are left out."""
    own = df.filter(~F.contains(path, F.lit("node_modules/"))).select(
        F.col(path).alias("manifest"), F.from_json(text, NPM_MANIFEST).alias("_m"))
    sections = F.filter(
        F.array(*[F.struct(F.lit(s).alias("section"), F.col(f"_m.{s}").alias("deps")) for s in SECTIONS]),
        lambda x: x["deps"].isNotNull(),
    )
    rows = own.select("manifest", F.col("_m.name").alias("package"), F.inline(sections))
    return rows.select("manifest", "package", "section", F.explode("deps").alias("name", "_v")).select(
        "manifest", "package", "section", "name", F.coalesce("_v", F.lit("*")).alias("version"), F.lit("npm").alias("ecosystem"))


def read_npm_scripts(df: DataFrame, text: str = "content", path: str = "file_path") -> DataFrame:
    """Lifecycle scripts: manifest, package_name, version, hook, script."""
    own = df.filter(~F.contains(path, F.lit("node_modules/"))).select(
        F.col(path).alias("manifest"), F.from_json(text, NPM_MANIFEST).alias("_m"))
    return own.select(
        "manifest", F.coalesce("_m.name", F.lit("unknown")).alias("package_name"), F.coalesce("_m.version", F.lit("0.0.0")).alias("version"),
        F.explode("_m.scripts").alias("hook", "script"))


#: Sections that list dependencies, also per target and for the workspace.
CARGO_SECTION = r"^\[(?:workspace\.|target\.[^\]]+\.)?((?:dev-|build-)?dependencies)(?:\.([\w-]+))?\]"


def read_cargo_manifests(df: DataFrame, text: str = "content", path: str = "file_path") -> DataFrame:
    """Dependencies of Cargo manifests: manifest, section, name, version, path, git, ecosystem.

    The text is cut at section headers inside its row, so a line knows its section without a window.
    Version is '*' where none is given.
    """
    blocks = df.select(F.col(path).alias("manifest"), F.explode(F.split(F.col(text), r"(?m)^(?=\[)")).alias("_b"))
    section = F.regexp_extract("_b", CARGO_SECTION, 1)
    table = F.regexp_extract("_b", CARGO_SECTION, 2)
    blocks = blocks.select("manifest", section.alias("section"), table.alias("_table"), "_b").filter("section <> ''")
    inline = blocks.filter("_table = ''").select("manifest", "section", F.explode(line_array(F.col("_b"))).alias("_l"))
    name = F.regexp_extract("_l", r"^\s*\"?([\w-]+)\"?\s*(?:\.[\w-]+\s*)?=", 1)
    rows = inline.select("manifest", "section", name.alias("name"), F.col("_l").alias("_v")).filter("name <> ''")
    tables = blocks.filter("_table <> ''").select("manifest", "section", F.col("_table").alias("name"), F.col("_b").alias("_v"))
    value = lambda key: F.nullif(F.regexp_extract("_v", rf"\b{key}\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract("_v", r"^\s*\"?[\w-]+\"?\s*=\s*\"([^\"]*)\"", 1), F.lit(""))
    parsed = rows.select("manifest", "section", "name", F.coalesce(plain, value("version"), F.lit("*")).alias("version"),
                         value("path").alias("path"), value("git").alias("git"))
    from_tables = tables.select("manifest", "section", "name", F.coalesce(value("version"), F.lit("*")).alias("version"),
                                value("path").alias("path"), value("git").alias("git"))
    return parsed.unionByName(from_tables).withColumn("ecosystem", F.lit("cargo"))


def framework_version(deps: DataFrame, package: str = "anchor-lang", by: str = "manifest") -> DataFrame:
    """Version of the framework each manifest depends on, 'unknown' when it does not."""
    found = F.max(F.when(F.col("name") == package, F.col("version")))
    return deps.groupBy(by).agg(F.coalesce(found, F.lit("unknown")).alias("framework_version"))


def read_advisories(spark: SparkSession, path: str) -> DataFrame:
    """Advisory feed: a document with an `advisories` list."""
    feed = spark.read.schema(f"advisories ARRAY<STRUCT<{_fields(ADVISORY)}>>").option("multiLine", True).json(path)
    return feed.select(F.inline("advisories"))


def _fields(ddl: str) -> str:
    return ", ".join(p.strip().replace(" ", ": ", 1) for p in ddl.split(","))
