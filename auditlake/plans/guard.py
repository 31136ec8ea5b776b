"""Dependency guard: manifests and scripts to findings and a risk per manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.fuzzy import typosquats
from auditlake.operators.lookups import match_advisories
from auditlake.operators.scores import guard_risk
from auditlake.rules.packs import LEGIT_CARGO, LEGIT_NPM, scan_dependency_sources, scan_hooks
from auditlake.sources.manifests import read_cargo_manifests, read_npm_manifests, read_npm_scripts

COLUMNS = ["manifest", "package_name", "version", "ecosystem", "severity", "category", "title"]


def advisory_findings(deps: DataFrame, advisories: DataFrame) -> DataFrame:
    hit = match_advisories(deps, advisories)
    return hit.select(
        "manifest", F.col("name").alias("package_name"), "version", "ecosystem", F.initcap("advisory_severity").alias("severity"),
        F.lit("KnownMalicious").alias("category"), F.col("advisory_title").alias("title"))


def typosquat_findings(deps: DataFrame, legit: list[str]) -> DataFrame:
    """Names are compared once each, then joined back to the manifests that use them."""
    squats = typosquats(deps, legit)
    title = F.concat(F.lit("Possible typosquat: `"), "name", F.lit("` looks like `"), "likely_target", F.lit("`"))
    return deps.join(squats, "name").select(
        "manifest", F.col("name").alias("package_name"), "version", "ecosystem", F.lit("High").alias("severity"),
        F.lit("Typosquat").alias("category"), title.alias("title"))


def guard_findings(
    npm: DataFrame, cargo: DataFrame, advisories: DataFrame, legit_npm=LEGIT_NPM, legit_cargo=LEGIT_CARGO
) -> DataFrame:
    """npm, cargo: file_path, content of the manifests."""
    npm_deps, cargo_deps = read_npm_manifests(npm), read_cargo_manifests(cargo)
    hooks = scan_hooks(read_npm_scripts(npm)).select(
        "manifest", "package_name", "version", F.lit("npm").alias("ecosystem"), "severity", "category",
        F.concat(F.lit("Suspicious `"), "hook", F.lit("` script")).alias("title"))
    sources = scan_dependency_sources(cargo_deps).select(
        "manifest", F.col("name").alias("package_name"), "version", "ecosystem", "severity", "category", "title")
    deps = npm_deps.select("manifest", "name", "version", "ecosystem").unionByName(
        cargo_deps.select("manifest", "name", "version", "ecosystem"))
    parts = [
        advisory_findings(deps, advisories), typosquat_findings(npm_deps, legit_npm), typosquat_findings(cargo_deps, legit_cargo),
        hooks, sources,
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select(*COLUMNS)


def guard_report(findings: DataFrame) -> DataFrame:
    counts = findings.groupBy("manifest").agg(F.count(F.lit(1)).alias("findings"))
    return counts.join(guard_risk(findings, ["manifest"]), "manifest")
