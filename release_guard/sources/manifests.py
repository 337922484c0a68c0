"""JSON documents: package manifests and audit results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.scoring import cvss_or_null, map_severity

MANIFEST_SCHEMA = "dependencies map<string,string>, devDependencies map<string,string>"
# The parts of cvss are variants: their JSON types decide whether they count.
AUDIT_SCHEMA = (
    "vulnerabilities map<string, struct<id string, title string, description string,"
    " severity string, version string, fixedIn string, cwe array<string>,"
    " cvss struct<score variant, vector variant>, references array<string>, advisory string>>"
)


def explode_manifest(df: DataFrame, include_dev: bool = False, column: str = "manifest_json") -> DataFrame:
    """One row per dependency of a manifest, in the order of the file.

    A dev entry replaces a prod entry of its name in that entry's place; the other dev entries follow. The outer
    form of ``posexplode`` keeps Spark from reading the JSON twice.
    """
    rest = [c for c in df.columns if c != column]
    empty = F.create_map().cast("map<string,string>")
    parsed = df.select(*rest, F.from_json(column, MANIFEST_SCHEMA).alias("m"))
    prod = F.coalesce("m.dependencies", empty)
    dev = F.coalesce("m.devDependencies", empty) if include_dev else empty

    def entry(name, version, scope):
        return F.struct(name.alias("name"), version.alias("version_range"), scope.alias("dep_scope"))

    def kept(e):
        replaced = F.map_contains_key(dev, e["key"])
        version = F.when(replaced, F.try_element_at(dev, e["key"])).otherwise(e["value"])
        return entry(e["key"], version, F.when(replaced, "dev").otherwise("prod"))

    dev_only = F.map_filter(dev, lambda k, _: ~F.map_contains_key(prod, k))
    entries = F.concat(
        F.transform(F.map_entries(prod), kept),
        F.transform(F.map_entries(dev_only), lambda e: entry(e["key"], e["value"], F.lit("dev"))),
    )
    rows = parsed.select(*rest, F.posexplode_outer(entries).alias("seq", "d"))
    return rows.filter(F.col("d").isNotNull()).select(
        *rest, F.col("seq").cast("bigint").alias("seq"), "d.*"
    )


def parse_audit_json(df: DataFrame, audit_time: str, column: str = "audit_json") -> DataFrame:
    """One row per vulnerable package of an audit document, defaults filled in.

    A document without vulnerabilities gives no rows. ``audit_time`` completes
    the id of entries that have none.
    """
    rest = [c for c in df.columns if c != column]
    exploded = df.select(*rest, F.from_json(column, AUDIT_SCHEMA).alias("doc")).select(
        *rest, F.posexplode_outer(F.map_entries("doc.vulnerabilities")).alias("seq", "e")
    ).filter(F.col("e").isNotNull())

    def given(name: str):
        return F.nullif(F.col(f"e.value.{name}"), F.lit(""))

    package = F.col("e.key")
    no_items = F.array().cast("array<string>")
    return exploded.select(
        *rest,
        F.col("seq").cast("bigint").alias("seq"),
        F.coalesce(
            given("id"), F.concat(F.lit("npm-"), package, F.lit(f"-{audit_time}"))
        ).alias("id"),
        F.coalesce(given("title"), F.concat(F.lit("Vulnerability in "), package)).alias("title"),
        F.coalesce(given("description"), F.lit(rules.NO_DESCRIPTION)).alias("description"),
        map_severity(F.col("e.value.severity")).alias("severity"),
        package.alias("package"),
        F.coalesce(given("version"), F.lit("unknown")).alias("version"),
        F.col("e.value.fixedIn").alias("fixed_in"),
        F.coalesce("e.value.cwe", no_items).alias("cwe"),
        cvss_or_null(F.col("e.value.cvss")).alias("cvss"),
        F.coalesce("e.value.references", no_items).alias("refs"),
        F.col("e.value.advisory").alias("advisory"),
    )
