"""Manifests, installed licences and the two licence audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions.licenses import (
    is_unknown_license,
    licenses_compatible,
    normalize_license,
    squash_license,
)
from ..functions.scoring import license_risk_level
from .ordering import ordered_pages


def production_only(deps: DataFrame) -> DataFrame:
    return deps.filter(F.col("dep_scope") == "prod")


def merge_scopes(manifest: DataFrame) -> DataFrame:
    """One row per dependency of both scopes; the dev entry wins where a name is in both."""
    newest = F.max_by("version_range", F.struct(F.col("dep_scope") == "dev", "version_range"))
    return manifest.groupBy("project_id", "name").agg(
        newest.alias("version_range"), F.min("seq").alias("seq")
    )


def merge_deps(prod: DataFrame, dev: DataFrame) -> DataFrame:
    """The same for two tables, one per scope."""
    return merge_scopes(
        prod.withColumn("dep_scope", F.lit("prod")).unionByName(
            dev.withColumn("dep_scope", F.lit("dev"))
        )
    )


def resolve_licenses(
    manifest: DataFrame, installed: DataFrame, include_dev: bool = False
) -> DataFrame:
    """Licence of every installed dependency; dependencies not installed are left out."""
    deps = merge_scopes(manifest) if include_dev else production_only(manifest)
    license_name = F.coalesce(F.nullif(F.col("license"), F.lit("")), F.lit("UNKNOWN"))
    return deps.join(
        installed.select("name", license_name.alias("license")), "name", "inner"
    ).select("project_id", "seq", "name", F.col("version_range").alias("version"), "license")


def analyze_license(
    packages: DataFrame,
    allowed: Sequence[str] = (),
    blocked: Sequence[str] = (),
    project_license: Column | str = "UNKNOWN",
) -> DataFrame:
    """Verdict on each licence, with the reasons in a fixed order.

    The lists compare the licence as written; the matrix compares SPDX ids.
    """
    project = F.lit(project_license) if isinstance(project_license, str) else project_license
    name = F.col("license")
    quoted = F.concat(F.lit('License "'), name, F.lit('"'))
    is_blocked = name.isin(list(blocked)) if blocked else F.lit(False)
    not_allowed = ~name.isin(list(allowed)) if allowed else F.lit(False)
    mismatch = (project != "") & (name != "UNKNOWN") & ~licenses_compatible(project, name)
    issues = F.array_compact(
        F.array(
            F.when(is_blocked, F.concat(quoted, F.lit(" is explicitly blocked"))),
            F.when(not_allowed, F.concat(quoted, F.lit(" is not in the allowed list"))),
            F.when(
                mismatch,
                F.concat(
                    quoted, F.lit(' is incompatible with project license "'), project, F.lit('"')
                ),
            ),
            F.when(is_unknown_license(name), F.lit(rules.LICENSE_MISSING)),
        )
    )
    return packages.select(
        "*",
        issues.alias("issues"),
        F.coalesce(normalize_license(name), F.lit("")).alias("spdx_id"),
    ).withColumn("compatible", F.size("issues") == 0)


def incompatible_packages(licenses: DataFrame) -> DataFrame:
    return licenses.filter(~F.col("compatible"))


def unknown_license_packages(licenses: DataFrame) -> DataFrame:
    return licenses.filter(is_unknown_license(F.col("license")))


def check_package_license(
    licenses: DataFrame, name: str, version: str | None = None,
    by: Sequence[str] = ("project_id",),
) -> DataFrame:
    """Per project the first matching package of the manifest; none gives no row."""
    found = licenses.filter(F.col("name") == name)
    if version:
        found = found.filter(F.col("version") == version)
    rest = [c for c in licenses.columns if c not in by]
    first = F.min_by(F.struct(*rest), F.struct("seq", "version"))
    return found.groupBy(*by).agg(first.alias("p")).select(*by, "p.*")


def license_summary(licenses: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    return licenses.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if("compatible").alias("compatible"),
        F.count_if(~F.col("compatible")).alias("incompatible"),
        F.count_if(is_unknown_license(F.col("license"))).alias("unknown"),
        F.sum(F.size("issues")).alias("issues"),
    )


def license_recommendations(
    licenses: DataFrame, by: Sequence[str] = ("project_id",), width: int = 1000
) -> DataFrame:
    """The sentences of the compliance check, numbered in report order."""
    say = rules.LICENSE_SENTENCES
    totals = license_summary(licenses, by)

    def sentence(no: int, condition: Column, text: Column) -> Column:
        return F.struct(F.lit(no).alias("rec_no"), F.when(condition, text).alias("text"))

    def counted(mark: str, count: str, text: str) -> Column:
        return F.concat(F.lit(mark), F.col(count).cast("string"), F.lit(text))

    fixed = totals.select(
        *by,
        F.explode(
            F.array(
                sentence(1, F.col("incompatible") > 0,
                         counted("🚨 ", "incompatible", say["incompatible"])),
                sentence(2, F.col("unknown") > 0, counted("⚠️ ", "unknown", say["unknown"])),
                sentence(5, F.col("compatible") == F.col("total"), F.lit(say["clean"])),
            )
        ).alias("s"),
    ).select(*by, "s.rec_no", F.lit(0).cast("bigint").alias("page"), "s.text")

    blocked = F.exists("issues", lambda i: F.contains(i, F.lit("blocked")))
    lists = incompatible_packages(licenses).select(
        *by,
        "seq",
        "name",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(blocked, 3), F.when(is_unknown_license(F.col("license")), 4)
                )
            )
        ).alias("rec_no"),
    )
    head = F.when(F.col("rec_no") == 3, say["blocked"]).otherwise(say["investigate"])
    names = ordered_pages(lists, [*by, "rec_no"], "seq", F.col("name"), width).select(
        *by, "rec_no", "page", F.concat(head, F.array_join("items", ", ")).alias("text")
    )
    return fixed.filter(F.col("text").isNotNull()).unionByName(names)


def audit_licenses(
    deps: DataFrame,
    registry_licenses: DataFrame,
    allow: Sequence[str] = tuple(rules.AUDIT_ALLOWED_LICENSES),
    block: Sequence[str] = tuple(rules.AUDIT_RESTRICTED_LICENSES),
    mode: str = "reference",
) -> DataFrame:
    """The registry audit: list entries are searched inside the squashed licence.

    In mode ``reference`` the entries are only lower-cased, so an entry with a
    hyphen is never found; mode ``normalized`` squashes the entries as well.
    """
    if mode not in ("reference", "normalized"):
        raise ValueError(f"unknown mode {mode!r}")

    def listed(entries: Sequence[str]) -> Column:
        found = F.lit(False)
        for entry in entries:
            needle = entry.lower()
            if mode == "normalized":
                needle = "".join(c for c in needle if c.isascii() and c.isalnum())
            found = found | F.contains(F.col("squashed"), F.lit(needle))
        return found

    registry = registry_licenses.select(
        "name",
        F.coalesce(F.nullif(F.col("license"), F.lit("")), F.lit("unknown")).alias("license"),
        F.lit(True).alias("found"),
    )
    looked_up = deps.join(registry, "name", "left").select(
        "project_id",
        "seq",
        "name",
        F.col("version_range").alias("version"),
        F.coalesce("license", F.lit("unknown")).alias("license"),
        F.coalesce("found", F.lit(False)).alias("found"),
    )
    label = F.concat(F.lit("License "), F.col("license"))
    judged = looked_up.withColumn("squashed", squash_license(F.col("license"))).select(
        "*", listed(block).alias("is_blocked"), listed(allow).alias("is_allowed")
    )
    issues = F.when(
        F.col("found"),
        F.array_compact(
            F.array(
                F.when(F.col("is_blocked"), F.concat(label, F.lit(" is in the restricted list"))),
                F.when(~F.col("is_allowed"), F.concat(label, F.lit(" is not in the allowed list"))),
            )
        ),
    ).otherwise(F.array(F.lit(rules.LICENSE_UNAVAILABLE)))
    return judged.select(
        "project_id",
        "seq",
        "name",
        "version",
        "license",
        "found",
        (F.col("found") & ~F.col("is_blocked")).alias("compatible"),
        issues.alias("issues"),
    )


def license_audit_summary(licenses: DataFrame, by: Sequence[str] = ("project_id",)) -> DataFrame:
    """Totals of the registry audit; packages without an answer count as unknown only."""
    found = F.col("found")
    totals = licenses.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(found & F.col("compatible")).alias("compatible"),
        F.count_if(found & ~F.col("compatible")).alias("incompatible"),
        F.count_if(~found).alias("unknown"),
    )
    return totals.withColumn(
        "risk_level", license_risk_level(F.col("incompatible"), F.col("unknown"))
    )


def license_audit_recommendations(
    licenses: DataFrame, by: Sequence[str] = ("project_id",)
) -> DataFrame:
    """The sentences of the registry audit, numbered in report order."""
    say = rules.LICENSE_AUDIT_SENTENCES
    totals = licenses.groupBy(*by).agg(
        F.count_if(~F.col("compatible")).alias("bad"),
        F.count_if(F.col("license") == "unknown").alias("unknown"),
    )
    bad, unknown = F.col("bad"), F.col("unknown")

    def counted(text: str, count: Column) -> Column:
        before, after = text.split("{}")
        return F.concat(F.lit(before), count.cast("string"), F.lit(after))

    ordered = [
        (bad > 0, counted(say["incompatible"], bad)),
        (bad > 0, F.lit(say["review"])),
        (unknown > 0, counted(say["unknown"], unknown)),
        (unknown > 0, F.lit(say["verify"])),
        ((bad == 0) & (unknown == 0), F.lit(say["clean"])),
    ]
    structs = [
        F.struct(F.lit(i).alias("rec_no"), F.when(c, t).alias("text"))
        for i, (c, t) in enumerate(ordered, start=1)
    ]
    return (
        totals.select(*by, F.explode(F.array(*structs)).alias("s"))
        .select(*by, "s.rec_no", "s.text")
        .filter(F.col("text").isNotNull())
    )
