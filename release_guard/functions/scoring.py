"""Severities, scores, priorities and risk levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import label_map, number_text


def map_severity(raw: Column) -> Column:
    """Raw audit severity to low, moderate, high or critical."""
    return F.coalesce(label_map(rules.SEVERITY_ALIASES, F.lower(raw)), F.lit("moderate"))


def severity_rank(severity: Column) -> Column:
    return label_map(rules.SEVERITY_RANK, severity)


def vulnerability_risk(critical: Column, high: Column, moderate: Column) -> Column:
    return (
        F.when(critical > 0, "critical")
        .when(high > 2, "high")
        .when((high > 0) | (moderate > 5), "moderate")
        .otherwise("low")
    )


def security_score(critical: Column, high: Column, moderate: Column, low: Column) -> Column:
    """0 to 100; no findings give 100."""
    counts = {"critical": critical, "high": high, "moderate": moderate, "low": low}
    penalty = sum((n * rules.SCORE_WEIGHTS[k] for k, n in counts.items()), F.lit(0))
    return F.greatest(F.lit(0), F.lit(100) - penalty).cast("bigint")


def score_band(score: Column) -> Column:
    band = F.lit(rules.SCORE_BAND_FLOOR)
    for floor, mark in reversed(rules.SCORE_BANDS):
        band = F.when(score >= floor, mark).otherwise(band)
    return band


def license_risk_level(incompatible: Column, unknown: Column) -> Column:
    return (
        F.when(incompatible > 5, "critical")
        .when((incompatible > 2) | (unknown > 10), "high")
        .when((incompatible > 0) | (unknown > 5), "medium")
        .otherwise("low")
    )


def diff_risk(added_critical: Column, added_high: Column, other: Column) -> Column:
    """Risk of a change in findings; ``other`` counts the rest of added and modified."""
    return (
        F.when(added_critical > 0, "critical")
        .when(added_high > 0, "high")
        .when(other > 0, "medium")
        .otherwise("low")
    )


def overall_risk_points(
    secrets: Column, diff_risk_level: Column, incompatible: Column,
    critical: Column, high: Column, moderate: Column,
) -> Column:
    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    return (
        points(secrets > 0, 3)
        + points(diff_risk_level == "critical", 3)
        + points(diff_risk_level == "high", 2)
        + points(incompatible > 0, 1)
        + points(critical > 0, 3)
        + points(high > 0, 2)
        + points(moderate > 0, 1)
    )


def overall_risk_level(points: Column) -> Column:
    level = F.lit("low")
    for floor, name in reversed(rules.RISK_CUTOFFS):
        level = F.when(points >= floor, name).otherwise(level)
    return level


def severity_to_priority(severity: Column, tracker: str) -> Column:
    return label_map(
        {
            "low": "Low",
            "medium": "Medium",
            "high": "High",
            "critical": rules.TRACKER_TOP_PRIORITY[tracker],
        },
        severity,
    )


def audit_priority(any_critical: Column, any_high: Column, tracker: str) -> Column:
    return (
        F.when(any_critical, rules.TRACKER_TOP_PRIORITY[tracker])
        .when(any_high, "High")
        .otherwise("Medium")
    )


def license_priority(incompatible: Column) -> Column:
    return F.when(incompatible > 0, "High").otherwise("Medium")


def alert_severity(value: Column, threshold: Column) -> Column:
    limit = threshold * rules.ALERT_CRITICAL_FACTOR
    return F.when(value > limit, "critical").otherwise("warning")


def alert_message(metric_type: Column, value: Column, unit: Column) -> Column:
    return F.concat(
        F.upper(metric_type), F.lit(" usage is high: "), number_text(value), F.coalesce(unit, F.lit(""))
    )


def health_status(heap_bytes: Column) -> Column:
    return (
        F.when(heap_bytes > rules.HEAP_CRITICAL_BYTES, "critical")
        .when(heap_bytes > rules.HEAP_WARNING_BYTES, "warning")
        .otherwise("healthy")
    )


def cvss_or_null(cvss: Column) -> Column:
    """Score and vector of a CVSS struct of variants.

    Null unless the score is a JSON number and the vector a JSON string.
    """
    score, vector = cvss["score"], cvss["vector"]
    is_number = F.schema_of_variant(score).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    is_text = F.schema_of_variant(vector) == "STRING"
    return F.when(
        is_number & is_text,
        F.struct(
            F.try_variant_get(score, "$", "double").alias("score"),
            F.try_variant_get(vector, "$", "string").alias("vector"),
        ),
    )


def metric_labels(name: Column, labels: Column) -> Column:
    """``{name, ...labels}``; a ``name`` given in the labels wins."""
    given = F.coalesce(labels, F.create_map().cast("map<string,string>"))
    return F.when(F.map_contains_key(given, "name"), given).otherwise(
        F.map_concat(F.create_map(F.lit("name"), name), F.map_filter(given, lambda k, _: k != "name"))
    )


def duration_ms(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", start, end)
