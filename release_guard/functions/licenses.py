"""Licence names and the compatibility matrix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import rules
from .text import label_map


def is_unknown_license(license_name: Column) -> Column:
    return F.coalesce(license_name.isin(rules.UNKNOWN_LICENSES), F.lit(False))


def normalize_license(license_name: Column) -> Column:
    """SPDX id of a licence name; null when it is empty or unknown."""
    known = F.when((license_name != "") & ~license_name.isin(rules.UNKNOWN_LICENSES), license_name)
    return F.coalesce(label_map(rules.LICENSE_ALIASES, known), known)


def squash_license(license_name: Column) -> Column:
    """Lower case letters and digits only, the form the registry audit compares."""
    return F.regexp_replace(F.lower(license_name), "[^a-z0-9]", "")


def licenses_compatible(project_license: Column, dependency_license: Column) -> Column:
    """Whether a project may use a dependency; unknown on either side is False."""
    project = normalize_license(project_license)
    dependency = normalize_license(dependency_license)
    pairs: list[Column] = []
    for name, accepted in rules.LICENSE_COMPATIBILITY.items():
        pairs += [F.lit(name), F.array(*[F.lit(a) for a in accepted])]
    accepted = F.try_element_at(F.create_map(*pairs), project)
    verdict = F.when(accepted.isNotNull(), F.array_contains(accepted, dependency)).otherwise(
        project == dependency
    )
    return F.coalesce(verdict, F.lit(False))
