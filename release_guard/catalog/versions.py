"""Commit, version and changelog queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..fixtures import frame, with_views
from ..functions import versions as fv
from ..operators import versions as v
from ..operators.ordering import sort_versions
from ..plans.audits import version_analysis

SINCE = "2000-01-01"


def _commits(sp, sf):
    return frame(sp, sf, "fx_commits")


def _small(sp, sf):
    return frame(sp, sf, "fx_small_commits")


def _as_text(pages):
    return pages.withColumn("items", F.array_join("items", "\n"))


def _versions(sp, sf):
    """Version texts of every odd shape, from the repositories."""
    shape = F.col("version")
    odd = F.when(F.length("repo") % 3 == 0, F.concat(shape, F.lit("+build.5"))).otherwise(shape)
    return frame(sp, sf, "fx_repos").select("repo", odd.alias("version"))


def _bumped(sp, sf):
    bump = F.when(F.length("repo") % 4 == 0, "major").when(F.length("repo") % 4 == 1, "minor").when(
        F.length("repo") % 4 == 2, "patch").otherwise("none")
    return frame(sp, sf, "fx_repos").select(
        "repo", "version", bump.alias("bump"), fv.next_version(F.col("version"), bump).alias("new_version")
    )


QUERIES = {
    "parse_conventional": lambda sp, sf: v.parse_commits(_commits(sp, sf)).select(
        "seq", "type", "scope", "breaking"
    ),
    "commits_since": lambda sp, sf: v.commits_since(_commits(sp, sf), SINCE),
    "source_file_changes": lambda sp, sf: v.source_file_changes(
        frame(sp, sf, "fx_files").select("doc_id", "file")
    ),
    "version_bump": lambda sp, sf: v.version_bump(_small(sp, sf)),
    "version_reasons": lambda sp, sf: v.version_reasons(_commits(sp, sf)),
    "version_lists": lambda sp, sf: _as_text(v.version_lists(_commits(sp, sf))),
    "changelog_text": lambda sp, sf: _commits(sp, sf).select("seq", fv.changelog_text(F.col("subject")).alias("entry")),
    "changelog_section": lambda sp, sf: v.changelog_entries(_commits(sp, sf)),
    "changelog_sections": lambda sp, sf: _as_text(v.changelog_sections(_commits(sp, sf))),
    "next_version": _bumped,
    "bump_confidence": lambda sp, sf: v.with_next_version(
        v.version_bump(_small(sp, sf)), F.lit("1.2.3")
    ).select("repo", "new_version", "confidence"),
    "valid_version": lambda sp, sf: _versions(sp, sf).select(
        "repo", "version", fv.valid_version(F.col("version")).alias("valid")
    ),
    "sort_versions": lambda sp, sf: sort_versions(frame(sp, sf, "fx_repos"), "version", "repo").select(
        "repo", *[fv.version_part(F.col("version"), i).alias(n) for i, n in enumerate(["major", "minor", "patch"])]
    ),
    "version_analysis": lambda sp, sf: version_analysis(_small(sp, sf), frame(sp, sf, "fx_repos")),
}

RE = r"'^(\w+)(?:\(([^)]+)\))?(!)?:\s*(.+)$'"
PARSED = f"""parsed as (select *,
 coalesce(nullif(regexp_extract(subject, {RE}, 1), ''), 'chore') as type,
 coalesce(regexp_extract(subject, {RE}, 2), '') as scope,
 regexp_extract(subject, {RE}, 3) = '!' or contains(subject, 'BREAKING CHANGE') as breaking from src)"""
COMMITS = f"{with_views('fx_commits')}, src as (select * from fx_commits), {PARSED}"
SMALL = f"{with_views('fx_small_commits', 'fx_repos')}, src as (select * from fx_small_commits), {PARSED}"
LIST = "case when breaking then 'breaking' when type = 'feat' then 'features' when type = 'fix' then 'fixes' end"
SECTION = """case when breaking then 'breaking' when type = 'feat' then 'features'
 when type in ('fix', 'perf') then 'fixes' when type = 'docs' then 'docs' else 'chore' end"""
ENTRY = r"regexp_replace(subject, '^[^:]+:\s*', '')"
BUMPS = f"""bumps as (select repo, count(*) filter (breaking) as n_breaking,
 count(*) filter (not breaking and type = 'feat') as n_features,
 count(*) filter (not breaking and type = 'fix') as n_fixes, count(*) as n_commits,
 case max(case when breaking then 3 when type = 'feat' then 2 when type = 'fix' then 1 else 0 end)
 when 3 then 'major' when 2 then 'minor' when 1 then 'patch' else 'none' end as recommended_bump
 from parsed group by repo)"""
CONFIDENCE = """least(100, greatest(0, 50 + case when n_breaking > 0 then 20 else 0 end
 + case when n_features > 0 then 15 else 0 end + case when n_fixes > 0 then 10 else 0 end
 - case when n_breaking + n_features + n_fixes = 0 then 30 else 0 end))"""


def part(i: int) -> str:
    return f"coalesce(try_cast(string_split(version, '.')[{i}] as bigint), 0)"


def next_sql(bump: str) -> str:
    return f"""case {bump} when 'major' then concat({part(1)} + 1, '.0.0')
 when 'minor' then concat({part(1)}, '.', {part(2)} + 1, '.0')
 when 'patch' then concat({part(1)}, '.', {part(2)}, '.', {part(3)} + 1) else version end"""


BUMP_OF_REPO = """case length(repo) % 4 when 0 then 'major' when 1 then 'minor' when 2 then 'patch' else 'none' end"""

ORACLES = {
    "parse_conventional": f"{COMMITS} select seq, type, scope, breaking from parsed",
    "commits_since": f"{with_views('fx_commits')} select * from fx_commits where commit_date >= date '{SINCE}'",
    "source_file_changes": f"""{with_views('fx_files')} select doc_id, file from fx_files
 where file like '%.ts' or file like '%.js'""",
    "version_bump": f"{SMALL}, {BUMPS} select * from bumps",
    "version_reasons": f"""{COMMITS} select * from (select repo, seq, {LIST} as list, subject,
 concat(case {LIST} when 'breaking' then 'Breaking change: ' when 'features' then 'New feature: '
 else 'Bug fix: ' end, subject) as reason from parsed) where list is not null""",
    "version_lists": f"""{COMMITS} select repo, list, cast(floor(seq / 1000) as bigint) as page, count(*) as n,
 string_agg(subject, chr(10) order by seq) as items from (select *, {LIST} as list from parsed)
 where list is not null group by all""",
    "changelog_text": f"{COMMITS} select seq, {ENTRY} as entry from parsed",
    "changelog_section": f"{COMMITS} select repo, seq, {SECTION} as section, {ENTRY} as entry from parsed",
    "changelog_sections": f"""{COMMITS} select repo, section, cast(floor(seq / 1000) as bigint) as page,
 count(*) as n, string_agg(entry, chr(10) order by seq) as items
 from (select *, {SECTION} as section, {ENTRY} as entry from parsed) group by all""",
    "next_version": f"""{with_views('fx_repos')} select repo, version, {BUMP_OF_REPO} as bump,
 {next_sql(BUMP_OF_REPO)} as new_version from fx_repos""",
    "bump_confidence": f"""{SMALL}, {BUMPS} select repo, {next_sql('recommended_bump')} as new_version,
 cast({CONFIDENCE} as int) as confidence from (select *, '1.2.3' as version from bumps)""",
    "valid_version": f"""{with_views('fx_repos')} select *, regexp_matches(version,
 '^\\d+\\.\\d+\\.\\d+(-[a-zA-Z0-9.-]+)?(\\+[a-zA-Z0-9.-]+)?$') as valid from (select repo,
 case when length(repo) % 3 = 0 then version || '+build.5' else version end as version from fx_repos)""",
    "sort_versions": f"""{with_views('fx_repos')} select repo, {part(1)} as major, {part(2)} as minor,
 {part(3)} as patch from fx_repos order by 2, 3, 4, version, repo""",
    "version_analysis": f"""{SMALL}, {BUMPS}, joined as (select r.repo, r.version,
 coalesce(n_breaking, 0) as n_breaking, coalesce(n_features, 0) as n_features, coalesce(n_fixes, 0) as n_fixes,
 coalesce(n_commits, 0) as n_commits, coalesce(recommended_bump, 'none') as recommended_bump
 from fx_repos r left join bumps b using (repo))
 select *, {next_sql('recommended_bump')} as new_version, cast({CONFIDENCE} as int) as confidence from joined""",
}
