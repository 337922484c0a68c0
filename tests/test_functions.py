"""Hand-made cases for the column functions."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from release_guard import rules
from release_guard.functions import licenses, prefilter, scoring, text, versions


def values(frame, *columns):
    return [tuple(r) for r in frame.select(*columns).collect()]


def one(frame, column):
    return [r[0] for r in frame.select(column).collect()]


def test_entropy(rows):
    df = rows("v string", ("24be64439e3e49cf46b2d7c90f3602a3d0b907ff",), ("aaaa",), ("ab",), ("",), (None,))
    found = one(df, text.shannon_entropy(F.col("v")))
    assert round(found[0], 6) == 3.606198
    assert found[1:] == [0.0, 1.0, 0.0, None]


def test_entropy_counts_characters_not_bytes(rows):
    assert one(rows("v string", ("äöäö",)), text.shannon_entropy(F.col("v"))) == [1.0]


@pytest.mark.parametrize(
    "line,regex",
    [
        ("xabb ab abb", "ab+"),
        ("abab ab", r"\bab\b"),
        ("foo1 foo2 foo1", r"(?<=foo2 )foo\d"),
        ("ab", "ab"),
        ("ääab ab", "ab"),
        ("none", "ab"),
    ],
)
def test_positions(rows, line, regex):
    found = one(rows("t string", (line,)), text.located_matches("t", regex))[0]
    expected = [(m.start() + 1, m.group()) for m in re.finditer(regex, line)]
    assert [(h["column"], h["value"]) for h in found] == expected


def test_number_text(rows):
    df = rows("v double", (85.0,), (12.31,), (123456789.5,), (0.0001,), (1e12,), (1e27,), (80.1234567890123,), (-2.5e-7,), (1e20,), (0.0,), (1.5e21,))
    assert one(df, text.number_text(F.col("v"))) == ["85", "12.31", "123456789.5", "0.0001", "1000000000000",
        "1e+27", "80.1234567890123", "-2.5e-7", "100000000000000000000", "0", "1.5e+21"]


@pytest.mark.parametrize(
    "glob,path,hit",
    [
        ("**/*", "a.ts", True), ("**/*", "a/b/c.ts", True), ("*.ts", "a/b.ts", False),
        ("src/**/*.ts", "src/x.ts", True), ("src/**/*.ts", "src/a/b/x.ts", True),
        ("node_modules/**", "node_modules/a/b.js", True), ("node_modules/**", "src/node_modules.js", False),
        ("a?.js", "ab.js", True), ("a.js", "axjs", False),
    ],
)
def test_globs(rows, glob, path, hit):
    assert one(rows("p string", (path,)), text.matches_any_glob(F.col("p"), [glob])) == [hit]


def test_no_glob_matches_nothing(rows):
    assert one(rows("p string", ("a",)), text.matches_any_glob(F.col("p"), [])) == [False]


def test_map_severity(rows):
    df = rows("s string", ("CRITICAL",), ("High",), ("medium",), ("info",), ("odd",), (None,))
    assert one(df, scoring.map_severity(F.col("s"))) == ["critical", "high", "moderate", "low", "moderate", "moderate"]


def test_vulnerability_risk_edges(rows):
    df = rows("c int, h int, m int", (1, 0, 0), (0, 3, 0), (0, 2, 0), (0, 0, 6), (0, 0, 5), (0, 0, 0))
    assert one(df, scoring.vulnerability_risk(F.col("c"), F.col("h"), F.col("m"))) == [
        "critical", "high", "moderate", "moderate", "low", "low"]


def test_score_and_band(rows):
    df = rows("c int, h int, m int, l int", (0, 0, 0, 0), (0, 1, 0, 0), (0, 1, 0, 1), (1, 1, 1, 0), (9, 0, 0, 0))
    score = scoring.security_score(*[F.col(c) for c in "chml"])
    assert values(df, score, scoring.score_band(score)) == [
        (100, "🟢"), (90, "🟢"), (89, "🟡"), (65, "🟠"), (0, "🔴")]


def test_license_risk_edges(rows):
    cases = [(0, 0), (1, 0), (2, 0), (3, 0), (5, 0), (6, 0), (0, 5), (0, 6), (0, 10), (0, 11)]
    df = rows("b int, u int", *cases)
    assert one(df, scoring.license_risk_level(F.col("b"), F.col("u"))) == [
        "low", "medium", "medium", "high", "high", "critical", "low", "medium", "medium", "high"]


def test_overall_risk(rows):
    df = rows("s int, d string, i int, c int, h int, m int",
              (1, "critical", 0, 0, 0, 0), (1, "low", 1, 0, 0, 0), (0, "high", 0, 0, 0, 0), (0, "low", 1, 0, 0, 0))
    points = scoring.overall_risk_points(*[F.col(c) for c in "sdichm"])
    assert values(df, points, scoring.overall_risk_level(points)) == [
        (6, "critical"), (4, "high"), (2, "medium"), (1, "low")]


def test_alert_edges(rows):
    df = rows("v double, t double", (120.0, 80.0), (120.01, 80.0))
    assert one(df, scoring.alert_severity(F.col("v"), F.col("t"))) == ["warning", "critical"]


def test_health_edges(rows):
    mib = 1024 * 1024
    df = rows("v bigint", (500 * mib,), (500 * mib + 1,), (1024 * mib,), (1024 * mib + 1,))
    assert one(df, scoring.health_status(F.col("v"))) == ["healthy", "warning", "warning", "critical"]


def test_priorities(rows):
    df = rows("s string", ("low",), ("medium",), ("high",), ("critical",))
    assert one(df, scoring.severity_to_priority(F.col("s"), "linear")) == ["Low", "Medium", "High", "Urgent"]
    assert one(df, scoring.severity_to_priority(F.col("s"), "jira"))[-1] == "Highest"


def test_metric_labels(rows):
    df = rows("n string, l map<string,string>", ("cpu", {"host": "a"}), ("cpu", {"name": "own"}), ("cpu", None))
    assert one(df, scoring.metric_labels(F.col("n"), F.col("l"))) == [
        {"name": "cpu", "host": "a"}, {"name": "own"}, {"name": "cpu"}]


SUBJECTS = [
    ("feat(api)!: x", "feat", "api", True, "x", "breaking"),
    ("fix: a | b", "fix", "", False, "a | b", "fixes"),
    ("perf(core): fast", "perf", "core", False, "fast", "fixes"),
    ("Merge: y", "Merge", "", False, "y", "chore"),
    ("note: BREAKING CHANGE z", "note", "", True, "BREAKING CHANGE z", "breaking"),
    ("docs: a: b", "docs", "", False, "a: b", "docs"),
    ("plain words", "chore", "", False, "plain words", "chore"),
    ("", "chore", "", False, "", "chore"),
]


def test_commits(rows):
    s = F.col("s")
    df = rows("s string", *[(c[0],) for c in SUBJECTS])
    kind, breaking = versions.commit_type(s), versions.commit_breaking(s)
    found = values(df, s, kind, versions.commit_scope(s), breaking, versions.changelog_text(s),
                   versions.changelog_section(kind, breaking))
    assert found == SUBJECTS


def test_null_subject(rows):
    s = F.col("s")
    found = values(rows("s string", (None,)), versions.commit_type(s), versions.commit_scope(s),
                   versions.commit_breaking(s))
    assert found == [("chore", "", False)]


@pytest.mark.parametrize(
    "version,bump,result",
    [
        ("1.2.3", "major", "2.0.0"), ("1.2.3", "minor", "1.3.0"), ("1.2.3", "patch", "1.2.4"),
        ("1.2.3", "none", "1.2.3"), ("1.2.3-beta", "patch", "1.2.1"), ("1.2", "patch", "1.2.1"),
        ("abc", "major", "1.0.0"), ("abc", "minor", "0.1.0"),
    ],
)
def test_next_version(rows, version, bump, result):
    df = rows("v string, b string", (version, bump))
    assert one(df, versions.next_version(F.col("v"), F.col("b"))) == [result]


def test_valid_version(rows):
    df = rows("v string", ("1.2.3",), ("1.2.3-beta",), ("1.2",), ("abc",), ("1.2.3+build.5",), ("1.2.3 ",))
    assert one(df, versions.valid_version(F.col("v"))) == [True, True, False, False, True, False]


def test_confidence(rows):
    df = rows("b int, f int, x int", (0, 0, 0), (1, 1, 1), (0, 1, 0), (0, 0, 9))
    assert one(df, versions.bump_confidence(F.col("b"), F.col("f"), F.col("x"))) == [20, 95, 65, 60]


@pytest.mark.parametrize(
    "project,dependency,fits",
    [
        ("MIT", "BSD", True), ("MIT", "GPLv3", False), ("GPL-2.0", "GPLv3", True), ("Apache License 2.0", "ISC", True),
        ("UNKNOWN", "MIT", False), ("MIT", "undefined", False), ("CC0-1.0", "CC0-1.0", True),
        ("CC0-1.0", "MIT", False), ("MIT", None, False),
    ],
)
def test_license_matrix(rows, project, dependency, fits):
    df = rows("p string, d string", (project, dependency))
    assert one(df, licenses.licenses_compatible(F.col("p"), F.col("d"))) == [fits]


def test_license_names(rows):
    df = rows("l string", ("BSD",), ("GPLv2",), ("WTFPL",), ("",), ("UNKNOWN",), (None,))
    assert one(df, licenses.normalize_license(F.col("l"))) == ["BSD-3-Clause", "GPL-2.0", "WTFPL", None, None, None]


@pytest.mark.parametrize(
    "regex,expected",
    [
        (r"AKIA[0-9A-Z]{16}", True), (rules.TOKEN_REGEX, True), (r"[^a]b", True), (r"^a", False), (r"a$", False),
        (r"\bab\b", False), (r"(?=a)b", False), (r"a++", False), (r"(a)\1", False), (r"(?i)abc\s", True),
        (r"id [a-z[0-9]]{8}", False), (r"(?U)pw=\w{4}", False), (r"[[:alpha:]]{4}", False), (r"[]a]b", False), (r"a{2}+", False),
        (r"(?i)[^a]b", False), (r"[a&&b]", False), (r"(?s).", False), (r"(?<n>a)", False), (r"\x41", False), (r"a{,3}", False),
        (r"(?:ab|c[d-f]+?){2,5}\.x", True),
    ],
)
def test_portable(regex, expected):
    assert prefilter.portable(regex) is expected


def test_prefilter_never_loses_a_match(rows):
    """Brute force: wherever the JVM regex matches, the first test lets the text through."""
    alphabet = ["token", " ", "=", '"', "\x0b", " ", "abcdefgh", "é", "ſ", "\t", "SECRET", ":", "12345678"]
    texts = ["".join(alphabet[(i * 7 + j * (i % 5 + 1)) % 13] for j in range(i % 9)) for i in range(400)]
    df = rows("t string", *[(t,) for t in texts], ('token\x0b= "abcdefgh"',))
    wanted = [p.regex for p in rules.DEFAULT_PATTERNS] + [r"\btoken\b", r"^SECRET"]
    exact = F.lit(False)
    for regex in wanted:
        exact = exact | F.col("t").rlike(regex)
    lost = df.filter(exact & ~prefilter.may_match(F.col("t"), wanted))
    assert df.filter(exact).count() > 0
    assert lost.count() == 0


def test_prefilter_never_loses_a_match_of_many_regexes(rows):
    """Regexes put together at random from the syntax of both dialects."""
    import random

    draw = random.Random(5)
    pieces = ["a", "b", "é", "K", ".", "\\w", "\\s", "\\d", "\\S", "[a-c]", "[^a]", "[a-z[0-9]]", "[[:alpha:]]", "(?i)", "(?U)", "(a|b)", "(?:b1)", " ", "\\.", "1"]
    ends = ["", "", "+", "*", "?", "{2}", "{1,2}", "+?", "*+"]
    regexes = ["".join(draw.choice(pieces) + draw.choice(ends) for _ in range(draw.randint(1, 4))) for _ in range(120)]
    regexes = [r for r in regexes if not re.search(r"\)[+*?{]|\A\(\?.\)[+*?{]|(?<!^)\(\?[iU]", r)] + [r"(?U)pw=\w{4}", r"id [a-z[0-9]]{8}"]
    texts = ["".join(draw.choices(["a", "b", "c", "é", "K", "k", "1", " ", ".", "\x0b", "A", "\n", "ſ"], k=draw.randint(0, 8))) for _ in range(150)]
    df = rows("t string", *[(t,) for t in [*texts, "pw=éééé", "id abc12345 x"]]).cache()
    for regex in regexes:
        assert df.filter(F.col("t").rlike(regex) & ~prefilter.may_match(F.col("t"), [regex])).count() == 0, regex


def test_entropy_matches_brute_force(rows):
    words = ["".join("abcdefghij"[(i * k) % 10] for k in range(1 + i % 30)) for i in range(1, 200)]

    def brute(word):
        counts = [word.count(c) / len(word) for c in set(word)]
        return -sum(p * math.log2(p) for p in counts)

    df = rows("w string", *[(w,) for w in words])
    for word, found in values(df, "w", text.shannon_entropy(F.col("w"))):
        assert found == pytest.approx(brute(word), abs=1e-9)
