"""Long lines, files by byte ranges, patterns as a table."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from release_guard import rules, session
from release_guard.functions import matching
from release_guard.functions.matching import Matcher, compiled, entropy_of
from release_guard.functions.text import located_matches, shannon_entropy
from release_guard.operators import secrets as s
from release_guard.plans.scan import project_scan, scan_folder, scan_lines, secret_scan
from release_guard.rules import SecretPattern
from release_guard.sources.files import number_lines, read_files, read_lines
from release_guard.streaming import jobs

KEY = "AKIA" + "7QXD4M2ZP0LK9TWB"
HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
PATTERNS = [
    *rules.DEFAULT_PATTERNS, SecretPattern("a", r"a.{1,3}b", "low", "", 0.0), SecretPattern("b", r"(?i)[x-z]+\s?\d*", "low"),
    SecretPattern("c", r"[^a-w\s]{2,}", "medium", "", 1.0), SecretPattern("d", r"x+?[zß]?", "low", "", 0.0),
]
SLOW = [SecretPattern("e", r"\bx+\b", "low", "", 0.0), SecretPattern("f", r"^.a", "high", "", 0.0), SecretPattern("g", r"(?<=b)z", "low", "", 0.0)]


def random_text(rng, size):
    parts = ["a", "b", "x", "z", "Z9", " ", "ß", "漢", "🙂", "\r", " ", "\x0b", "K", KEY, HEX, 'token = "', '"', "=", "-"]
    return "".join(rng.choice(parts) for _ in range(size))


def sort(rows):
    return sorted(map(repr, rows))


def test_hits_are_those_of_the_jvm(spark, monkeypatch):
    rng = random.Random(1)
    lines = spark.createDataFrame([(i, random_text(rng, rng.randint(0, 60))) for i in range(300)], "id int, text string")
    jobs_ = [lambda: s.match_patterns(lines, PATTERNS), lambda: s.high_entropy_tokens(lines, 2.0, PATTERNS[:2]), lambda: s.all_hits(lines, PATTERNS)]
    fast = [sort(job().collect()) for job in jobs_]
    for module in (s, matching):
        monkeypatch.setattr(module, "portable", lambda regex: regex == rules.TOKEN_REGEX)
    assert [sort(job().collect()) for job in jobs_] == fast and all(fast)


def test_slow_and_fast_patterns_together(spark):
    rng = random.Random(2)
    texts = [random_text(rng, 30) for _ in range(200)]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    found = [(r["id"], r["pattern_name"], r["column"], r["value"]) for r in s.match_patterns(lines, [*SLOW, *PATTERNS]).collect()]
    for p in (*SLOW[1:], PATTERNS[4]):
        wanted = {(i, p.name, m.start() + 1, m[0]) for i, t in enumerate(texts) for m in re.finditer(p.regex.replace(".", matching._NOT_LINE_END), t, re.ASCII)}
        assert {f for f in found if f[1] == p.name} == wanted and wanted


def test_entropy_is_that_of_the_column_function(rows):
    values = ["", "a", "ab", HEX, KEY, "漢字漢", "🙂a", "x" * 999]
    found = rows("v string", *[(v,) for v in values]).select("v", F.round(shannon_entropy(F.col("v")), 6).alias("e")).collect()
    assert {r["v"]: r["e"] for r in found} == {v: entropy_of(v) for v in values}


def test_compiled_dot_and_classes():
    assert compiled(r"a.c").search("a\rc") is None and compiled(r"[.]").search("x") is None and compiled(r"\.").search("a.")
    assert compiled(r"(?i)k").search("K") is None and compiled(r"\w").search("ß") is None


def test_overlapping_tokens_are_left_out():
    matcher = Matcher((SecretPattern("n", r"key=[a-z]+", "low", "", 0.0),), tokens=True)
    text = "A" * 25 + " key=" + "b" * 30 + " " + "C" * 22
    assert [(h[0], h[2]) for h in matcher.hits(text)] == [(27, "n"), (1, rules.TOKEN_PATTERN_NAME), (62, rules.TOKEN_PATTERN_NAME)]


def test_long_line_in_linear_time_with_short_contexts(spark):
    piece = f'{KEY} {HEX} token = "abcdefgh12" -- '
    lines = spark.range(1).select(F.lit("f").alias("file"), F.lit(1).alias("line"), F.repeat(F.lit(piece), 100_000).alias("text"))
    start = time.perf_counter()
    found = s.all_hits(lines, rules.DEFAULT_PATTERNS).agg(
        F.count("*").alias("n"), F.max(F.length("context")).alias("longest"), F.max("column").alias("last")
    ).first()
    assert found["n"] == 300_000 and found["longest"] == rules.CONTEXT_BEFORE + rules.CONTEXT_AFTER
    assert found["last"] > 99_999 * len(piece) and time.perf_counter() - start < 60


def test_jvm_positions_in_a_long_line(spark):
    lines = spark.range(1).select(F.repeat(F.lit("ab cd "), 50_000).alias("text"))
    found = lines.select(located_matches("text", "cd").alias("h")).select(
        F.size("h").alias("n"), F.element_at("h", -1)["column"].alias("last"), F.element_at("h", 257)["column"].alias("mid")
    ).first()
    assert tuple(found) == (50_000, 299_998, 256 * 6 + 4)


FILES = {
    "a/one.txt": "first\r\nsecond\n" + f"x {KEY}\r\n\r\nlast {KEY}\r",
    "a/two.txt": f"{KEY}\n" * 400 + "end",
    "b/long.txt": "y" * 50_000 + f" {KEY} " + "z " * 3000 + "\nnext\n" + f"{HEX}\n",
    "b/empty.txt": "",
    "b/lines.txt": "\n\n\n" + f'password = "{HEX}"\n',
    "b/umlaut ä+%.txt": "ä漢🙂 " + KEY,
    "c/skip.bin": KEY,
    "node_modules/x.txt": KEY,
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "root" / "b" / "mark.txt").write_bytes(b"\xef\xbb\xbfone\n" + KEY.encode() + b"\r")
    (tmp_path / "root" / "b" / "broken.txt").write_bytes(b"\xff\xfe " + KEY.encode() + b"\n")
    return str(tmp_path / "root")


@pytest.fixture(params=["700", "128m"])
def ranges(spark, request):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "0")
    yield
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


def test_lines_have_their_numbers(spark, folder, ranges):
    found = {}
    for r in number_lines(read_lines(spark, folder, include=["**/*.txt"])).collect():
        found.setdefault(r["file"], {})[r["line"]] = r["text"]
    for name, text in FILES.items():
        wanted = dict(enumerate(re.split("\r?\n", text), 1)) if text else {}
        if text.endswith("\n"):
            wanted.popitem()
        if name.endswith(".txt") and not name.startswith("node"):
            assert found.pop(name, {}) == wanted, name
    assert found.pop("b/mark.txt") == {1: "one", 2: KEY + "\r"}
    assert found.pop("b/broken.txt")[1].endswith(KEY) and not found


def test_folder_scan_is_the_scan_of_whole_files(spark, folder, ranges):
    include = ["**/*.txt"]
    columns = ["file", "line", "column", "value", "pattern_name", "severity", "entropy", "context"]
    whole = secret_scan(read_files(spark, folder, include).where("file <> 'b/mark.txt'")).select(columns)
    by_range = scan_folder(spark, folder, include=include).where("file <> 'b/mark.txt'").select(columns)
    assert sort(by_range.withColumn("line", F.col("line").cast("int")).collect()) == sort(whole.collect())
    assert whole.count() > 400 and scan_folder(spark, folder, include=["none"]).count() == 0
    slow = scan_lines(read_lines(spark, folder, include), [SecretPattern("w", r"\bnext\b", "low", "", 0.0)])
    assert [(r["file"], r["line"]) for r in slow.where("pattern_name = 'w'").collect()] == [("b/long.txt", 2)]


def test_folder_stream_in_several_batches(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    lines = read_lines(spark, folder, ["**/*.txt"], stream=True)
    jobs.run_available(lines, jobs.scan_folder_batch(out), str(tmp_path / "check")).awaitTermination()
    (tmp_path / "root" / "later.txt").write_text(f"1\n2\n{KEY}\n")
    jobs.run_available(lines, jobs.scan_folder_batch(out), str(tmp_path / "check")).awaitTermination()
    found = spark.read.parquet(out)
    assert [r["batch"] for r in found.select("batch").distinct().orderBy("batch").collect()] == [0, 1]
    assert [r["line"] for r in found.where("file = 'later.txt'").collect()] == [3]
    assert found.count() == scan_folder(spark, folder, include=["**/*.txt"]).count()


PATTERN_ROWS = "project_id long, seq long, name string, regex string, severity string, entropy double"


def test_every_project_has_its_own_patterns(spark, rows):
    rng = random.Random(3)
    own = {
        1: [SecretPattern("one", r"a+b", "low", "", 0.0), SecretPattern("two", r"\bx+\b", "high", "", 0.0)],
        2: [SecretPattern("one", r"z+", "medium", "", None)],
        3: [],
        None: [SecretPattern("odd", r"ß", "low", "", 0.0)],
    }
    table = [(p, i, x.name, x.regex, x.severity, x.entropy) for p, listed in own.items() for i, x in enumerate(listed)]
    table += [(3, 9, "none", None, "low", None), (77, 1, "absent", "q", "low", 0.0)]
    files = rows(
        "project_id long, file string, content string",
        *[(p, f"{p}/{i}", "\n".join(random_text(rng, 20) for _ in range(3))) for p in own for i in range(20)],
        (1, "null", None), (4, "unlisted", f"{KEY} zzz"),
    )
    found = project_scan(files, rows(PATTERN_ROWS, *table)).collect()
    wanted = []
    for project, listed in [*own.items(), (4, [])]:
        mine = files.where(F.col("project_id").eqNullSafe(F.lit(project)))
        wanted += secret_scan(mine, [*rules.DEFAULT_PATTERNS, *listed]).select(found[0].__fields__).collect()
    assert sort(found) == sort(wanted)
    assert {r["pattern_name"] for r in found} >= {"one", "two", "odd", "AWS Access Key", rules.TOKEN_PATTERN_NAME}
    none = project_scan(files, rows(PATTERN_ROWS), default=[])
    assert {r["pattern_name"] for r in none.collect()} == {rules.TOKEN_PATTERN_NAME}


def test_short_pattern_lists_and_allow_lists_leave_files_and_findings_in_place(spark, rows):
    """Joins without a shuffle of files or findings; a regex that many patterns share is looked for once and found for each."""
    listed = [(1, i, f"own {i}", regex, "low", 0.0) for i, regex in enumerate([r"a+b", r"\bx+\b"] * 20)]
    files = rows("project_id long, file string, content string", (1, "f", "aab\nxx aab"), (2, "g", "aab"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = project_scan(files, rows(PATTERN_ROWS, *listed), allowed=rows("value string", ("zz",)))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert sorted((r["line"], r["pattern_name"]) for r in found.collect()) == sorted(
            [(line, f"own {i}") for i in range(0, 40, 2) for line in (1, 2)] + [(2, f"own {i}") for i in range(1, 40, 2)])
        assert project_scan(files, rows(PATTERN_ROWS, *listed), allowed=rows("value string", ("aab",))).count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


@pytest.mark.parametrize("short", [True, False])
def test_files_wait_for_no_function_with_their_pattern_list(spark, rows, monkeypatch, short):
    """No function in a filter or column, for which Spark keeps rows with long lists on disk; patterns of one regex keep their own limits."""
    if not short:
        monkeypatch.setattr(session, "SMALL_BYTES", -1)
    listed = [
        SecretPattern("low", r"[a-d]+;", "low", "", 1.0), SecretPattern("high", r"[a-d]+;", "high", "", 2.2), SecretPattern("high", r"[a-d]+;", "high", "", 2.2),
        SecretPattern("word", r"\ba+\b", "low", "", 0.0), SecretPattern(None, r"\ba+\b", None, "", 0.0), SecretPattern("never", r"\ba+\b", "low", "", 9.0),
        SecretPattern("other", r"z+", "low", "", None), SecretPattern("nan", r"z+", "low", "", float("nan")), SecretPattern("same", r"z+", "low", "", 0.0),
        SecretPattern("key again", rules.DEFAULT_PATTERNS[0].regex, "low", "", 0.0), *[SecretPattern(f"no {i}", f"q{i}q", "low", "", 0.0) for i in range(300)],
    ]
    table = [(p, i, x.name, x.regex, x.severity, x.entropy) for p in (1, 2, None) for i, x in enumerate(listed)]
    text = f"aab; abcd; aa\r\n{KEY} zzz q7q {HEX}\naa aab;"
    files = rows("project_id long, file string, content string", *[(p, f"{p}/f", text) for p in (1, 2, None, 4)], (1, "null", None))
    allowed = rows("value string", ("q7q",), ("aab;",))
    found = project_scan(files, rows(PATTERN_ROWS, *table), allowed=allowed)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert not short or "patterns#" not in plan
    every = [secret_scan(files.where(F.col("project_id").eqNullSafe(F.lit(p))), [*rules.DEFAULT_PATTERNS, *own]) for p, own in ((1, listed), (2, listed), (None, listed), (4, []))]
    wanted = [r for one in every for r in s.apply_allowlist(one, allowed).select(found.columns).collect()]
    assert sort(found.collect()) == sort(wanted)
    names = [r["pattern_name"] for r in wanted if r["project_id"] == 1]
    assert names.count(None) == 2 and names.count("word") == 2 and names.count("key again") == names.count("AWS Access Key") == 1 and "never" not in names
    # Hits below the limit of one pattern stay for others.
    few = project_scan(files, rows(PATTERN_ROWS, *table))
    assert few.where("project_id = 1 and value = 'aab;'").select("pattern_name").collect() == [("low",)] * 2
    every_one = project_scan(files, rows(PATTERN_ROWS, *table), threshold=None).where("project_id = 1 and value = 'aab;'")
    assert sorted(r[0] for r in every_one.select("pattern_name").collect()) == ["high"] * 4 + ["low"] * 2


def test_whole_lines_as_context(rows):
    """The context is the line however long it is and wherever the hit, also of a line with many hits."""
    line = "p" * 700 + f' {KEY} mail me@example.org ' + "q" * 900 + f' token = "abcdefgh12"'
    files = rows("project_id long, file string, content string", (1, "a.txt", f"first\n{line}\r\nlast"), (2, "b.txt", "nothing"))
    found = secret_scan(files, whole_lines=True).collect()
    assert len(found) >= 2 and {r["context"] for r in found} == {line} and {r["line"] for r in found} == {2}
    short = secret_scan(files).drop("context").collect()
    assert sorted(secret_scan(files, whole_lines=True).drop("context").collect()) == sorted(short)
    mail = [SecretPattern("E-mail", r"[A-Za-z0-9._]+@[A-Za-z0-9-]+\.[a-z]{2,}", "low", "", 2.0)]
    assert [r["context"] for r in s.match_patterns(s.split_lines(files), mail, whole_lines=True).collect()] == [line]


def test_registered_scans_give_whole_lines(spark, tmp_path):
    from release_guard.catalog import secrets as queries

    line = "w" * 500 + f" {KEY} to 10.20.30.40 " + "v" * 800
    spark.createDataFrame([(1, line, "src1", len(line))], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", line)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("secret_scan", "scan_documents", "user_patterns"):
        found = queries.QUERIES[name](spark, str(tmp_path)).select("context").distinct().collect()
        assert line in {r["context"] for r in found}, name
