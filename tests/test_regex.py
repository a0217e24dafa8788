"""Translated patterns find in Spark what RE2 finds in DuckDB."""

import duckdb
import pytest
from pyspark.sql import functions as F

from logloom.functions.regex import UnsafePattern, python_regex, replace_all, to_java_regex

TEXTS = [
    "plain words 123 and_more", "éAb cd Straße x1", "tab\there\x0bvertical\r\nnext line\n", "a.b[c]&&d^e$f",
    "user@example.com, +628512345678", "ends with newline\n", "", "line one\nline two\n\nlast", "ABC abc Abc",
]
PATTERNS = [
    r"\bab?\b", r"(?i)\b[a-z]{2}\b", r"\s+", r"\S+$", r"^\w+", r"(?m)^\w+", r"(?m)\w+$", r"[\s,]+", r"[^\w\s]", r"[[:upper:]]+", r"[[:^alpha:]]",
    r"[]^&[]", r"[a&&b]", r"\Bb", r".+", r"(?s).+", r"(?:ab|cd)+", r"x*", r"(?P<first>\w)\w+", r"[.\[\]]", r"\d{2,}", r"\pL+", r"(?i)abc(\s+\w+)*",
    r"\b\d{2,}\b", r"\b[a-z]+\b", r"\b[a-z]?\b", r"\ba*\b", r"\w+?\b", r"\b[a-z.]+\b", r"\b(?:a|é)\w", r"a\b|\bd", r"[^a]\b", r"\b.\b",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_matches_as_re2(spark, pattern):
    wanted = [duckdb.execute("SELECT regexp_replace(?, ?, '<>', 'g')", [t, pattern]).fetchall()[0][0] for t in TEXTS]
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string").orderBy("i")
    found = [row.r for row in rows.select(replace_all(F.col("t"), to_java_regex(pattern), "<>").alias("r")).collect()]
    assert found == wanted


@pytest.mark.parametrize("pattern", [r"(\w+\s)*x", r"(a|b)+c", r"(?U)a+", r"(\w+ ?){3,}x", r"[[:nothing:]]"])
def test_refused(pattern):
    with pytest.raises(UnsafePattern):
        to_java_regex(pattern)


def test_python_form():
    assert python_regex(r"a\z").search("a") and not python_regex(r"\s").search("\x0b")
    assert not python_regex(r"[\s\w]").search("\x0b") and not python_regex(r"\w").search("é")


@pytest.mark.parametrize(
    ("pattern", "path", "found"),
    [
        (r"^\.[[:lower:]]+$", ".email", True), (r"^\.[[:lower:]]+$", ".Email", False), (r"^\.[[:^digit:]]+$", ".a1", False),
        (r"mail$", ".mail\n", False), (r"\Q.a[]\E", ".a[].b", True), (r"[[:punct:][:digit:]]x", ".]x", True), (r"a[]]b", ".a]b", True),
        (r"[a&&b]x", ".&x", True), (r"(?<n>a)b", ".ab", True), (r"\x{61}b", ".ab", True), (r"[\S]b", ". b", False),
    ],
)
def test_python_paths_match_as_re2(pattern, path, found):
    assert duckdb.execute("SELECT regexp_matches(?, ?)", [path, pattern.replace("(?<n>", "(?P<n>")]).fetchone()[0] == found
    assert bool(python_regex(pattern).search(path)) == found


def test_properties_are_refused_in_paths():
    with pytest.raises(UnsafePattern):
        python_regex(r"\pL")


LOOPS = [
    r"(\w+\.)+com", r"(\d{1,3}\.){3,}\d+", r"(?:[ab]+-)+a", r"(\.\w+)+\.com", r"(?P<n>\w+\s+)+x", r"(a{2,3}[.-]{1,2})+a", r"(?i)([a-c]+\.)+COM\b",
    r"([^.]\.){2,}a", r"\b(b+,)+b", r"(?:[[:alpha:]]{2,}-{2,})+b", r"x(\w+\.)+$", r"((?:a+)\.)b|(c+-)+a", r"([ab]{2}\.)+[abc.]", r"(\x61+\x{2e})+c",
]


@pytest.mark.parametrize("pattern", LOOPS)
def test_flat_rounds_match_as_re2(spark, pattern):
    import random

    draw = random.Random(7)
    words = ["a", "b", "aa", "ab", "aab", "c", "com", "x", ".", ".", "..", "-", "--", ",", " ", "\n", "1", "12", "123", "1234", "é", "com."]
    texts = ["".join(draw.choice(words) for _ in range(draw.randint(0, 24))) for _ in range(600)] + TEXTS
    texts += ["ip 10.0.0.255 and 1234.1.2.3.4, 1.2.3.", "a.b.com.x.com-", "1.2.3.4.5 22.33.44.55", "b,bb,b", "ab--aab--b", "a b x", "aa.-aaa-a", "x.y.com"]
    with duckdb.connect() as db:
        wanted = [db.execute("SELECT regexp_replace(?, ?, '<>', 'g')", [t, pattern]).fetchone()[0] for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    found = [row.r for row in rows.select(replace_all(F.col("t"), to_java_regex(pattern), "<>").alias("r")).collect()]
    assert found == wanted
    assert pattern.startswith("x(") or found != texts


@pytest.mark.parametrize(
    "pattern", [r"(\w+\d)+x", r"(\w+\.|a)+x", r"((\w+)\.)+x", r"(?i)([a-z]+K)+x", r"(.+,)+x", r"(\w+\.)+?x", r"(\w+\.?)+x", r"(\w{1,999}\.)+x"]
)
def test_loops_without_a_proof_stay_refused(pattern):
    with pytest.raises(UnsafePattern):
        to_java_regex(pattern)


def test_flat_rounds_need_no_stack(spark):
    # each text with its own pattern: where a pattern matches nowhere, Java tries every start of a run
    for pattern, text in ((LOOPS[0], "ab." * 400_000 + "com"), (LOOPS[1], "1.22." * 300_000 + "9")):
        rows = spark.createDataFrame([(text,)], "t string")
        assert rows.select(replace_all(F.col("t"), to_java_regex(pattern), "<>")).first()[0] == "<>"
