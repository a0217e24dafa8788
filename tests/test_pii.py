import pytest
from pyspark.sql import functions as F

from logloom.functions import pii

CASES = [
    ('{"contact":"lena.k@posteo.example"}', '{"contact":"[REDACTED]"}'),
    ('{"born":"11/05/1987"}', '{"born":"[REDACTED]"}'),
    ('{"seen":["2001-07-19","soon"],"n":null}', '{"n":null,"seen":["[REDACTED]","soon"]}'),
    ('{"a":{"b":{"born":"2011-03-02"}}}', '{"a":{"b":{"born":"[REDACTED]"}}}'),
    ('{"month":"1999-04"}', '{"month":"1999-04"}'),
    ('{"state":"unknown"}', '{"state":"unknown"}'),
    ('{"sex":"female"}', '{"sex":"[REDACTED]"}'),
    ('{"call":"415-555-0132"}', '{"call":"[REDACTED]"}'),
    ('{"id":123456789012,"small":7,"none":null,"yes":true}', '{"id":"[REDACTED]","none":null,"small":"7","yes":true}'),
    ('["2011-03-02"]', None),
    ("no json", None),
    (None, None),
]


def test_json_values(spark):
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(CASES)], "i int, t string")
    found = {row.i: row.r for row in rows.select("i", pii.redact_pii_json(F.col("t")).alias("r")).collect()}
    wanted = {i: w for i, (_, w) in enumerate(CASES)}
    assert found == wanted


def test_short_numbers_hide_identifiers_from_the_patterns(spark):
    row = spark.createDataFrame([('{"id":1234567890,"f":0.5}',)], "t string")
    assert row.select(pii.redact_pii_json(F.col("t"), "short").alias("r")).first().r == '{"f":"0.5","id":"1.23456789e+09"}'


@pytest.mark.parametrize("text", ["ab " * 200_000, "road 12 " + "word " * 200_000, "x@" + "a." * 100_000, "1" * 300_000])
def test_long_lines_do_not_overflow_the_stack(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(F.length(pii.redact_pii(F.col("t"))).alias("n")).first()
    assert row.n <= len(text) + 10


def test_typed_numbers_become_text(spark):
    rows = spark.createDataFrame([((123456789012, 2.5, True, None),)], "c struct<a: bigint, b: double, f: boolean, s: string>")
    out = rows.select(pii.redact_pii_struct(F.col("c"), rows.schema["c"].dataType).alias("c")).first().c
    assert (out.a, out.b, out.f, out.s) == ("[REDACTED]", "2.5", True, None)
