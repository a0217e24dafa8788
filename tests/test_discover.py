"""Discovered shapes give what the helper for unknown shapes gives, without it where all texts fit."""

import json
import random

import pytest
from pyspark.sql import functions as F
from test_redact import MIXED

from logloom.functions import redact as r
from logloom.functions.pii import redact_pii_json
from logloom.functions.shapes import Shape, holds, merge, read_shape, type_of
from logloom.operators import discover as d
from logloom.plans.flows import to_index

RULES = r.RuleSet(paths=(r.PathRule("MAIL", r"email"), r.PathRule("ROOT", r"^(\[])?$"), r.PathRule("TAG", r"\.tags\[]$", 1, 1)))
ODD = [
    '{"email":"a@b.c","n":2.50,"t":true,"z":null}', '{"email":"<x&y>\u2028","tags":["abc",null,5,"q"]}', '{"email":"a\\u0007b"}', '{"email":"\\ud800"}',
    '{"email":5,"n":1e3}', '{"email":null}', '{"email":{"email":"in"}}', '{"email":["l1",["l2"]]}', '{"n":-0.0,"email":"m"}', '{"n":0.00001,"email":"m"}',
    '{"n":12345678901234567890,"email":"m"}', '{"n":1234567890123456789.5,"email":"m"}', '{"email":"m","email":"n"}', '{"Email":"m","email":"n"}',
    '{"a b":1,"x.y":"q","`t":{"email":"m"},"é":[{"q":1.5},{"email":"z"}]}', '{"\U0001f600":"e","email":"m"}', '{"":"e","email":"m"}',
    '"root"', "5", "5.0", "null", "true", "[]", "{}", '["a","b"]', '[[["email"]]]', '{"email":"m"} x', '1,2', '{"email":"m"', "plain", "2024-01-01 x", " ",
    '{"email":"m"},{"email":"n"}', '{"tags":[]}', '{"tags":[{"email":"m"}]}', '{"tags":["ab"]}', ' { "email" : "m" } ', '{"email":"c:\\\\bin"}', '{"o":{},"email":"m"}',
]
TEXTS = ODD + [text for text, _ in MIXED]


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)


def both(spark, texts, change):
    rows = table(spark, texts)
    shape = d.discover(rows, "t")
    done = rows.select("i", change(F.col("t"), shape).alias("typed"), change(F.col("t"), None).alias("helped")).orderBy("i").collect()
    assert [row.typed for row in done] == [row.helped for row in done]
    return shape, done


def redacted(text, shape):
    return r.redact_text(text, RULES, shape)


def python_stages(df):
    return df._jdf.queryExecution().toString().count("ArrowEvalPython")


def test_any_texts_are_redacted_alike(spark):
    shape, done = both(spark, TEXTS, redacted)
    assert 0 < shape.misfits < len(TEXTS) and done[0].typed == '{"email":"[MAIL REDACTED]","n":2.5,"t":true,"z":null}'


@pytest.mark.parametrize("text", ['"root"', '["a","b"]', '[[["email"]]]', '{"a b":1,"x.y":"q","`t":{"email":"m"},"é":[{"q":1.5},{"email":"z"}]}', '{"email":null}'])
def test_shapes_of_one_text(spark, text):
    assert both(spark, [text], redacted)[0].misfits == 0


def test_personal_data_alike(spark):
    texts = [*TEXTS, '{"p":"+62 812-345-6789","n":[8123456789,1.5,true,null,"a@b.co"]}', '{"p":8123456789}']
    both(spark, texts, lambda t, shape: redact_pii_json(t, shape=shape))
    both(spark, texts[-2:], lambda t, shape: redact_pii_json(t, shape=shape))


def test_random_texts_alike(spark):
    draw = random.Random(3)

    def value(depth):
        kind = draw.randrange(9 if depth else 6)
        if kind < 6:
            return [None, True, draw.randint(-9, 10**12), draw.randint(-999, 999) / 8, draw.choice(["a@b.c", "", "<é>"]), "s"][kind]
        return [value(depth - 1) for _ in range(draw.randrange(3))] if kind == 6 else {draw.choice(["email", "tags", "n", "N", "o"]): value(depth - 1) for _ in range(3)}

    both(spark, [json.dumps(value(2), ensure_ascii=False) for _ in range(300)], redacted)


UNIFORM = ['{"email":"a@b.c","n":%d,"in":{"email":"x","k":[1,2.5]},"u":%s}' % (k, ["null", '"s"', "7"][k % 3]) for k in range(50)]


def test_uniform_texts_need_no_python(spark):
    shape, _ = both(spark, [*UNIFORM, "no json", None], redacted)
    rows = table(spark, UNIFORM)
    assert shape.misfits == 0 and python_stages(rows.select(redacted(F.col("t"), shape))) == 0
    assert python_stages(rows.select(redacted(F.col("t"), None))) > 0
    late = table(spark, ['{"email":"a","new":"b"}'])
    with pytest.raises(Exception, match="does not fit"):
        late.select(redacted(F.col("t"), shape)).collect()


def test_many_and_no_shapes(spark):
    texts = ['{"email":"m","k%d":"v"}' % k for k in range(200)] + UNIFORM
    shape, _ = both(spark, texts, redacted)
    assert shape.misfits == 200 - (d.MAX_SHAPES - 3)  # the frequent ones and as many others as are read
    assert d.discover(table(spark, ["x"]).filter("i < 0"), "t") == Shape(type_of("null"), 0)
    both(spark, ["no json", None, ""], redacted)
    both(spark, ['{"a":' * 60 + '{"email":"m"}' + "}" * 60], redacted)


def test_merge_keeps_what_it_can_hold():
    one, two = read_shape("OBJECT<a: STRING, b: ARRAY<VOID>>"), read_shape("OBJECT<a: VOID, b: ARRAY<STRING>, `c d`: OBJECT<>>")
    both_held = merge(one, two)
    assert holds(both_held, one) and holds(both_held, two) and both_held == {"a": "scalar", "b": ["string"], "c d": {}}
    assert not holds(merge({"a": "string"}, {"a": {"b": "string"}}), {"a": {"b": "string"}})
    assert read_shape("OBJECT<`OBJECT<`: BIGINT>") == {"OBJECT<": "scalar"} and read_shape("nonsense <") is None


def test_index_documents_without_python(spark):
    content = ['{"n":%d,"user":{"email":"a@b.c"}}' % k for k in range(20)]
    rows = [("t", json.dumps({"context": {"es_index_prefix": "p"}, "timestamp": "s", "content": c}), None) for c in content] + [("t", "broken", None)]
    messages = spark.createDataFrame(rows, "topic string, value string, headers array<struct<key:string,value:binary>>")
    rules = {"default": RULES, "other": r.RuleSet()}
    clock = F.lit("2024-01-02").cast("timestamp")
    made, plain = (to_index(messages, rules, clock, content_schema=how) for how in ("discover", None))
    assert python_stages(made) == 0 and python_stages(plain) > 0
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect()))
