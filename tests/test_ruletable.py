"""Rules as a table against the expression tree, and what is set aside."""

import json

import pytest
from pyspark.sql import functions as F

from logloom.functions.redact import parse_rules, redact_by_app
from logloom.operators.ruletable import compile_rules, redact_by_table
from logloom.plans.flows import to_index
from logloom.sources.rules import LiveRules, load_rule_table, rules_table

RULES = {
    "default": {"StaticRules": [{"Name": "N$1\\", "Regex": r"\b\d{3,}\b"}]},
    "a": {"StaticRules": [{"Name": "MAIL", "Regex": r"[\w.]+@[\w.]+", "HintCharsStart": 2, "HintCharsEnd": 3}, {"Name": "W", "Regex": "(?i)the"}]},
    "b": {"JsonPathRules": [{"Name": "P", "Path": r"\.user\.name$", "HintCharsStart": 1}], "StaticRules": [{"Name": "S", "Regex": "s+"}]},
    "c": {},
    "d": {"StaticRules": [], "JsonPathRules": [{"Name": "Q", "Path": "x"}]},
}
TEXTS = [None, "", "the mail is abc@def.org or x@y, 12345 THE", '{"user":{"name":"sam","age":123},"x":[{"x":"1"}]}', "not {json 999", '{"x": "sss"}', "é@ü 1234 tHe"]


def table_of(spark, *rules):
    return compile_rules(rules_table(spark.createDataFrame([(json.dumps(r),) for r in rules], "value string")))


def both(spark, rules):
    rows = spark.createDataFrame([(n, app, text) for n, (app, text) in enumerate((a, t) for a in (*rules, "none", None) for t in TEXTS)], "n int, app string, text string")
    theirs = rows.select("n", redact_by_app(F.col("app"), F.col("text"), parse_rules(json.dumps(rules))).alias("text"))
    ours = redact_by_table(rows, table_of(spark, rules))
    assert ours.columns == ["n", "app", "text"]
    return {r["n"]: r["text"] for r in ours.collect()}, {r["n"]: r["text"] for r in theirs.collect()}


@pytest.mark.parametrize("without", [(), ("default",), ("b", "d")])
def test_equals_the_tree(spark, without):
    ours, theirs = both(spark, {k: v for k, v in RULES.items() if k not in without})
    assert ours == theirs


def test_ten_thousand_applications_have_the_plan_of_ten(spark):
    def rules(count):
        return {f"app{n}": {"StaticRules": [{"Name": "R", "Regex": f"k{n}x"}, {"Name": "D", "Regex": r"\d"}, {"Name": "E", "Regex": f"[e{n % 7}]+$"}]} for n in range(count)}

    rows = spark.range(10_000).select("id", F.concat(F.lit("app"), "id").alias("app"), F.concat(F.lit("k"), "id", F.lit("x 7 eee")).alias("text"))
    many = redact_by_table(rows, table_of(spark, rules(10_000)))
    few = redact_by_table(rows, table_of(spark, rules(10)))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(many) < 1.1 * size(few)
    assert "Python" not in many._jdf.queryExecution().executedPlan().toString()  # no path rules, no Python
    found = {r["id"]: r["text"] for r in many.collect()}
    assert found == {n: "[R REDACTED] [D REDACTED] [E REDACTED]" for n in range(10_000)}


def test_bad_rules_are_set_aside_one_by_one(spark):
    rules = {"a": {"StaticRules": [{"Name": "BAD", "Regex": "("}, {"Name": "OK", "Regex": "x"}, {"Name": "NONE"}], "JsonPathRules": [{"Name": "PROP", "Path": r"\pL"}]}, "only bad": {"StaticRules": [{"Name": "BAD", "Regex": "*"}]}}
    texts = spark.createDataFrame([(json.dumps(rules),), ("{ broken",)], "value string")
    table = compile_rules(rules_table(texts))
    assert sorted((r["app"] or "", r["name"] or "") for r in table.refused.collect()) == [("", ""), ("a", "BAD"), ("a", "NONE"), ("a", "PROP"), ("only bad", "BAD")]
    assert all(r["error"] for r in table.refused.collect())
    rows = spark.createDataFrame([("a", "x("), ("only bad", "x("), ("z", "x")], "app string, text string")
    assert sorted(map(tuple, redact_by_table(rows, table).collect())) == [("a", "[OK REDACTED]("), ("only bad", "x("), ("z", "x")]


def test_empty_tables(spark):
    rows = spark.createDataFrame([("a", "x 1234")], "app string, text string")
    empty = compile_rules(rules_table(spark.createDataFrame([], "value string")))
    assert redact_by_table(rows, empty).first()["text"] == "x 1234"
    assert redact_by_table(rows.limit(0), table_of(spark, RULES)).collect() == []


def test_index_with_a_rule_table_or_a_function(spark, tmp_path):
    messages = spark.createDataFrame(
        [("t", json.dumps({"context": {"es_index_prefix": p}, "timestamp": "s", "content": '{"a":"x 1234"}'}), None) for p in ("a", "b")] + [("t", "broken", None)],
        "topic string, value string, headers array<struct<key:string,value:binary>>",
    )
    rules = {"a": {"StaticRules": [{"Name": "X", "Regex": "x"}]}, "default": {"StaticRules": [{"Name": "N", "Regex": r"\d+"}]}}
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(rules))
    clock = F.lit("2024-01-02").cast("timestamp")
    same = [
        sorted((r["index_name"] or "", r["document"] or "", r["error"] or "") for r in to_index(messages, given, clock).collect())
        for given in (parse_rules(json.dumps(rules)), load_rule_table(spark, str(path)), lambda app, text: redact_by_app(app, text, parse_rules(json.dumps(rules))))
    ]
    assert same[0] == same[1] == same[2] and len(same[0]) == 3


def test_live_rule_tables_keep_the_last_good_one(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(json.dumps(RULES))
    live = LiveRules(spark, str(path), as_table=True)
    assert live.current.rules.count() == len(RULES)
    path.write_text("{ broken")
    assert live.refresh().rules.count() == len(RULES) and live.last_error is not None
    path.write_text(json.dumps({"b": {}}))
    assert live.refresh().rules.count() == 1 and live.last_error is None
