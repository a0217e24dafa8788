import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import redact as r
from logloom.functions.regex import UnsafePattern

TICKET = r.StaticRule("TICKET", r"[A-Z]{2}-\d{3,6}")
KEY = r.StaticRule("KEY", r"sk_[0-9a-f]{8}")
OWNER_AT = r.PathRule("OWNER", "order.buyer.owner")
CARD_AT = r.PathRule("CARD", "order.buyer.card")


def one(spark, column, **values):
    schema = T.StructType([T.StructField(k, T.StringType()) for k in values])
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).first().out


def order(owner, card):
    return '{"order":{"buyer":{"card":"%s","owner":"%s"}}}' % (card, owner)


BUYERS = '{"order":{"buyer":[{"card":"sk_00ff00ff","owner":"Ida Berg"},{"card":"sk_12345678","owner":"Tom Oak"}]}}'
CASES = [
    ([TICKET, KEY], [], "closed AB-1234, then CD-99", "closed [TICKET REDACTED], then CD-99"),
    ([TICKET, KEY], [], "sk_0a1b2c3d opens XY-777", "[KEY REDACTED] opens [TICKET REDACTED]"),
    ([r.StaticRule("TICKET", TICKET.regex, 2)], [], "AB-1234!", "AB[TICKET REDACTED]!"),
    ([r.StaticRule("TICKET", TICKET.regex, 0, 2)], [], "AB-1234!", "[TICKET REDACTED]34!"),
    ([r.StaticRule("TICKET", TICKET.regex, 2, 2)], [], "AB-1234 QQ-000001", "AB[TICKET REDACTED]34 QQ[TICKET REDACTED]01"),
    ([KEY], [], '{"token":"sk_deadbeef","n":"none"}', '{"token":"[KEY REDACTED]","n":"none"}'),
    ([KEY], [], order("Ida Berg", "sk_00ff00ff"), order("Ida Berg", "[KEY REDACTED]")),
    ([], [OWNER_AT], order("Ida Berg", "sk_00ff00ff"), order("[OWNER REDACTED]", "sk_00ff00ff")),
    ([], [r.PathRule("OWNER", OWNER_AT.path, 3)], order("Ida Berg", "x"), order("Ida[OWNER REDACTED]", "x")),
    ([], [r.PathRule("OWNER", OWNER_AT.path, 0, 4)], order("Ida Berg", "x"), order("[OWNER REDACTED]Berg", "x")),
    ([], [OWNER_AT, CARD_AT], order("Ida Berg", "x"), order("[OWNER REDACTED]", "[CARD REDACTED]")),
    (
        [KEY], [r.PathRule("OWNER", r"order.buyer\[]\.owner")], BUYERS,
        '{"order":{"buyer":[{"card":"[KEY REDACTED]","owner":"[OWNER REDACTED]"},{"card":"[KEY REDACTED]","owner":"[OWNER REDACTED]"}]}}',
    ),
    ([TICKET], [], '{"ticket":"ab-1234"}', '{"ticket":"ab-1234"}'),
]


@pytest.mark.parametrize(("static", "paths", "text", "wanted"), CASES)
def test_rule_sets(spark, static, paths, text, wanted):
    rules = r.RuleSet(tuple(static), tuple(paths))
    assert one(spark, r.redact_text(F.col("t"), rules), t=text) == wanted


BUYER = T.StructType().add("card", "string").add("owner", "string")


@pytest.mark.parametrize(("static", "paths", "text", "wanted"), [c for c in CASES if c[1]])
def test_rule_sets_with_a_schema(spark, static, paths, text, wanted):
    inner = T.ArrayType(BUYER) if text == BUYERS else BUYER
    schema = T.StructType().add("order", T.StructType().add("buyer", inner))
    rules = r.RuleSet(tuple(static), tuple(paths))
    assert one(spark, r.redact_text(F.col("t"), rules, schema), t=text) == wanted
    assert one(spark, r.redact_text(F.col("t"), rules, schema), t="no json") == "no json"


RULES = r.parse_rules(
    json.dumps(
        {
            "default": {"StaticRules": [{"Name": "PIN", "Regex": r"pin=\d{4}"}], "JsonPathRules": [{"Name": "CODE", "Path": r"\.code$"}]},
            "billing": {"StaticRules": [{"Name": "iban", "Regex": r"DE\d{4}"}]},
        }
    )
)


@pytest.mark.parametrize(
    ("app", "text", "wanted"),
    [
        ("shop", "try pin=0042 now", "try [PIN REDACTED] now"),
        ("shop", '{"code":"x9"}', '{"code":"[CODE REDACTED]"}'),
        ("billing", '{"code":"x9"}', '{"code":"x9"}'),
        ("billing", "to DE1234 pin=0042", "to [iban REDACTED] pin=0042"),
        (None, "pin=0042", "[PIN REDACTED]"),
    ],
)
def test_lookup_by_application(spark, app, text, wanted):
    assert one(spark, r.redact_by_app(F.col("a"), F.col("t"), RULES), a=app, t=text) == wanted


def test_without_rules_or_default_text_stays(spark):
    assert one(spark, r.redact_by_app(F.col("a"), F.col("t"), {}), a="x", t="pin=1234") == "pin=1234"
    only = {"other": RULES["default"]}
    assert one(spark, r.redact_by_app(F.col("a"), F.col("t"), only), a="x", t="pin=1234") == "pin=1234"


def test_rules_round_trip():
    assert r.parse_rules(r.rules_json(RULES)) == RULES


def test_a_value_shorter_than_its_hints_shows_nothing(spark):
    rule = r.StaticRule("PIN", r"\d+", keep_start=3, keep_end=3)
    assert one(spark, r.redact_static(F.col("t"), rule), t="12 and 1234567") == "[PIN REDACTED] and 123[PIN REDACTED]567"


def test_names_are_literal(spark):
    rule = r.StaticRule(r"$1\x", "a(b)")
    assert one(spark, r.redact_static(F.col("t"), rule), t="ab") == r"[$1\x REDACTED]"


def test_mixed_json_keeps_nulls_numbers_and_order(spark):
    rules = r.RuleSet(paths=(r.PathRule("S", r"\.s$"),))
    text = '{"z":[1,"a",null,{"s":"x","n":2.50}],"b":{"s":5},"s":"<y>","e":true}'
    wanted = '{"b":{"s":5},"e":true,"s":"[S REDACTED]","z":[1,"a",null,{"n":2.5,"s":"[S REDACTED]"}]}'
    assert one(spark, r.redact_text(F.col("t"), rules), t=text) == wanted


def test_bad_rules_fail_while_loading():
    with pytest.raises(UnsafePattern):
        r.StaticRule("X", r"(\w+\s?)*end")


TYPED = T.StructType().add("email", "string").add("n", "integer")
MIXED = [
    ('{"email":"a@b.c","n":1}', '{"email":"[MAIL REDACTED]","n":1}'),
    ('{"email":"a@b.c","n":1,"extra":"keep me"}', '{"email":"[MAIL REDACTED]","extra":"keep me","n":1}'),
    ('{"email":"a@b.c","n":"abc"}', '{"email":"[MAIL REDACTED]","n":"abc"}'),
    ('[{"email":"a@b.c"}]', '[{"email":"[MAIL REDACTED]"}]'),
    ('{"n":null,"email":"a@b.c"}', '{"email":"[MAIL REDACTED]","n":null}'),
    ('{"email":5,"n":3000000000}', '{"email":5,"n":3000000000}'),
    ('{"in":{"email":"a@b.c"},"email":"d@e.f"}', '{"email":"[MAIL REDACTED]","in":{"email":"[MAIL REDACTED]"}}'),
    ('{"email":"a@b.c"} and more', '{"email":"a@b.c"} and more'),
    ("{'email':'a@b.c'}", "{'email':'a@b.c'}"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize(("text", "wanted"), MIXED)
def test_a_schema_neither_drops_nor_skips(spark, text, wanted):
    rules = r.RuleSet(paths=(r.PathRule("MAIL", r"\.email$"),))
    assert one(spark, r.redact_text(F.col("t"), rules, TYPED), t=text) == wanted
    assert one(spark, r.redact_text(F.col("t"), rules), t=text) == wanted


def test_deep_nesting_and_long_numbers_are_redacted(spark):
    rules = r.RuleSet(paths=(r.PathRule("MAIL", r"\.email$"),))
    deep = '{"a":' * 3000 + '{"email":"a@b.c"}' + "}" * 3000
    assert one(spark, r.redact_text(F.col("t"), rules), t=deep) == deep.replace("a@b.c", "[MAIL REDACTED]")
    long = '{"email":"a@b.c","n":0}'.replace("0", "1" + "0" * 300)
    assert one(spark, r.redact_text(F.col("t"), rules), t=long) == long.replace("a@b.c", "[MAIL REDACTED]")
    longer = '{"email":"a@b.c","n":0}'.replace("0", "7" * 6000)
    assert one(spark, r.redact_text(F.col("t"), rules), t=longer) == longer.replace("a@b.c", "[MAIL REDACTED]")
