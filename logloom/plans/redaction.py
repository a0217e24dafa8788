"""Queries: redaction rules and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import pii
from logloom.functions import redact as r
from logloom.operators.discover import discover
from logloom.operators.ruletable import compile_rules, redact_by_table
from logloom.plans import inputs as i
from logloom.plans.registry import query
from logloom.session import spread
from logloom.sources import rules as sources

EMAIL = r.StaticRule("EMAIL", r"[\w.]+@[\w.]+\.[a-z]+")
NUMBER = r.StaticRule("NUMBER", r"\b\d{3,}\b")
EMAIL_HINTS = r.StaticRule("EMAIL", r"[\w.]+@[\w.]+\.[a-z]{3,}", keep_start=1, keep_end=3)

RULES = {
    "default": r.RuleSet(static=(EMAIL, NUMBER)),
    "src0": r.RuleSet(static=(r.StaticRule("WORD", r"(?i)\b(the|und|des)\b"),)),
    "src1": r.RuleSet(),
    "src2": r.RuleSet(static=(NUMBER,)),
    "src3": r.RuleSet(static=(NUMBER,)),
}


def texts(spark, sf):
    return spread(i.table(spark, sf, "documents").select("doc_id", "source", "lang", "text"))


def sql_pattern(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _replaced(column: str, rule: r.StaticRule) -> str:
    return f"regexp_replace({column}, {sql_pattern(rule.regex)}, '[{rule.name} REDACTED]', 'g')"


@query("redact_static", f"SELECT doc_id, {_replaced(_replaced('text', EMAIL), NUMBER)} AS text FROM documents")
def redact_static(spark, sf):
    return texts(spark, sf).select("doc_id", r.redact_statics(F.col("text"), [EMAIL, NUMBER]).alias("text"))


@query(
    "redact_static_hint",
    r"""SELECT doc_id, regexp_replace(text, '([\w.])[\w.]*@[\w.]+\.[a-z]*([a-z]{3})', '\1[EMAIL REDACTED]\2', 'g') AS text FROM documents""",
)
def redact_static_hint(spark, sf):
    return texts(spark, sf).select("doc_id", r.redact_static(F.col("text"), EMAIL_HINTS).alias("text"))


PATH_RULES = (
    r.PathRule("LANG", r"meta\.lang$"),
    r.PathRule("PART", r"parts\[]\.word", keep_start=2),
    r.PathRule("ANY", r"tags\.s"),
)


def nested(spark, sf):
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("word"), F.length(w).alias("n")))
    return texts(spark, sf).select(
        "doc_id",
        F.struct(
            F.struct("lang", "source").alias("meta"), words.alias("parts"), F.create_map("source", "lang").alias("tags")
        ).alias("content"),
    )


_WORDS = "string_split(text, ' ')"
_MARKED = f"list_transform({_WORDS}, lambda w: CASE WHEN length(w) >= 2 THEN left(w, 2) ELSE '' END || '[PART REDACTED]')"


@query(
    "redact_path",
    f"""SELECT doc_id, '[LANG REDACTED]' AS lang, source,
      array_to_string({_MARKED}, ' ') AS words,
      CAST(list_sum(list_transform({_WORDS}, lambda w: length(w))) AS BIGINT) AS n, '[ANY REDACTED]' AS tag FROM documents""",
)
def redact_path(spark, sf):
    rows = nested(spark, sf)
    done = rows.select("doc_id", r.redact_struct(F.col("content"), rows.schema["content"].dataType, PATH_RULES).alias("c"))
    return done.select(
        "doc_id", "c.meta.lang", "c.meta.source",
        F.array_join(F.transform("c.parts", lambda p: p.getField("word")), " ").alias("words"),
        F.aggregate("c.parts", F.lit(0).cast("long"), lambda a, p: a + p.getField("n")).alias("n"),
        F.map_values("c.tags")[0].alias("tag"),
    )


RULESET = r.RuleSet(
    static=(EMAIL, NUMBER), paths=(r.PathRule("LANG", r"^\.lang$"), r.PathRule("SOURCE", r"meta.source", keep_end=1))
)
RULESET_TYPE = T.StructType().add("lang", "string").add("text", "string").add("meta", T.StructType().add("source", "string"))

# Static rules see the JSON form of a text, line ends and quotes escaped.
_RULESET_SQL = f"""SELECT doc_id, '[LANG REDACTED]' AS lang, '[SOURCE REDACTED]' || right(source, 1) AS source,
  json_extract_string({_replaced(_replaced("CAST(to_json(text) AS VARCHAR)", EMAIL), NUMBER)}, '$') AS text FROM documents"""


def _json_texts(spark, sf):
    return texts(spark, sf).select("doc_id", F.to_json(F.struct("lang", "text", F.struct("source").alias("meta"))).alias("line"))


def _fields(df):
    return df.select(
        "doc_id", F.get_json_object("line", "$.lang").alias("lang"),
        F.get_json_object("line", "$.meta.source").alias("source"), F.get_json_object("line", "$.text").alias("text"),
    )


@query("redact_ruleset", _RULESET_SQL)
def redact_ruleset(spark, sf):
    lines = _json_texts(spark, sf)
    return _fields(lines.select("doc_id", r.redact_text(F.col("line"), RULESET, RULESET_TYPE).alias("line")))


@query("redact_ruleset_any_json", _RULESET_SQL)
def redact_ruleset_any_json(spark, sf):
    lines = _json_texts(spark, sf)
    return _fields(lines.select("doc_id", r.redact_text(F.col("line"), RULESET).alias("line")))


@query("redact_ruleset_discovered", _RULESET_SQL)
def redact_ruleset_discovered(spark, sf):
    """As ``redact_ruleset``, with the schema found in the lines."""
    lines = _json_texts(spark, sf)
    return _fields(lines.select("doc_id", r.redact_text(F.col("line"), RULESET, discover(lines, "line")).alias("line")))


MIXED = r.RuleSet(paths=(r.PathRule("LANG", r"\.lang$"),))
MIXED_TYPE = T.StructType().add("lang", "string").add("n", "integer")


_MIXED_SQL = """SELECT doc_id, '[LANG REDACTED]' AS lang, CASE doc_id % 4 WHEN 2 THEN source ELSE CAST(n_chars AS VARCHAR) END AS n,
      CASE doc_id % 4 WHEN 1 THEN text END AS extra FROM documents"""


def _mixed_lines(spark, sf):
    """Every document as a line that the schema fits, that has another field, another type, or is an array."""
    shape = F.col("doc_id") % 4
    fits, more, other = F.struct("lang", F.col("n_chars").alias("n")), F.struct("lang", "text", F.col("n_chars").alias("n")), F.struct("lang", F.col("source").alias("n"))
    line = F.when(shape == 0, F.to_json(fits)).when(shape == 1, F.to_json(more)).when(shape == 2, F.to_json(other)).otherwise(F.to_json(F.array(fits)))
    return spread(i.table(spark, sf, "documents")).select("doc_id", line.alias("line"))


def _mixed_redacted(rows, schema):
    done = rows.select("doc_id", r.redact_text(F.col("line"), MIXED, schema).alias("line"))
    inside = F.when(F.col("line").startswith("["), F.get_json_object("line", "$[0]")).otherwise(F.col("line"))
    return done.select("doc_id", inside.alias("line")).select(
        "doc_id", F.get_json_object("line", "$.lang").alias("lang"), F.get_json_object("line", "$.n").alias("n"),
        F.get_json_object("line", "$.text").alias("extra"),
    )


@query("redact_mixed_json", _MIXED_SQL)
def redact_mixed_json(spark, sf):
    return _mixed_redacted(_mixed_lines(spark, sf), MIXED_TYPE)


@query("redact_mixed_discovered", _MIXED_SQL)
def redact_mixed_discovered(spark, sf):
    """One type holds all objects; the arrays are counted as misfits and go through the helper."""
    lines = _mixed_lines(spark, sf)
    return _mixed_redacted(lines, discover(lines, "line"))


_WORD_SQL = r"regexp_replace(text, '(?i)\b(the|und|des)\b', '[WORD REDACTED]', 'g')"
BY_APP_SQL = f"""CASE source WHEN 'src0' THEN {_WORD_SQL} WHEN 'src1' THEN text WHEN 'src2' THEN {_replaced("text", NUMBER)}
  WHEN 'src3' THEN {_replaced("text", NUMBER)} ELSE {_replaced(_replaced("text", EMAIL), NUMBER)} END"""


@query("redact_by_app", f"SELECT doc_id, source, {BY_APP_SQL} AS text FROM documents")
def redact_by_app(spark, sf):
    return texts(spark, sf).select(
        "doc_id", "source", r.redact_by_app(F.col("source"), F.col("text"), RULES).alias("text")
    )


# Every document is of an application of its own or of one without rules; a rule's pattern, name and hints
# are data. Applications with an empty rule set are not redacted, those without one get the default rules.
TABLE_APP = "CASE WHEN doc_id % 3 = 0 THEN 'none-' || doc_id ELSE source || '-' || doc_id END"
_CAPS = r"""'\b([A-Z])[a-z]{' || CAST(2 + doc_id % 5 AS VARCHAR) || '}\b'"""
_DIGITS = r"""'\b' || CAST(doc_id % 10 AS VARCHAR) || '\d*'"""
TABLE_RULES_SQL = rf"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_replaced("text", NUMBER)} WHEN doc_id % 7 = 5 THEN text
  ELSE regexp_replace(regexp_replace({_replaced("text", EMAIL)}, {_CAPS}, '\1[C' || lang || ' REDACTED]', 'g'), {_DIGITS}, '[N$ REDACTED]', 'g')
  END AS text FROM documents"""


def rule_rows(spark, sf):
    """Three rules for each of two thirds of all documents, each document being an application; some sets are empty."""
    rule = sources.RULES.valueType["StaticRules"].dataType
    number = F.col("doc_id")
    made = F.array(
        F.struct(F.lit(EMAIL.name), F.lit(EMAIL.regex), F.lit(0), F.lit(0)),
        F.struct(F.concat(F.lit("C"), "lang"), F.concat(F.lit(r"\b[A-Z][a-z]{"), (2 + number % 5).cast("string"), F.lit(r"}\b")), F.lit(1), F.lit(0)),
        F.struct(F.lit("N$"), F.concat(F.lit(r"\b"), (number % 10).cast("string"), F.lit(r"\d*")), F.lit(0), F.lit(0)),
    ).cast(rule)
    own = i.table(spark, sf, "documents").filter(number % 3 != 0).select(
        F.expr(TABLE_APP).alias("app"), F.when(number % 7 == 5, F.array().cast(rule)).otherwise(made).alias("StaticRules")
    )
    default = spark.range(1).select(F.lit("default").alias("app"), F.array(F.struct(F.lit(NUMBER.name), F.lit(NUMBER.regex), F.lit(0), F.lit(0))).cast(rule).alias("StaticRules"))
    return own.unionByName(default).withColumn("JsonPathRules", F.array().cast(sources.RULES.valueType["JsonPathRules"].dataType))


@query("redact_rules_table", TABLE_RULES_SQL)
def redact_rules_table(spark, sf):
    rows = i.table(spark, sf, "documents").select("doc_id", F.expr(TABLE_APP).alias("app"), "text")
    return redact_by_table(rows, compile_rules(rule_rows(spark, sf))).select("doc_id", "text")


def _pii_sql(kind: str, column: str) -> str:
    return f"regexp_replace({column}, {sql_pattern(pii.PATTERNS[kind])}, '{pii.MARK}', 'g')"


def _chain_sql(column: str) -> str:
    for kind in pii.PATTERNS:
        column = _pii_sql(kind, column)
    return column


def _one_kind(kind: str):
    @query(f"pii_{kind}", f"SELECT doc_id, {_pii_sql(kind, 'text')} AS text FROM documents")
    def one(spark, sf):
        return texts(spark, sf).select("doc_id", pii.redact_kind(F.col("text"), kind).alias("text"))

    return one


for _kind in pii.PATTERNS:
    _one_kind(_kind)


@query("pii_all", f"SELECT doc_id, {_chain_sql('text')} AS text FROM documents")
def pii_all(spark, sf):
    return texts(spark, sf).select("doc_id", pii.redact_pii(F.col("text")).alias("text"))


@query(
    "pii_json",
    f"""SELECT conv_id, turn, {_chain_sql("role")} AS role, {_chain_sql("text")} AS text, {_chain_sql("CAST(conv_id * 100000001 AS VARCHAR)")} AS account,
      turn % 2 = 0 AS flag FROM conversations""",
)
def pii_json(spark, sf):
    rows = spread(i.table(spark, sf, "conversations")).select(
        "conv_id", "turn",
        F.struct(
            "role", F.struct("text", (F.col("turn") % 2 == 0).alias("flag")).alias("body"),
            F.array(F.col("conv_id") * 100000001).alias("accounts"),
        ).alias("content"),
    )
    done = rows.select("conv_id", "turn", pii.redact_pii_struct(F.col("content"), rows.schema["content"].dataType).alias("c"))
    return done.select(
        "conv_id", "turn", "c.role", "c.body.text", F.col("c.accounts")[0].alias("account"), F.col("c.body.flag").alias("flag")
    )


_PII_LINES_SQL = f"""SELECT conv_id, turn, {_chain_sql("text")} AS text, {_chain_sql("CAST(conv_id * 100000001 AS VARCHAR)")} AS account FROM conversations"""


def _pii_lines(spark, sf):
    return spread(i.table(spark, sf, "conversations")).select(
        "conv_id", "turn", F.to_json(F.struct("text", F.array(F.col("conv_id") * 100000001).alias("accounts"))).alias("line")
    )


def _pii_fields(lines, shape=None):
    done = lines.select("conv_id", "turn", pii.redact_pii_json(F.col("line"), shape=shape).alias("line"))
    return done.select(
        "conv_id", "turn", F.get_json_object("line", "$.text").alias("text"), F.get_json_object("line", "$.accounts[0]").alias("account")
    )


@query("pii_any_json", _PII_LINES_SQL)
def pii_any_json(spark, sf):
    return _pii_fields(_pii_lines(spark, sf))


@query("pii_discovered_json", _PII_LINES_SQL)
def pii_discovered_json(spark, sf):
    lines = _pii_lines(spark, sf)
    return _pii_fields(lines, discover(lines, "line"))
