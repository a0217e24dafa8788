"""Redaction rules as data: compiled in a table, joined to texts by application, applied by a fold.

However many applications have rules, the plan stays the same: the rules are a column. Patterns are
translated in the rule table, where each stands once; what cannot be translated is set aside with its
error and stops no other rule. The compiled table is stored, so Spark knows its size before it plans the
join: it broadcasts a small one and shuffles both sides for a big one, splitting applications with very
many texts.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import jsontext
from logloom.functions.redact import DEFAULT_APP
from logloom.functions.regex import UnsafePattern, python_regex, to_java_regex
from logloom.session import stored

STATIC, PATH = "static", "path"
_APPLIED = "array<struct<name: string, pattern: string, keep_start: int, keep_end: int>>"


@dataclass(frozen=True)
class RuleTable:
    """``rules``: app, static, paths (one row per application); ``refused``: app, kind, name, pattern, error."""

    rules: DataFrame
    refused: DataFrame


def _restated(kind: str, pattern: str | None) -> tuple[str | None, str | None]:
    """(pattern for the engine that runs it, None) or (None, error): static rules run in Java, path rules in Python."""
    try:
        if pattern is None:
            raise UnsafePattern("no pattern")
        return (python_regex(pattern).pattern if kind == PATH else to_java_regex(pattern)), None
    except (ValueError, IndexError, RecursionError) as error:  # re.error and UnsafePattern are ValueErrors
        return None, f"{type(error).__name__}: {error}"


@F.pandas_udf(T.StructType().add("restated", "string").add("error", "string"))
def _translated(kind: pd.Series, pattern: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_restated(k, p) for k, p in zip(kind, pattern, strict=True)], columns=["restated", "error"], dtype=object)


def _compiles(pattern: Column) -> Column:
    """Whether Java takes a restated pattern; what the translation cannot foresee is found here."""
    return F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), pattern).isNotNull()


def compile_rules(typed: DataFrame) -> RuleTable:
    """Typed rules (``sources.rules.rules_table``) as a rule table.

    An application that stands in several rows has the rules of all of them, in order of their text.
    Rows without an application (texts that could not be read) are refused rules without a name. An
    application whose rules are all refused, or that has none, keeps its row: it has no rules of its own
    left, but the default ones do not apply to it either.
    """
    def listed(kind: str, rules: str, pattern: str) -> DataFrame:
        rule = F.col("rule")
        return typed.select("app", F.posexplode(rules).alias("position", "rule")).select(
            "app", F.lit(kind).alias("kind"), "position", rule["Name"].alias("name"), rule[pattern].alias("pattern"),
            F.greatest(F.coalesce(rule["HintCharsStart"], F.lit(0)), F.lit(0)).alias("keep_start"),
            F.greatest(F.coalesce(rule["HintCharsEnd"], F.lit(0)), F.lit(0)).alias("keep_end"),
        )

    known = typed.filter("app IS NOT NULL")
    rules = listed(STATIC, "StaticRules", "Regex").unionByName(listed(PATH, "JsonPathRules", "Path")).filter("app IS NOT NULL")
    # each pattern is translated once, however many applications share it
    patterns = rules.select("kind", "pattern").distinct().withColumn("t", _translated("kind", "pattern")).select("kind", "pattern", "t.*")
    checked = patterns.withColumn("error", F.when((F.col("kind") == STATIC) & F.col("restated").isNotNull() & ~_compiles(F.col("restated")), "PatternSyntaxException").otherwise(F.col("error")))
    checked = stored(checked, "patterns")
    same = (rules["kind"] == checked["kind"]) & rules["pattern"].eqNullSafe(checked["pattern"])
    joined = stored(rules.join(checked, same).select(rules["*"], "restated", "error"), "rules")
    one = F.struct("position", "name", F.col("restated").alias("pattern"), "keep_start", "keep_end")
    of = lambda kind: F.transform(  # noqa: E731 - rules of one application, few by nature
        F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & F.col("error").isNull(), one))),
        lambda r: F.struct(r.getField("name").alias("name"), r.getField("pattern").alias("pattern"), r.getField("keep_start").alias("keep_start"), r.getField("keep_end").alias("keep_end")),
    ).cast(_APPLIED)
    gathered = joined.groupBy("app").agg(of(STATIC).alias("static"), of(PATH).alias("paths"))
    bare = known.select("app").distinct().join(gathered.select(F.col("app").alias("_app"), "static", "paths"), F.col("app") == F.col("_app"), "left")
    empty = F.array().cast(_APPLIED)
    table = stored(bare.select("app", F.coalesce("static", empty).alias("static"), F.coalesce("paths", empty).alias("paths")), "rule-table")
    refused = joined.filter("error IS NOT NULL").select("app", "kind", "name", "pattern", "error")
    unread = typed.filter("app IS NULL").select(
        F.lit(None).cast("string").alias("app"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("string").alias("pattern"), F.lit("unreadable rule text").alias("error"),
    )
    return RuleTable(table, refused.unionByName(unread))


def _marked(value: Column, rule: Column) -> Column:
    """The redacted form of one match; one too short for its hints shows none of itself."""
    tag = F.concat(F.lit("["), rule.getField("name"), F.lit(" REDACTED]"))
    start, end = rule.getField("keep_start"), rule.getField("keep_end")
    shown = F.concat(F.substr(value, F.lit(1), start), tag, F.right(value, end))
    return F.when((start + end > 0) & (F.length(value) >= start + end), shown).otherwise(tag)


def _once(text: Column, rule: Column) -> Column:
    """One static rule: plain replacement, or match by match where characters are kept."""
    pattern = rule.getField("pattern")
    tag = F.concat(F.lit("["), rule.getField("name"), F.lit(" REDACTED]"))
    quoted = F.replace(F.replace(tag, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
    pieces = F.zip_with(
        F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
        lambda gap, match: F.when(match.isNull(), gap).otherwise(F.concat(gap, _marked(match, rule))),
    )
    hinted = rule.getField("keep_start") + rule.getField("keep_end") > 0
    return F.when(hinted, F.array_join(pieces, "")).otherwise(F.regexp_replace(text, pattern, quoted))


def apply_rules(text: Column, static: Column) -> Column:
    """Static rules, a column, in order. Built-in functions only."""
    return F.aggregate(static, text, _once)


@functools.lru_cache(maxsize=4096)
def _leaf(rules: str):
    """What the path rules, as JSON, make of a leaf."""
    made = [(re.compile(r["pattern"], re.ASCII), f"[{r['name']} REDACTED]", r["keep_start"], r["keep_end"]) for r in json.loads(rules)]

    def leaf(path, value):
        if isinstance(value, str):
            for pattern, tag, start, end in made:
                if pattern.search(path):
                    return value[:start] + tag + value[len(value) - end :] if len(value) >= start + end else tag
        return value

    return leaf


@F.pandas_udf(T.StringType())
def _by_paths(text: pd.Series, rules: pd.Series) -> pd.Series:
    done = [None if t is None or r is None else jsontext.rewrite(t, _leaf(r)) for t, r in zip(text, rules, strict=True)]
    return pd.Series(done, index=text.index, dtype=object)


def redact_by_table(rows: DataFrame, table: RuleTable, app: str = "app", text: str = "text") -> DataFrame:
    """``rows`` with column ``text`` redacted by the rules of column ``app``, as ``redact_by_app`` does it.

    Own rules replace the default ones. Path rules come first and need Python, so that stage exists only
    if some application has any, and sees only those applications' texts. Null texts stay null, a null
    application has the default rules.
    """
    default = table.rules.filter(F.col("app") == DEFAULT_APP).first()  # one application's rules
    with_paths = not table.rules.filter(F.size("paths") > 0).isEmpty()

    def fixed(kind: str) -> Column:
        made = [F.struct(*[F.lit(r[f]).alias(f) for f in ("name", "pattern", "keep_start", "keep_end")]) for r in (default[kind] if default else ())]
        return F.array(*made).cast(_APPLIED)

    own = table.rules.select(F.col("app").alias("_rapp"), F.col("static").alias("_static"), F.col("paths").alias("_paths"))
    joined = rows.join(own, F.col(app) == F.col("_rapp"), "left")
    has = F.col("_rapp").isNotNull()
    value = F.col(text)
    if with_paths:
        paths = F.when(has, F.col("_paths")).otherwise(fixed("paths"))
        asked = F.when(F.size(paths) > 0, F.to_json(paths))
        value = F.coalesce(_by_paths(F.when(asked.isNotNull(), value), asked), value)
    done = apply_rules(value, F.when(has, F.col("_static")).otherwise(fixed("static")))
    return joined.select(*[done.alias(c) if c == text else F.col(c) for c in rows.columns])
