"""Per-application redaction: rules, rule sets and their compilation into column expressions."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import jsontext
from logloom.functions.paths import rewrite_leaves
from logloom.functions.regex import map_matches, python_regex, replace_all, to_java_regex
from logloom.functions.shapes import Shape, shaped_or

DEFAULT_APP = "default"


@dataclass(frozen=True)
class StaticRule:
    """Replace every match of ``regex`` in the text, keeping some characters at either end."""

    name: str
    regex: str
    keep_start: int = 0
    keep_end: int = 0

    def __post_init__(self):
        to_java_regex(self.regex)  # a bad rule fails here, before any job starts


@dataclass(frozen=True)
class PathRule:
    """Replace string values whose dotted JSON path matches ``path`` (unanchored)."""

    name: str
    path: str
    keep_start: int = 0
    keep_end: int = 0

    def __post_init__(self):
        python_regex(self.path)
        to_java_regex(self.path)


@dataclass(frozen=True)
class RuleSet:
    static: tuple[StaticRule, ...] = ()
    paths: tuple[PathRule, ...] = ()


def parse_rules(text: str) -> dict[str, RuleSet]:
    """Read ``{"app": {"StaticRules": [...], "JsonPathRules": [...]}}``."""

    def hints(rule):
        return int(rule.get("HintCharsStart") or 0), int(rule.get("HintCharsEnd") or 0)

    return {
        app: RuleSet(
            tuple(StaticRule(r["Name"], r["Regex"], *hints(r)) for r in rules.get("StaticRules") or ()),
            tuple(PathRule(r["Name"], r["Path"], *hints(r)) for r in rules.get("JsonPathRules") or ()),
        )
        for app, rules in json.loads(text).items()
    }


def rules_json(rules: Mapping[str, RuleSet]) -> str:
    """The inverse of ``parse_rules``."""

    def entry(rule, key, value):
        return {
            "Name": rule.name,
            key: value,
            "HintCharsStart": rule.keep_start,
            "HintCharsEnd": rule.keep_end,
        }

    return json.dumps(
        {
            app: {
                "StaticRules": [entry(r, "Regex", r.regex) for r in rule_set.static],
                "JsonPathRules": [entry(r, "Path", r.path) for r in rule_set.paths],
            }
            for app, rule_set in rules.items()
        },
        sort_keys=True,
    )


def mark(value: Column, rule: StaticRule | PathRule) -> Column:
    """The redacted form of one value; a value too short for its hints shows none of itself."""
    tag = F.lit(f"[{rule.name} REDACTED]")
    start, end = max(rule.keep_start, 0), max(rule.keep_end, 0)
    if not start and not end:
        return F.when(value.isNotNull(), tag)
    shown = F.concat(F.left(value, F.lit(start)), tag, F.right(value, F.lit(end)))
    return F.when(F.length(value) >= start + end, shown).when(value.isNotNull(), tag)


def redact_static(text: Column, rule: StaticRule) -> Column:
    pattern = to_java_regex(rule.regex)
    if rule.keep_start > 0 or rule.keep_end > 0:
        return map_matches(text, pattern, lambda match: mark(match, rule))
    return replace_all(text, pattern, f"[{rule.name} REDACTED]")


def redact_statics(text: Column, rules) -> Column:
    for rule in rules:
        text = redact_static(text, rule)
    return text


def typed_leaf(rules):
    """Path rules as a function of one leaf of a typed column, for ``rewrite_leaves``."""

    def leaf(path, column, leaf_type):
        if isinstance(leaf_type, T.VariantType):
            string = F.when(F.schema_of_variant(column) == "STRING", F.try_variant_get(column, "$", "string"))
            changed = leaf(path, string, T.StringType())
            return None if changed is None else F.coalesce(changed.cast("variant"), column)
        if not isinstance(leaf_type, T.StringType):
            return None
        if isinstance(path, Column):
            changed = column
            for rule in reversed(rules):
                hit = path.rlike(to_java_regex(rule.path))
                changed = F.when(hit, mark(column, rule)).otherwise(changed)
            return changed if rules else None
        for rule in rules:
            if python_regex(rule.path).search(path):
                return mark(column, rule)
        return None

    return leaf


def redact_struct(value: Column, dtype: T.DataType, rules) -> Column:
    """Path rules on a typed column: matched against field paths while the plan is built."""
    return rewrite_leaves(value, dtype, typed_leaf(rules))


def _json_leaf(rules):
    compiled = [(python_regex(r.path), f"[{r.name} REDACTED]", max(r.keep_start, 0), max(r.keep_end, 0)) for r in rules]

    def leaf(path, value):
        if not isinstance(value, str):
            return value
        for pattern, tag, start, end in compiled:
            if pattern.search(path):
                if len(value) < start + end:
                    return tag
                return value[:start] + tag + value[len(value) - end :]
        return value

    return leaf


def redact_json(text: Column, rules) -> Column:
    """Path rules on JSON text of unknown shape; NULL where the text is not JSON."""
    return jsontext.rewriter(_json_leaf(rules))(text)


def redact_typed_json(text: Column, schema: T.StructType, rules) -> Column:
    """Path rules on JSON text, in built-in expressions wherever ``schema`` holds the whole text.

    A text that the schema would change (another field, a null, another type, an array, a repeated
    name) is told by comparing both as VARIANT; it goes through the helper for unknown shapes, so no
    field is lost and none is left unredacted. Text that is not JSON stays as it is.
    """

    def canonical(json_text: Column) -> Column:
        # in brackets, for the parser would not mind what follows a whole value
        return F.try_parse_json(F.concat(F.lit("["), json_text, F.lit("]"))).cast("string")

    held = F.coalesce(canonical(text) == canonical(F.to_json(F.from_json(text, schema))), F.lit(False))
    others = F.when(~held, text)
    # A lambda binds the parsed value, so it is parsed once however many fields are read.
    typed = F.transform(F.array(F.from_json(text, schema)), lambda value: F.to_json(redact_struct(value, schema, rules)))[0]
    return F.coalesce(jsontext.rewriter(_json_leaf(rules), keep_other=True)(others), typed)


def redact_text(text: Column, rules: RuleSet, schema: T.StructType | Shape | None = None) -> Column:
    """A whole rule set over log text: path rules if the text is JSON, then static rules in order.

    With ``schema`` the path rules of texts it describes stay in built-in expressions; all other JSON
    goes through an Arrow-batched helper. A ``Shape`` found by ``discover`` gives the same texts as no
    schema does, and plans no helper where all texts fit it.
    """
    if rules.paths:
        if isinstance(schema, Shape):
            helper = jsontext.rewriter(_json_leaf(rules.paths))
            text = F.coalesce(shaped_or(text, schema, typed_leaf(rules.paths), helper), text)
        elif schema is None:
            text = F.coalesce(redact_json(text, rules.paths), text)
        else:
            text = redact_typed_json(text, schema, rules.paths)
    return redact_statics(text, rules.static)


def redact_by_app(
    app: Column, text: Column, rules: Mapping[str, RuleSet], schema: T.StructType | Shape | None = None
) -> Column:
    """Pick the rule set by application: its own rules replace, never extend, the default ones.

    Applications that share a rule set share one branch, so the expression grows with the number
    of distinct rule sets and not with the number of applications.
    """
    if not rules:
        return text
    by_rules: dict[RuleSet, list[str]] = {}
    for name, rule_set in rules.items():
        if name != DEFAULT_APP:
            by_rules.setdefault(rule_set, []).append(name)
    named = [name for names in by_rules.values() for name in names]
    default = rules.get(DEFAULT_APP, RuleSet())
    # An Arrow helper runs for every row of its input whatever branch the row takes, so each
    # branch hands it only the texts of its own applications.
    mine = F.when(app.isNull() | ~app.isin(named), text) if default.paths else text
    fallback = redact_text(mine, default, schema)
    branches = F
    for rule_set, names in by_rules.items():
        mine = F.when(app.isin(names), text) if rule_set.paths else text
        branches = branches.when(app.isin(names), redact_text(mine, rule_set, schema))
    return fallback if branches is F else branches.otherwise(fallback)
