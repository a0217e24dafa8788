"""Built-in personal-data patterns, applied in a fixed order to text or to JSON leaf values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions import jsontext
from logloom.functions.paths import rewrite_leaves
from logloom.functions.regex import python_regex, replace_all, to_java_regex
from logloom.functions.shapes import Shape, shaped_or

MARK = "[REDACTED]"

# What each kind of personal data looks like, in the order of application.
PATTERNS = {
    "email": r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}",
    "phone": r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    "address": r"(?i)(address|st|street|road|rd|avenue|ave|blvd|boulevard|lane|ln|dr|drive)\s+\d{1,5}\s+\w+(\s+\w+)*",
    "name": r"(?i)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "dob": r"\b((\d{4})[-/.](\d{2})[-/.](\d{2}))|((\d{2})[-/.](\d{2})[-/.](\d{4}))\b",
    "document": r"\b[0-9]{4}[ ]?[0-9]{4}[ ]?[0-9]{4}\b",
    "bank": r"\b\d{9,18}\b",
    "credit": r"(?i)\b(?:credit score|score|credit):?\s*\d{3}\b",
    "sex": r"(?i)\b(?:Male|Female|Other)\b",
}

# The same matches with possessive loops: a loop whose next token cannot start inside it never
# needs to give anything back, and Java would otherwise recurse once per word of the text. An
# address part is tried only where it begins or the last match ended, not once per character.
_POSSESSIVE = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++@[a-z0-9.-]+\.[a-z]{2,}",
    "name": r"(?i)\b[A-Z][a-z]++(?:\s++[A-Z][a-z]++\b)++",
}
# Python has no \G; a match ends between a letter and something that is none.
_PYTHON = {**_POSSESSIVE, "email": _POSSESSIVE["email"].replace(r"\G", "(?<=[a-z])(?![a-z])")}

# Every match starts with one of these, so the scan can skip all other positions.
_FIRST = {
    "phone": r"[+(\d]",
    "address": "[asrbld]",
    "dob": r"\d",
    "document": r"\d",
    "bank": r"\d",
    "credit": "[sc]",
    "sex": "[mfo]",
}


def java_pattern(kind: str) -> str:
    pattern = _POSSESSIVE.get(kind, PATTERNS[kind])
    if kind in _FIRST:
        flag = "(?i)" if pattern.startswith("(?i)") else ""
        pattern = f"{flag}(?={_FIRST[kind]})(?:{pattern.removeprefix('(?i)')})"
    return to_java_regex(pattern)


def redact_kind(text: Column, kind: str) -> Column:
    """Replace one kind of personal data in free text."""
    cleaned = replace_all(text, java_pattern(kind), MARK)
    return F.when(text.contains("@"), cleaned).otherwise(text) if kind == "email" else cleaned


def redact_pii(text: Column) -> Column:
    """Replace all nine kinds, one after the other."""
    for kind in PATTERNS:
        text = redact_kind(text, kind)
    return text


def number_text(value: Column, dtype: T.DataType) -> Column:
    """A number leaf as plain decimal digits, so that numeric identifiers are recognised."""
    if isinstance(dtype, T.IntegralType | T.DecimalType):
        return value.cast("string")
    whole = value.cast("decimal(38,0)")
    return F.when(whole.cast("double") == value, whole.cast("string")).otherwise(value.cast("string"))


def redact_pii_struct(value: Column, dtype: T.DataType) -> Column:
    """Redact every string and number leaf of a typed column; numbers become strings."""

    def leaf(path, column, leaf_type):
        if isinstance(leaf_type, T.StringType):
            return redact_pii(column)
        if isinstance(leaf_type, T.NumericType):
            return redact_pii(number_text(column, leaf_type))
        return None

    return rewrite_leaves(value, dtype, leaf)


def _shaped_leaf(path, column, dtype):
    """Redact a leaf of a discovered shape: strings, and of the other scalars the numbers."""
    if isinstance(dtype, T.StringType):
        return redact_pii(column)
    told = F.when(~F.schema_of_variant(column).isin("VOID", "BOOLEAN"), F.try_variant_get(column, "$", "string"))
    return F.coalesce(redact_pii(told).cast("variant"), column)


def redact_pii_json(text: Column, number_format: str = "plain", shape: Shape | None = None) -> Column:
    """Redact every string and number leaf of a JSON object given as text.

    Objects of unknown shape keep their keys, nulls and mixed arrays, which no typed column
    can hold; text that is not a JSON object gives NULL, for the dead-letter branch.
    ``number_format="short"`` writes numbers with an exponent from 1e6 upward before redacting. With a
    ``shape`` found by ``discover`` the plain form stays in built-in expressions, but for misfits.
    """
    chain = [python_regex(_PYTHON.get(kind, pattern)) for kind, pattern in PATTERNS.items()]
    show = jsontext.plain_number if number_format == "plain" else jsontext.short_number

    def leaf(path, value):
        if isinstance(value, float | int):
            value = show(value)
        for pattern in chain:
            value = pattern.sub(MARK, value)
        return value

    helper = jsontext.rewriter(leaf, objects_only=True)
    if shape is None or number_format != "plain" or not isinstance(shape.dtype, T.StructType):
        return helper(text)
    done = shaped_or(text, shape, _shaped_leaf, helper)
    return F.when(done.startswith("{"), done)  # of what the shape holds, null alone is no object
