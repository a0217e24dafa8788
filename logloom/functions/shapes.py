"""Shapes of JSON texts: what a set of texts has in common as a type, and rewriting by that type.

A type found in data is safe to use because every text is held against it at run time: it is parsed
once as a VARIANT, cast, and written again; only where both writings are the same is the typed form used.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logloom.functions.jsontext import _ESCAPES
from logloom.functions.paths import rewrite_leaves

#: Levels of nesting of a shape; texts nested deeper are misfits.
MAX_LEVELS = 16

# Scalars that every writer prints alike: no exponents, no digits beyond a double's.
_SCALAR = r"VOID|BOOLEAN|STRING|BIGINT|DECIMAL\((?:\d|1[0-5]),[0-4]\)"
# Escapes that writers spell differently, and a zero with a sign.
_ODD_TEXT = r"\\(?:[bf]|u(?:00[01]|[dD][89a-fA-F]))|-0\.0"
_LIKE_JSON = r'^[ \t\n\r]*(?:[\[{"]|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[ \t\n\r]*$|(?:true|false|null)[ \t\n\r]*$)'


@dataclass(frozen=True)
class Shape:
    """The type that holds the texts it was found in, but for ``misfits`` of them."""

    dtype: T.DataType
    misfits: int = 0


def parsed(text: Column) -> Column:
    """The text in brackets as a VARIANT, NULL if it is not JSON: the parser would not mind what follows a value."""
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))


def odd(text: Column) -> Column:
    return text.rlike(_ODD_TEXT)


def like_json(text: Column) -> Column:
    """Whether the text may be JSON; surely true of all that is, NULL of NULL."""
    return text.rlike(_LIKE_JSON)


def kind_of(dtype: T.DataType):
    """A type as nested plain values: a dict for an object, a list of one for an array, else a word.

    "any" is what the type does not tell, "number" one that writers may print differently.
    """
    if isinstance(dtype, T.StructType):
        return {f.name: kind_of(f.dataType) for f in dtype.fields}
    if isinstance(dtype, T.ArrayType):
        return [kind_of(dtype.elementType)]
    if isinstance(dtype, T.VariantType):
        return "any"
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.NullType):
        return "null"
    plain = isinstance(dtype, T.LongType | T.BooleanType) or isinstance(dtype, T.DecimalType) and dtype.precision <= 15 and dtype.scale <= 4
    return "scalar" if plain else "number"


def read_shape(ddl: str):
    """The kind that ``schema_of_variant`` describes, None if it cannot be read or is nested too deep."""
    named = re.sub(r"`(?:[^`]|``)*`|OBJECT(?=<)", lambda m: m[0] if m[0][0] == "`" else "STRUCT", ddl)
    if ddl.count("<") > MAX_LEVELS and _levels(ddl) > MAX_LEVELS:
        return None
    try:
        return kind_of(T.DataType.fromDDL(named))
    except Exception:  # noqa: BLE001 - a name the parser refuses: its texts are misfits
        return None


def _levels(ddl: str) -> int:
    level = deepest = 0
    for mark in re.findall(r"`(?:[^`]|``)*`|[<>]", ddl):
        level += {"<": 1, ">": -1}.get(mark, 0)
        deepest = max(deepest, level)
    return deepest


def merge(a, b, in_array: bool = False):
    """The kind that holds what both hold; where none can (an object and a string), it is ``a``."""
    if isinstance(a, dict) and isinstance(b, dict):
        merged, folded = {}, {}
        for name in [*a, *b]:
            # a name that differs in case only, or sorts differently in UTF-16, stays a misfit
            if name and name not in merged and max(name) < "\ud800" and folded.setdefault(name.lower(), name) == name:
                merged[name] = merge(a.get(name, b.get(name)), b.get(name, a.get(name)))
        return merged
    if isinstance(a, list) and isinstance(b, list):
        return [merge(a[0], b[0], in_array=True)]
    if isinstance(a, dict | list) or isinstance(b, dict | list):
        return b if a == "null" else a
    if in_array and "null" in (a, b):
        return b if a == "null" else a
    return a if a == b else "scalar"


def holds(kind, other) -> bool:
    """Whether every text of the kind ``other`` surely fits ``kind``."""
    if isinstance(kind, dict) and isinstance(other, dict):
        return all(name in kind and holds(kind[name], inner) for name, inner in other.items())
    if isinstance(kind, list) and isinstance(other, list):
        return other[0] == "null" or holds(kind[0], other[0])
    if isinstance(kind, dict | list) or isinstance(other, dict | list) or other in ("any", "number"):
        return False
    return kind != "string" or other == "string"


def leaves(kind) -> int:
    inner = kind.values() if isinstance(kind, dict) else kind if isinstance(kind, list) else None
    return 1 if inner is None else sum(map(leaves, inner))


def type_of(kind) -> T.DataType:
    """Strings are strings; any other scalar stays a VARIANT, so it is written as it was read."""
    if isinstance(kind, dict):
        return T.StructType([T.StructField(name, type_of(kind[name])) for name in sorted(kind)])
    if isinstance(kind, list):
        return T.ArrayType(type_of(kind[0]))
    return T.StringType() if kind == "string" else T.VariantType()


def _ddl(dtype: T.DataType) -> str:
    if isinstance(dtype, T.StructType):
        fields = [f"`{f.name.replace('`', '``')}`: {_ddl(f.dataType)}" for f in dtype.fields]
        return f"STRUCT<{', '.join(fields)}>"
    return f"ARRAY<{_ddl(dtype.elementType)}>" if isinstance(dtype, T.ArrayType) else dtype.simpleString()


def rewrite_shaped(text: Column, shape: Shape, leaf) -> Column:
    """Canonical JSON with ``leaf(path, column, type)`` applied as in ``rewrite_leaves``; NULL for a misfit.

    A VARIANT leaf is a scalar. Equal to what ``jsontext.rewrite`` gives for the same text.
    """
    whole = T.ArrayType(shape.dtype)

    def scalars_only(path, column, dtype):
        if isinstance(dtype, T.VariantType):
            return F.when(F.schema_of_variant(column).rlike(f"^(?:{_SCALAR})$"), column)
        return None

    def pair(variant):
        typed = rewrite_leaves(F.try_variant_get(variant, "$", _ddl(whole)), whole, scalars_only)
        return F.struct(typed.alias("typed"), F.to_json(variant).alias("json"))

    def below(path, column, dtype):  # the brackets are not part of a path
        return leaf(path[2:] if isinstance(path, str) else F.substring(path, 3, 1 << 30), column, dtype)

    def written(p):
        typed = p.getField("typed")
        fits = (F.size(typed) == 1) & (F.to_json(typed) == p.getField("json"))
        changed = F.to_json(rewrite_leaves(typed, whole, below))
        return F.when(fits, F.substring(changed, 2, F.length(changed) - 2))

    # a lambda binds what it is given, so a text is parsed once
    bound = F.transform(F.transform(F.array(parsed(F.when(~odd(text), text))), pair), written)[0]
    for char, escape in _ESCAPES.items():
        bound = F.replace(bound, F.lit(char), F.lit(escape))
    return bound


def shaped_or(text: Column, shape: Shape, leaf, helper) -> Column:
    """``rewrite_shaped``; ``helper`` (Column -> Column) takes the misfits, and is not planned if there were none.

    Should a text then still not fit (the rows have changed since), the job fails rather than let it pass unseen.
    NULL where the text is not JSON.
    """
    typed = rewrite_shaped(text, shape, leaf)
    if shape.misfits:
        return F.coalesce(typed, helper(F.when(typed.isNull() & like_json(text), text)))
    failed = F.raise_error(F.lit("a JSON text does not fit the discovered shape")).cast("string")
    return F.coalesce(typed, F.when(like_json(text), failed))
