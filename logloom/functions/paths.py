"""Rewrite the leaves of a typed nested column; the walk over the type happens while planning.

Only columns that actually contain a changed leaf are rebuilt, so a rule that matches nothing
costs nothing at run time and all work stays in built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rewrite_leaves(value: Column, dtype: T.DataType, leaf) -> Column:
    """Apply ``leaf(path, column, type) -> Column | None`` to every leaf; None keeps the leaf.

    ``path`` is the dotted path (".a.b", arrays add "[]", the root is ""). Below a map the key
    is data, so there the path is a Column instead of a string.
    """
    changed = _walk(value, dtype, "", leaf)
    return value if changed is None else changed


def _join(path, suffix):
    if isinstance(path, Column) or isinstance(suffix, Column):
        as_column = [p if isinstance(p, Column) else F.lit(p) for p in (path, suffix)]
        return F.concat(*as_column)
    return path + suffix


def _walk(value: Column, dtype: T.DataType, path, leaf) -> Column | None:
    if isinstance(dtype, T.StructType):
        fields = [
            (f.name, _walk(value.getField(f.name), f.dataType, _join(path, f".{f.name}"), leaf))
            for f in dtype.fields
        ]
        if all(changed is None for _, changed in fields):
            return None
        rebuilt = F.struct(
            *[
                (value.getField(name) if changed is None else changed).alias(name)
                for name, changed in fields
            ]
        )
        return F.when(value.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        below = _join(path, "[]")
        each = _Each(lambda item: _walk(item, dtype.elementType, below, leaf))
        made = F.transform(value, lambda item: each(item, item))
        return made if each.changed else None
    if isinstance(dtype, T.MapType):
        each = _Each(lambda item, key: _walk(item, dtype.valueType, _join(_join(path, "."), key.cast("string")), leaf))
        made = F.transform_values(value, lambda key, item: each(item, item, key))
        return made if each.changed else None
    return leaf(path, value, dtype)


class _Each:
    """The body of a lambda over items, which is walked once however deep it is nested."""

    def __init__(self, walk):
        self.walk, self.changed = walk, False

    def __call__(self, item, *given):
        made = self.walk(*given)
        self.changed = self.changed or made is not None
        return item if made is None else made
