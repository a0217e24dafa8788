"""JSON text of unknown shape: parse, change leaves, write back. Used by Arrow-batched UDFs only.

The output is canonical: sorted keys, no spaces, "<", ">" and "&" escaped.
"""

from __future__ import annotations

import json
import math
import sys

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters a canonical JSON string escapes beyond the JSON minimum.
_ESCAPES = {"<": "\\u003c", ">": "\\u003e", "&": "\\u0026", "\u2028": "\\u2028", "\u2029": "\\u2029"}

#: Levels of nesting that count as JSON, and digits from which a whole number is kept as text.
MAX_DEPTH = 9000
MAX_DIGITS = 4000


class _Digits(float):
    """A whole number with more digits than ``int`` reads; it is written as it was found."""

    def __new__(cls, token: str):
        made = super().__new__(cls, token)
        made.token = token
        return made


def plain_number(value) -> str:
    """Decimal digits without an exponent for whole numbers."""
    if isinstance(value, _Digits):
        return value.token
    if isinstance(value, int) or value.is_integer():
        return str(int(value))
    return repr(value)


def short_number(value, low: int = -4, high: int = 6) -> str:
    """Shortest digits of a double, with an exponent below 1e``low`` and from 1e``high`` upward."""
    if isinstance(value, _Digits):
        return value.token
    value = float(value)
    if value == 0:
        return "-0" if math.copysign(1, value) < 0 else "0"
    mantissa, _, exponent = f"{value!r}".partition("e")
    digits = mantissa.replace("-", "").replace(".", "")
    power = int(exponent or 0) + len(mantissa.replace("-", "").split(".")[0]) - 1
    stripped = digits.lstrip("0")
    power -= len(digits) - len(stripped)
    stripped = stripped.rstrip("0")
    sign = "-" if value < 0 else ""
    if power < low or power >= high:
        tail = f".{stripped[1:]}" if len(stripped) > 1 else ""
        return f"{sign}{stripped[0]}{tail}e{'-' if power < 0 else '+'}{abs(power):02d}"
    if power < 0:
        return f"{sign}0.{'0' * (-power - 1)}{stripped}"
    whole, part = stripped[: power + 1].ljust(power + 1, "0"), stripped[power + 1 :]
    return f"{sign}{whole}.{part}" if part else f"{sign}{whole}"


def _json_number(value) -> str:
    if isinstance(value, _Digits):
        return value.token
    if isinstance(value, int) and not isinstance(value, bool):
        return str(value)
    text = short_number(value, low=-6, high=21)
    return text.replace("e-0", "e-").replace("e+0", "e+")


def _string(value: str) -> str:
    text = json.dumps(value, ensure_ascii=False).replace("\\b", "\\u0008").replace("\\f", "\\u000c")
    for char, escape in _ESCAPES.items():
        text = text.replace(char, escape)
    return text


def _write(value, path: str, leaf) -> str:
    if isinstance(value, dict):
        parts = [f"{_string(k)}:{_write(value[k], f'{path}.{k}', leaf)}" for k in sorted(value)]
        return "{" + ",".join(parts) + "}"
    if isinstance(value, list):
        return "[" + ",".join(_write(v, f"{path}[]", leaf) for v in value) + "]"
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    changed = leaf(path, value)
    return _string(changed) if isinstance(changed, str) else _json_number(changed)


def _reject(token):
    raise ValueError(f"not a JSON number: {token}")


def _number(token):
    value = float(token)
    if math.isinf(value):
        raise ValueError(f"number out of range: {token}")
    return value


def _whole(token):
    return int(token) if len(token) <= MAX_DIGITS else _Digits(token)


def rewrite(text: str | None, leaf, objects_only: bool = False) -> str | None:
    """Canonical JSON with ``leaf(path, value)`` applied to strings and numbers; None if not JSON.

    Text nested deeper than ``MAX_DEPTH`` does not count as JSON.
    """
    if text is None:
        return None
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2 * MAX_DEPTH))  # one frame a level, none on the C stack
    try:
        value = json.loads(text, parse_constant=_reject, parse_float=_number, parse_int=_whole)
        if objects_only and not isinstance(value, dict):
            return None
        written = _write(value, "", leaf)
        return written.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    except (ValueError, RecursionError):
        return None


def rewriter(leaf, objects_only: bool = False, keep_other: bool = False):
    """A text → text pandas UDF around ``rewrite``; ``keep_other`` returns what is not JSON as it is."""

    def changed(text):
        done = rewrite(text, leaf, objects_only)
        return text if done is None and keep_other else done

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(changed).astype(object)

    run.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.StringType())
