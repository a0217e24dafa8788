"""Rule patterns are written in RE2 syntax; Spark runs java.util.regex.

``to_java_regex`` restates a rule so that both engines find the same matches, and
refuses the two things that cannot be restated safely.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# RE2 treats only ASCII letters, digits and "_" as word characters at a boundary.
WORD_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
NOT_WORD_EDGE = r"(?:(?<=\w)(?=\w)|(?<!\w)(?!\w))"

# RE2 escapes whose Java meaning differs, outside and inside a character class.
_OUTSIDE = {"b": WORD_EDGE, "B": NOT_WORD_EDGE, "s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "v": r"\x0B"}
_INSIDE = {"s": r"\t\n\f\r ", "v": r"\x0B"}
_TOKEN = re.compile(
    r"\\Q.*?(?:\\E|$)|\\[pP]\{[^}]*\}|\\x\{[0-9A-Fa-f]+\}|\\.|\(\?P?<\w+>|\(\?[a-zA-Z-]*[:)]"
    r"|\[:\^?\w+:\]|\[\^?\]?|\{\d+(?:,\d*)?\}|.",
    re.S,
)
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_POSIX_NAMES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl",
    "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct",
    "space": "Space", "upper": "Upper", "word": "w", "xdigit": "XDigit",
}

_POSIX_RANGES = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7f", "blank": r"\t ", "cntrl": r"\x00-\x1f\x7f",
    "digit": "0-9", "graph": "!-~", "lower": "a-z", "print": " -~", "punct": r"!-/:-@\[-`{-~",
    "space": r"\t-\r ", "upper": "A-Z", "word": r"\w", "xdigit": "0-9A-Fa-f",
}


# For word edges next to a token that is surely a word character.
_WORD = re.compile(r"\\[dw]|\w", re.ASCII)
_QUANTIFIER = re.compile(r"[*+?]|\{\d+(?:,\d*)?\}")
_OPTIONAL = re.compile(r"[*?]|\{0+[,}]")


class UnsafePattern(ValueError):
    """A rule pattern that has no equivalent which is safe to run on an executor."""


def to_java_regex(pattern: str) -> str:
    """Restate an RE2 pattern for java.util.regex; raise UnsafePattern where that is impossible.

    Java matches a repeated group by recursion, so an unbounded group over text of unknown
    length can overflow an executor's stack. At the end of a pattern the group is made
    possessive, which finds the same match without recursion. Elsewhere a group of two runs of
    disjoint classes, such as ``(\\w+\\.)+com``, is restated without recursion (see ``_flat_rounds``);
    any other is refused.
    """
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    if re.search(r"\(\?[a-zA-Z]*U", pattern):
        raise UnsafePattern(f"ungreedy flag is not supported: {pattern!r}")
    tokens = _TOKEN.findall(pattern)
    out = ["(?d)"]  # only \n ends a line
    depth: list[int] = []  # index in `tokens` of each open group
    closed_at: dict[int, int] = {}
    in_class = False
    class_start = -1
    for i, token in enumerate(tokens):
        if in_class:
            if token == "]" and i > class_start:
                in_class = False
                out.append("]")
            elif token.startswith("[:"):
                negate, name = _POSIX.fullmatch(token).groups()
                if name not in _POSIX_NAMES:
                    raise UnsafePattern(f"unknown class {token} in {pattern!r}")
                letter = _POSIX_NAMES[name]
                if name == "word":
                    out.append(r"\W" if negate else r"\w")
                else:
                    out.append((r"\P{" if negate else r"\p{") + letter + "}")
            elif token[0] == "[":
                out.append("".join("\\" + c if c in "[&" else c for c in token))
            elif token == "&":
                out.append(r"\&")
            elif token[0] == "\\":
                out.append(_INSIDE.get(token[1:], _escape(token)))
            else:
                out.append(token)
            continue
        if token[0] == "[":
            in_class, class_start = True, i
            out.append(token if not token.endswith("]") else token[:-1] + r"\]")
        elif token == r"\b" and _starts_with_word(tokens, i + 1):
            out.append(r"(?<!\w)")
        elif token == r"\b" and _ends_with_word(tokens, i - 1):
            out.append(r"(?!\w)")
        elif token[0] == "\\":
            out.append(_OUTSIDE.get(token[1:], _escape(token)))
        elif token[0] == "(":
            if not (token.startswith("(?") and token.endswith(")")):
                depth.append(i)
            out.append(token.replace("(?P<", "(?<"))
        elif token == ")":
            closed_at[i] = depth.pop()
            out.append(token)
        elif token == "$":
            out.append(r"(?=\n|\z)" if multiline else r"\z")
        elif token == "^":
            out.append(r"(?:\A|(?<=\n))" if multiline else r"\A")
        elif tokens[i + 1 : i + 2] != ["+"] and _unbounded(token) and i - 1 in closed_at and _varies(tokens[closed_at[i - 1] + 1 : i - 1]):
            rest = [t for t in tokens[i + 1 :] if t != ")"]
            flat = _flat_rounds(tokens, out, closed_at[i - 1], i, pattern) if rest else token + "+"
            if flat is None:
                raise UnsafePattern(f"unbounded group before {''.join(rest)!r} in {pattern!r}")
            out.append(flat)
        else:
            out.append(token)
    if _may_be_empty(pattern):
        out.append(r"(?:\A|(?!\G))")  # an empty match right after a match does not count
    return "".join(out)


# Lookbehinds of a restated group are as long as its counts, so these stay small.
MAX_COUNT = 255
_PLAIN_GROUP = re.compile(r"\(|\(\?:|\(\?P?<\w+>")


def _flat_rounds(tokens: list[str], out: list[str], opened: int, at: int, pattern: str) -> str | None:
    """What to write instead of the quantifier at ``at``, so that no group repeats without bound; None if unproven.

    For a group ``P{a,b}Q{c,d}`` whose classes P and Q share no character, a text splits into rounds in
    one way only, and the ends at which a greedy loop may stop, from the longest, are those of a run over
    ``[PQ]`` in which lookbehinds hold every inner run to its counts. ``(PQ){n,}`` thus becomes
    ``(PQ){n}`` and an optional run of single characters, which Java matches without recursion.
    """
    least = {"+": 1, "*": 0}.get(tokens[at]) if tokens[at] in "+*" else int(tokens[at][1:-2])
    pieces = _pieces(tokens, out, opened + 1, at - 1)
    if tokens[at + 1] == "?" or not 1 <= least <= MAX_COUNT or not _PLAIN_GROUP.fullmatch(tokens[opened]) or pieces is None:
        return None
    (p, p_set, a, b), (q, q_set, c, d) = pieces
    letters = _characters(p_set, pattern), _characters(q_set, pattern)
    if None in letters or letters[0] & letters[1] or not (1 <= a <= MAX_COUNT and 1 <= c <= MAX_COUNT) or max(b or 0, d or 0) > MAX_COUNT:
        return None
    held = [
        f"(?<!{q}{p}{{1,{a - 1}}}{q})" if a > 1 else "", f"(?<!{p}{{{b + 1}}})" if b else "",
        f"(?<!{p}{q}{{1,{c - 1}}}{p})" if c > 1 else "", f"(?<!{q}{{{d + 1}}})" if d else "",
    ]
    count = "" if least == 1 else f"{{{least}}}"
    return f"{count}(?:(?={p})(?:[{p}{q}]{''.join(held)})+(?<={q}{{{c}}}))?"


def _pieces(tokens: list[str], out: list[str], start: int, end: int) -> list[tuple[str, str, int, int | None]] | None:
    """The group's two character classes with their counts: (Java class, RE2 text, least, most)."""
    found, i = [], start
    while i < end:
        first = i
        if tokens[i] == "[" or tokens[i] == "[^":
            i = tokens.index("]", i + 1)
        elif tokens[i][0] in "[(|^$*+?{.)" or tokens[i].startswith((r"\Q", r"\b", r"\B", r"\A", r"\z")):
            return None
        i += 1
        java, text = "".join(out[first + 1 : i + 1]), "".join(tokens[first:i])
        if text[0] not in "[\\":
            java = re.sub(r"([^0-9A-Za-z\x80-\U0010ffff])", r"\\\1", java)
        low, high = 1, 1
        if i < end and _QUANTIFIER.fullmatch(tokens[i]):
            counts = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(tokens[i])
            if counts is None:
                least, comma, most = tokens[i][1:-1].partition(",")
                counts = int(least), int(most) if most else None if comma else int(least)
            (low, high), i = counts, i + 1
        found.append((java, text, low, high))
    return found if len(found) == 2 else None


def _characters(text: str, pattern: str) -> set[int] | None:
    """The ASCII characters of a class, and 128 for any beyond; more than it has where case is ignored."""
    folded = re.IGNORECASE if re.search(r"\(\?[a-zA-Z]*i", pattern) else 0
    try:
        compiled = re.compile(python_regex(text).pattern, re.ASCII | folded)
    except (re.error, UnsafePattern):
        return None
    wide = re.search(r"\[\^|\\[WDSxpP]|\[:\^|[^\x00-\x7f]", text) is not None
    return {c for c in range(128) if compiled.fullmatch(chr(c))} | ({128} if wide or folded and compiled.search("\u017f\u212a") else set())


def _starts_with_word(tokens: list[str], i: int) -> bool:
    """Whether the text matched from token ``i`` on surely begins with a word character."""
    if i < len(tokens) and tokens[i] == "[" and "]" in tokens[i:]:
        end = tokens.index("]", i)
        word = _word_class(tokens[i + 1 : end])
    else:
        end = i
        word = i < len(tokens) and _WORD.fullmatch(tokens[i]) is not None
    return word and not _OPTIONAL.match("".join(tokens[end + 1 : end + 2]))


def _ends_with_word(tokens: list[str], i: int) -> bool:
    """Whether the text matched up to token ``i`` surely ends with a word character."""
    if i >= 0 and tokens[i] == "?" and i > 0 and _QUANTIFIER.fullmatch(tokens[i - 1]):
        i -= 1
    if i >= 0 and _QUANTIFIER.fullmatch(tokens[i]):
        if _OPTIONAL.match(tokens[i]):
            return False
        i -= 1
    if i >= 0 and tokens[i] == "]" and "[" in tokens[:i]:
        start = i - 1 - tokens[:i][::-1].index("[")
        return _word_class(tokens[start + 1 : i])
    return i >= 0 and _WORD.fullmatch(tokens[i]) is not None


def _word_class(inside: list[str]) -> bool:
    return re.fullmatch(r"(?:\\[dw]|a-z|A-Z|0-9|\w)+", "".join(inside), re.ASCII) is not None


def _may_be_empty(pattern: str) -> bool:
    try:
        compiled = python_regex(pattern)
    except (re.error, UnsafePattern):
        return True
    return any(not found.group() for text in ("", "a", "-", "a -") for found in compiled.finditer(text))


def _escape(token: str) -> str:
    name = re.fullmatch(r"\\([pP])\{(\^?)(\w+)\}", token)
    if name and len(name.group(3)) > 2:
        return rf"\{name.group(1)}{{Is{name.group(3)}}}"
    return token


def _unbounded(token: str) -> bool:
    return token in "*+" or re.fullmatch(r"\{\d+,\}", token) is not None


def _varies(body: list[str]) -> bool:
    """Whether one round of a group can match texts of different lengths."""
    return any(t in "*+?|" or re.fullmatch(r"\{\d+,\d*\}", t) for t in body)


def python_regex(pattern: str) -> re.Pattern:
    """The same rule for Python: field paths while planning, JSON leaves inside Arrow batches.

    Raises UnsafePattern for what Python cannot say: Unicode properties and unknown named classes.
    """
    multiline = re.search(r"\(\?[a-zA-Z]*m", pattern) is not None
    out, in_class, class_start = [], False, -1
    for i, token in enumerate(_TOKEN.findall(pattern)):
        if re.match(r"\\[pPC]", token):
            raise UnsafePattern(f"{token} is not supported in a path: {pattern!r}")
        if token.startswith(r"\Q"):
            out.append(re.escape(token[2:].removesuffix(r"\E")))
        elif token.startswith(r"\x{"):
            out.append(re.escape(chr(int(token[3:-1], 16))))
        elif in_class:
            in_class = token != "]" or i == class_start
            out.append(_python_inside(token, pattern))
        elif token[0] == "[":
            in_class, class_start = True, i
            out.append(token if not token.endswith("]") else token[:-1] + r"\]")
        elif token == "$" and not multiline or token == r"\z":
            out.append(r"\Z")
        elif token == r"\s":
            out.append(r"[\t\n\f\r ]")
        elif token == r"\S":
            out.append(r"[^\t\n\f\r ]")
        elif re.match(r"\(\?<\w", token):
            out.append(token.replace("(?<", "(?P<"))
        else:
            out.append(token)
    return re.compile("".join(out), re.ASCII)


def _python_inside(token: str, pattern: str) -> str:
    """A token within a character class; "[", "&", "|" and "~" are plain there."""
    if token.startswith("[:"):
        negate, name = _POSIX.fullmatch(token).groups()
        if name not in _POSIX_RANGES:
            raise UnsafePattern(f"unknown class {token} in {pattern!r}")
        if not negate:
            return _POSIX_RANGES[name]
        inside = re.compile(f"[{_POSIX_RANGES[name]}]")
        return "".join(re.escape(chr(c)) for c in range(128) if not inside.match(chr(c))) + r"\x80-\U0010ffff"
    if token == r"\s":
        return r"\t\n\f\r "
    if token[0] == "\\":
        return token
    return "".join("\\" + c if c in "[&|~" else c for c in token)


def literal(replacement: str) -> str:
    """Quote a replacement so that "$" and backslash stand for themselves."""
    return replacement.replace("\\", "\\\\").replace("$", "\\$")


def replace_all(text: Column, java_pattern: str, replacement: str) -> Column:
    return F.regexp_replace(text, java_pattern, literal(replacement))


def map_matches(text: Column, java_pattern: str, change) -> Column:
    """Replace every match by ``change(match)``, a Column function of the matched text."""
    between = F.split(text, java_pattern, -1)
    matches = F.regexp_extract_all(text, F.lit(java_pattern), F.lit(0))
    pieces = F.zip_with(
        between, matches, lambda gap, match: F.when(match.isNull(), gap).otherwise(F.concat(gap, change(match)))
    )
    return F.array_join(pieces, "")
