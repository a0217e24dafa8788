"""Chat formatting: records of many layouts become canonical turns, then training text with a loss mask.

A record is a VARIANT. Its layout is the set of its nested field paths; a hash of that set, the schema
fingerprint, selects a declarative mapping that says where conversation, turn, role and text stand. Layouts
that nobody declared are kept apart with their paths. All of it is built-in functions: no Python sees a row.

A template marks turns with control strings. Where a text holds one, an escape character goes behind its
first character (one more if some stand there already), so marks stay the template's own and texts come
back exactly.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
_TURN = "struct<turn: bigint, role: string, text: string>"
#: How a schema is written down: a scalar's type does not belong to a layout, its path does.
_SCALAR = r": (?!OBJECT<|ARRAY<)[A-Z][A-Z ]*(?:\([0-9, ]*\))?|(?<=ARRAY<)(?!OBJECT<|ARRAY<)[A-Z][A-Z ]*(?:\([0-9, ]*\))?"


@dataclass(frozen=True)
class Layout:
    """A declared layout: its field paths (``a``, ``a.b``, ``a[].b``) and where things stand in it.

    ``turns`` lists (role, path) of fixed parts in order; or ``items`` is the path of an array whose
    elements have ``role`` and ``text``; or, with ``turn``, one record is one turn of conversation ``key``.
    ``optional`` paths may be missing. ``roles`` renames roles.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    turn: str = ""
    key: str = ""
    roles: dict[str, str] = field(default_factory=lambda: dict(ROLES), hash=False)

    def shapes(self) -> list[str]:
        """The canonical forms of the path sets this layout has."""
        return [shape((*self.paths, *some)) for n in range(len(self.optional) + 1) for some in combinations(self.optional, n)]


LAYOUTS = (
    Layout("turn rows", ("conv_id", "turn", "role", "text"), key="conv_id", turn="turn", role="role", text="text", roles={}),
    Layout("messages", ("messages[].role", "messages[].content"), ("id",), items="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), ("id", "system"), (("system", "system"),), "conversations", "from", "value"),
    Layout("instruction", ("instruction", "output"), ("id", "input", "system"), (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt", ("prompt", "response"), ("id", "system"), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("completion", ("prompt", "completion"), ("id",), (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", ("question", "answer"), ("id", "context"), (("user", "context"), ("user", "question"), ("assistant", "answer"))),
    Layout("nested", ("data.prompt", "data.messages[].role", "data.messages[].content"), ("id",), (("system", "data.prompt"),), "data.messages", "role", "content"),
)


def shape(paths: Sequence[str]) -> str:
    """The canonical form of a set of field paths, as ``record_shape`` writes that of a record."""
    tree: dict = {}
    for path in paths:
        at = tree
        for part in path.split("."):
            at = at.setdefault(part, {})

    def written(node: dict) -> str:
        parts = []
        for name in sorted(node):
            plain, depth = name.replace("[]", ""), name.count("[]")
            inner = written(node[name]) if node[name] else ""
            parts.append(f"{plain}: {'ARRAY<' * depth}{inner}{'>' * depth}" if depth or inner else plain)
        return f"OBJECT<{', '.join(parts)}>"

    return written(tree)


def record_shape(record: Column) -> Column:
    """The set of a record's nested field paths in canonical form; null for a null record."""
    return F.regexp_replace(F.schema_of_variant(record), _SCALAR, "")


def fingerprint(record: Column) -> Column:
    """The schema fingerprint: a 64-bit hash of the record's field paths."""
    return F.xxhash64(record_shape(record))


def _get(record: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(record, "$." + path, kind)


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    for old, new in roles.items():
        role = F.when(role == old, new).otherwise(role)
    return role


def _turns(record: Column, layout: Layout) -> Column:
    """The turns of one record as array<struct<turn, role, text>>; null texts are empty, missing parts are left out."""
    if layout.turn:
        role = _renamed(_get(record, layout.role, "string"), layout.roles)
        return F.array(F.struct(_get(record, layout.turn, "bigint").alias("turn"), role.alias("role"), _get(record, layout.text, "string").alias("text")))
    fixed = F.array(*[F.struct(F.lit(None).cast("bigint").alias("turn"), F.lit(role).alias("role"), _get(record, path, "string").alias("text")) for role, path in layout.turns])
    fixed = F.filter(fixed.cast(f"array<{_TURN}>"), lambda t: t.getField("text").isNotNull())
    if not layout.items:
        return fixed
    items = F.transform(
        F.coalesce(_get(record, layout.items, "array<variant>"), F.array().cast("array<variant>")),
        lambda i: F.struct(F.lit(None).cast("bigint").alias("turn"), _renamed(_get(i, layout.role, "string"), layout.roles).alias("role"), _get(i, layout.text, "string").alias("text")),
    )
    return F.concat(fixed, items.cast(f"array<{_TURN}>"))


def _chosen(column: Column, layouts: Sequence[Layout], made) -> Column:
    """``made(layout)`` of the layout that the fingerprint selects; null if none does."""
    choice = None
    for layout in layouts:
        hit = column.isin([F.xxhash64(F.lit(s)) for s in layout.shapes()])
        choice = F.when(hit, made(layout)) if choice is None else choice.when(hit, made(layout))
    return choice


def canonical_turns(records: DataFrame, record: str = "record", key: str | None = None, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """conversation key, layout and ``turns``: array<struct<role, text>> in order.

    ``record`` is a VARIANT column, or a string of JSON. Records of whole conversations give one row each,
    named by column ``key`` (null without it), and move nowhere. Records that are one turn are gathered by
    the key in the record: one shuffle, ordered by turn, then role, then text, nulls first; repeated rows are
    turns of their own, and a conversation is one row, so it has to fit one. Null texts are empty. Records
    of no declared layout, and strings that are not JSON, have a null layout, null turns and their
    ``shape``, for which one may declare a mapping. An empty table gives none.
    """
    asked = F.try_parse_json(F.col(record)) if records.schema[record].dataType.simpleString() == "string" else F.col(record)
    name = F.lit(None).cast("string") if key is None else F.col(key).cast("string")
    read = records.select(asked.alias("r"), name.alias("name"))
    read = read.select("r", "name", record_shape(F.col("r")).alias("shape"))
    read = read.select("r", "name", "shape", F.xxhash64("shape").alias("fingerprint"))
    mapped = read.select(
        "name",
        "shape",
        _chosen(F.col("fingerprint"), layouts, lambda x: F.lit(x.name)).alias("layout"),
        _chosen(F.col("fingerprint"), layouts, lambda x: _turns(F.col("r"), x)).alias("turns"),
        _chosen(F.col("fingerprint"), layouts, lambda x: _get(F.col("r"), x.key, "string") if x.key else F.lit(None).cast("string")).alias("key"),
    )
    single = [x.name for x in layouts if x.turn]
    plain = F.transform("turns", lambda t: F.struct(t.getField("role").alias("role"), F.coalesce(t.getField("text"), F.lit("")).alias("text"))).alias("turns")
    of_one = F.col("layout").isNotNull() & F.col("layout").isin(single)
    whole = mapped.filter(~of_one | F.col("layout").isNull()).select(F.col("name").alias("key"), "layout", "shape", plain)
    if not single:
        return whole
    turn = F.col("turns")[0]
    ordered = F.struct(turn["turn"].alias("turn"), turn["role"].alias("role"), F.coalesce(turn["text"], F.lit("")).alias("text"))
    gathered = mapped.filter(of_one).groupBy("key", "layout").agg(F.array_sort(F.collect_list(ordered)).alias("turns"))
    return gathered.select("key", "layout", F.lit(None).cast("string").alias("shape"), plain).unionByName(whole)


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9])", r"\\\1", text)


@dataclass(frozen=True)
class Template:
    """Marks of turns. A user's text stands between two, an assistant's is ended by one, other roles are named.

    Control strings begin with a character that none of them holds further on: then nothing a text and a
    mark make together can look like a mark.
    """

    user: tuple[str, str] = ("[INST]", "[/INST]")
    assistant_end: str = "</s>"
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    begin: str = "<s>"
    escape: str = "\\"

    def __post_init__(self):
        heads = {c[:1] for c in self.controls}
        if "" in heads or self.escape in heads or len(self.escape) != 1 or len(set(self.controls)) < 7 or any(h in c[1:] for h in heads for c in self.controls):
            raise ValueError("control strings must differ and start with characters that they hold nowhere else, the escape not among them")

    @property
    def controls(self) -> tuple[str, ...]:
        return (*self.user, self.assistant_end, *self.other, self.begin)

    def _heads(self, behind: str) -> str:
        """A pattern for the first characters of control strings with ``behind`` after them and any escapes."""
        heads = sorted({c[0] for c in self.controls})
        rests = {h: "|".join(_quoted(c[1:]) for c in self.controls if c[0] == h) for h in heads}
        return "|".join(f"(?<={_quoted(h)}){behind}(?={_quoted(self.escape)}*(?:{r}))" for h, r in rests.items())

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._heads(""), _quoted(self.escape))

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, self._heads(_quoted(self.escape)), "")

    def segments(self, turns: Column) -> Column:
        """The formatted conversation as array<struct<text, loss>>: the text under the mask is the assistant's."""
        part = lambda text, loss: F.struct(text.alias("text"), F.lit(loss).alias("loss"))

        def of(turn: Column) -> Column:
            role, text = turn.getField("role"), self.escaped(turn.getField("text"))
            user = part(F.concat(F.lit(self.user[0]), text, F.lit(self.user[1])), False)
            named = F.concat(F.lit(self.other[0]), self.escaped(F.coalesce(role, F.lit(""))), F.lit(self.other[1]), text, F.lit(self.other[2]))
            return (
                F.when(role == "user", F.array(user))
                .when(role == "assistant", F.array(part(text, True), part(F.lit(self.assistant_end), False)))
                .otherwise(F.array(part(named, False)))
            )

        return F.concat(F.array(part(F.lit(self.begin), False)), F.flatten(F.transform(turns, of)))

    def read(self, formatted: Column) -> Column:
        """array<struct<role, text>> of a formatted conversation; a role that was null comes back empty."""
        q = _quoted
        marked = f"{q(self.user[0])}.*?{q(self.user[1])}|{q(self.other[0])}.*?{q(self.other[2])}|.*?{q(self.assistant_end)}"
        body = F.substr(formatted, F.lit(len(self.begin) + 1))
        pieces = F.regexp_extract_all(body, F.lit(f"(?s)({marked})"), F.lit(1))

        def of(piece: Column) -> Column:
            inner = lambda head, tail: F.substr(piece, F.lit(len(head) + 1), F.char_length(piece) - len(head) - len(tail))
            named = inner(self.other[0], self.other[2])
            parts = F.split(named, q(self.other[1]), 2)
            made = lambda role, text: F.struct(role.alias("role"), self.unescaped(text).alias("text"))
            return (
                F.when(piece.startswith(self.user[0]), made(F.lit("user"), inner(*self.user)))
                .when(piece.startswith(self.other[0]), made(self.unescaped(parts[0]), parts[1]))
                .otherwise(made(F.lit("assistant"), inner("", self.assistant_end)))
            )

        return F.transform(pieces, of)


def format_conversations(conversations: DataFrame, template: Template = Template(), key: str = "key", turns: str = "turns") -> DataFrame:
    """key, ``segments`` (texts with their loss mask, in order; joined they are the formatted text) per conversation.

    Only assistants' texts are under the mask, without the mark that ends them. Rows without turns are left out.
    """
    known = conversations.filter(F.col(turns).isNotNull())
    return known.select(F.col(key), template.segments(F.col(turns)).alias("segments"))


def formatted_text(segments: Column) -> Column:
    return F.array_join(F.transform(segments, lambda s: s.getField("text")), "")


def loss_text(segments: Column, template: Template = Template()) -> Column:
    """All text under the loss mask, unescaped piece by piece."""
    under = F.filter(segments, lambda s: s.getField("loss"))
    return F.array_join(F.transform(under, lambda s: template.unescaped(s.getField("text"))), "")


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def digests(formatted: DataFrame, template: Template = Template(), key: str = "key") -> DataFrame:
    """What formatted conversations hold, read back from them: key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    texts = formatted.select(key, formatted_text(F.col("segments")).alias("t"), loss_text(F.col("segments"), template).alias("loss"))
    read = texts.select(key, "t", "loss", template.read(F.col("t")).alias("turns"))
    lines = F.transform("turns", lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    return read.select(
        key,
        F.size("turns").cast("long").alias("n_turns"),
        _sha256(F.array_join(lines, "")).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        _sha256(F.col("loss")).alias("loss_sha256"),
        F.char_length("t").cast("long").alias("formatted_chars"),
    )
