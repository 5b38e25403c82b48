"""Chat records of many layouts as one training text each, with a mask of what is learned. DataFrame functions only.

A record is fingerprinted by the nested field paths that hold a value in it; the fingerprint selects one declarative
mapping, which turns the record into canonical turns (role, text). A template writes the turns out. Control strings
inside a text are broken up by an escape character, so no text can open or close a turn, and reading undoes it.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relops.columns import col

TURNS = "array<struct<role:string,text:string>>"
SPANS = "array<struct<start:int,end:int>>"
LEARNED = "assistant"

# Names that publishers of chat data give to the three usual roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

# Control strings of common chat templates, broken up in texts besides the template's own marks.
FOREIGN = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]


@dataclasses.dataclass(frozen=True)
class Template:
    """Marks around a turn: ``open`` role ``middle`` text ``close``, one turn after the other.

    Every control string starts with a character that occurs in it only there, has two characters or more and holds
    no escape character: so breaking it after the first character leaves none, and marks can be searched literally.
    """

    open: str = "<|turn|>"
    middle: str = "<|says|>"
    close: str = "<|end|>"
    escape: str = "\\"
    foreign: tuple[str, ...] = tuple(FOREIGN)

    def __post_init__(self) -> None:
        if len(self.escape) != 1:
            raise ValueError("the escape is one character")
        for mark in (self.open, self.middle, self.close):
            if len(mark) < 2 or mark[0] in mark[1:] or self.escape in mark:
                raise ValueError(f"{mark!r} cannot be a mark")
        if len({self.open, self.middle, self.close}) < 3:
            raise ValueError("the three marks must differ")
        for control in self.foreign:
            if len(control) < 2 or self.escape in control:
                raise ValueError(f"{control!r} cannot be escaped")

    def controls(self) -> list[str]:
        return list(dict.fromkeys([self.open, self.middle, self.close, *self.foreign]))


@dataclasses.dataclass(frozen=True)
class Said:
    """One turn of a layout: its role and the field with its text; ``lead`` fields that are set stand before it, a line each."""

    role: str
    field: str
    lead: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Layout:
    """How one kind of record becomes turns: single fields in an order, then a list of messages.

    ``roles`` renames roles of the list; others stay. ``required`` and ``optional`` are the field paths (``a``, ``a.b``,
    ``messages[].role``) that hold a value in such a record, of all paths that any layout knows.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    said: tuple[Said, ...] = ()
    list_field: str | None = None
    role_field: str = "role"
    text_field: str = "content"
    roles: Mapping[str, str] = dataclasses.field(default_factory=dict)

    def path_sets(self) -> Iterator[tuple[str, ...]]:
        for count in range(len(self.optional) + 1):
            for some in combinations(self.optional, count):
                yield tuple(sorted({*self.required, *some}))


def _asked(prompt: str, answer: str) -> Layout:
    turns = (Said("system", "system"), Said("user", prompt), Said(LEARNED, answer))
    return Layout(f"{prompt}_{answer}", (prompt, answer), ("system",), turns)


# The layouts known by default.
LAYOUTS = (
    Layout("messages", ("messages[].role",), ("messages[].content", "system"), (Said("system", "system"),), "messages"),
    Layout(
        "conversations",
        ("conversations[].from",),
        ("conversations[].value", "system"),
        (Said("system", "system"),),
        "conversations",
        "from",
        "value",
        ROLES,
    ),
    _asked("prompt", "response"),
    _asked("prompt", "completion"),
    _asked("question", "answer"),
    Layout(
        "instruction",
        ("instruction", "output"),
        ("input", "system"),
        (Said("system", "system"), Said("user", "input", lead=("instruction",)), Said(LEARNED, "output")),
    ),
)


def _paths(dtype: T.DataType, path: str, value: Column) -> Iterator[tuple[str, Column]]:
    """Every leaf path below a column with the condition that it holds a value."""

    if isinstance(dtype, T.StructType):
        for field in dtype.fields:
            yield from _paths(field.dataType, f"{path}.{field.name}", value[field.name])
    elif isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
        for field in dtype.elementType.fields:
            for inner, _ in _paths(field.dataType, f"{path}[].{field.name}", F.lit(None)):
                yield inner, F.coalesce(F.exists(value, _holds(dtype.elementType, inner[len(path) + 3 :])), F.lit(False))
    else:
        yield path, value.isNotNull()


def _holds(dtype: T.StructType, path: str):
    """The condition of a leaf inside one element of a list."""

    def check(element: Column) -> Column:
        found = [c for f in dtype.fields for p, c in _paths(f.dataType, f.name, element[f.name]) if p == path]
        return reduce(lambda a, b: a | b, found)

    return check


def field_paths(records: DataFrame) -> dict[str, Column]:
    """For each leaf path of the schema the condition that it holds a value in a row."""

    return {path: here for f in records.schema.fields for path, here in _paths(f.dataType, f.name, col(f.name))}


def fingerprint(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the field paths that hold a value in a record, of those that any layout knows."""

    known = {p for one in layouts for paths in one.path_sets() for p in paths}
    here = field_paths(records)
    return F.xxhash64(F.concat_ws("\n", *[F.when(here[p], F.lit(p)) for p in sorted(here) if p in known]))


def _literal_fingerprint(paths: Sequence[str]) -> Column:
    return F.xxhash64(F.lit("\n".join(paths)))


def _field(records: DataFrame, path: str) -> Column | None:
    """A plain field of the record as text, or None where the schema lacks it."""

    value, dtype = None, records.schema
    for name in path.split("."):
        if not isinstance(dtype, T.StructType) or name not in dtype.names:
            return None
        value = col(name) if value is None else value[name]
        dtype = dtype[name].dataType
    return value.cast("string")


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def _turns(records: DataFrame, layout: Layout) -> Column:
    parts = []
    for one in layout.said:
        fields = [f for f in (_field(records, p) for p in (*one.lead, one.field)) if f is not None]
        if fields:
            said = F.array(_turn(F.lit(one.role), F.concat_ws("\n", *fields)))
            present = reduce(lambda a, b: a | b, [f.isNotNull() for f in fields])
            parts.append(F.when(present, said).otherwise(F.array().cast(TURNS)))
    if layout.list_field in records.columns:
        element = records.schema[layout.list_field].dataType.elementType

        def turn(message: Column) -> Column:
            role = F.coalesce(message[layout.role_field].cast("string"), F.lit(""))
            if layout.roles:
                named = F.create_map(*[F.lit(x) for pair in layout.roles.items() for x in pair])
                role = F.coalesce(F.try_element_at(named, role), role)
            held = layout.text_field in element.names
            text = F.coalesce(message[layout.text_field].cast("string"), F.lit("")) if held else F.lit("")
            return _turn(role, text)

        parts.append(F.coalesce(F.transform(col(layout.list_field), turn), F.array().cast(TURNS)))
    return F.concat(*parts) if parts else F.array().cast(TURNS)


def to_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, keep: Sequence[str] = ()) -> DataFrame:
    """Columns ``keep``, ``fingerprint``, ``layout`` and ``turns`` of each record.

    A null field is as good as absent, so records of one table may have different layouts; fields that no layout knows
    do not matter. A record whose fields fit no layout, or more than any one allows, keeps its row with a null
    ``layout`` and no turns. In a list of messages a null role or text is an empty one; a null message is both.
    Kept columns named like a new one are replaced.
    """

    found = _declared(records, layouts)
    mark, choice = fingerprint(records, layouts), None
    turns = None
    for layout in found:
        fits = mark.isin(*[_literal_fingerprint(paths) for paths in layout.path_sets()])
        choice = F.when(fits, F.lit(layout.name)) if choice is None else choice.when(fits, F.lit(layout.name))
        said = _turns(records, layout)
        turns = F.when(fits, said) if turns is None else turns.when(fits, said)
    none = F.array().cast(TURNS)
    kept = [col(c) for c in keep if c not in ("fingerprint", "layout", "turns")]
    return records.select(
        *kept,
        mark.alias("fingerprint"),
        (F.lit(None).cast("string") if choice is None else choice).alias("layout"),
        (none if turns is None else F.coalesce(turns, none)).cast(TURNS).alias("turns"),
    )


def _declared(records: DataFrame, layouts: Sequence[Layout]) -> list[Layout]:
    """Layouts whose required paths the schema has; two layouts may not claim the same set of paths."""

    seen: dict[tuple[str, ...], str] = {}
    for layout in layouts:
        for paths in layout.path_sets():
            if seen.setdefault(paths, layout.name) != layout.name:
                raise ValueError(f"layouts {seen[paths]} and {layout.name} both claim {', '.join(paths)}")
    present = set(field_paths(records))
    return [one for one in layouts if set(one.required) <= present]


def escape(text: Column, template: Template) -> Column:
    """``text`` without any control string: the escape doubled, and one set after the first character of each."""

    firsts: dict[str, list[str]] = {}
    for control in template.controls():
        firsts.setdefault(control[0], []).append(re.escape(control[1:]))
    found = "|".join([re.escape(template.escape), *[f"{re.escape(c)}(?={'|'.join(rest)})" for c, rest in firsts.items()]])
    return F.regexp_replace(text, f"({found})", "$1" + re.sub(r"([\\$])", r"\\\1", template.escape))


def unescape(text: Column, template: Template) -> Column:
    return F.regexp_replace(text, f"(?s){re.escape(template.escape)}(.)", "$1")


def format_turns(rows: DataFrame, template: Template = Template(), learned: str = LEARNED, turns_col: str = "turns") -> DataFrame:
    """Rows with ``formatted``, the text of their turns, and ``loss_spans``, the ranges (code points, end excluded) learned from.

    The spans are the escaped texts of the turns of role ``learned``, in order, without any mark. No turns make an
    empty text. Null turns count as none, null roles and texts as empty. Columns of those two names are replaced.
    """

    def written(one: Column) -> Column:
        head = F.concat(F.lit(template.open), escape(F.coalesce(one["role"], F.lit("")), template), F.lit(template.middle))
        body = escape(F.coalesce(one["text"], F.lit("")), template)
        return F.struct(head.alias("head"), body.alias("body"), (one["role"] == learned).alias("learned"))

    spare = "_written"
    while spare in rows.columns:
        spare += "_"
    turns = F.coalesce(col(turns_col), F.array().cast(TURNS))
    made = rows.withColumn(spare, F.transform(turns, written))
    close = len(template.close)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(done: Column, one: Column) -> Column:
        start = done["at"] + F.length(one["head"])
        end = start + F.length(one["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        spans = F.when(one["learned"], F.concat(done["spans"], span)).otherwise(done["spans"])
        return F.struct((end + close).alias("at"), spans.alias("spans"))

    shown = F.transform(spare, lambda one: F.concat(one["head"], one["body"], F.lit(template.close)))
    return made.withColumns(
        {"formatted": F.array_join(shown, ""), "loss_spans": F.aggregate(spare, nothing, step, lambda done: done["spans"])}
    ).drop(spare)


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) that a formatted text was made of."""

    pieces = F.split(formatted, re.escape(template.close), -1)

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(template.open) + 1), F.length(piece))
        sides = F.split(inner, re.escape(template.middle), 2)
        return _turn(unescape(F.get(sides, F.lit(0)), template), unescape(F.get(sides, F.lit(1)), template))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def learned_text(formatted: Column, spans: Column, template: Template = Template()) -> Column:
    """The text under the loss mask, unescaped, without anything between two spans."""

    texts = F.transform(spans, lambda one: unescape(F.substring(formatted, one["start"] + 1, one["end"] - one["start"]), template))
    return F.array_join(texts, "")


def rows_to_records(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One record (``id_col`` and ``messages``) per conversation of a table with a row per turn.

    Turns are in the order of ``turn_col``, nulls first, ties by role, then text, so equal rows both stay. Rows with a
    null id are one conversation with a null id. Null roles and texts are empty. A conversation is one row of the
    output, so its size is that of its text.
    """

    order, role = col(turn_col).alias("at"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role")
    text = F.coalesce(col(text_col).cast("string"), F.lit("")).alias("content")
    grouped = rows.select(col(id_col).alias("id"), F.struct(order, role, text).alias("one")).groupBy("id")
    held = grouped.agg(F.sort_array(F.collect_list("one")).alias("all"))
    messages = F.transform("all", lambda one: F.struct(one["role"].alias("role"), one["content"].alias("content")))
    return held.select(F.col("id").alias(id_col), messages.alias("messages"))


def format_chats(
    records: DataFrame,
    keep: Sequence[str] = (),
    layouts: Sequence[Layout] = LAYOUTS,
    template: Template = Template(),
    learned: str = LEARNED,
) -> DataFrame:
    """Records of any known layout as training texts: ``keep``, ``fingerprint``, ``layout``, ``turns``, ``formatted``, ``loss_spans``.

    See :func:`to_turns` and :func:`format_turns` for nulls, unknown layouts and clashing names. An empty table gives
    an empty one.
    """

    return format_turns(to_turns(records, layouts, [c for c in keep if c not in ("formatted", "loss_spans")]), template, learned)
