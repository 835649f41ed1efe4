"""Chat formatting by schema fingerprinting, in DataFrame functions only.

A layout is declared by the nested field paths it needs and by where roles and texts are.  The
fingerprint of a record is the hash of its sorted field paths; it selects the layout's mapping to
canonical turns.  Typed tables have one fingerprint, from their schema; JSON records have one
each, from the record's own structure, so one column may mix layouts.  Records whose fingerprint
is unknown (extra fields) take the first layout whose paths they all have; others give no turns
and are counted under layout null.

The template writes each turn as ``<|im_start|>role\\n text <|im_end|>\\n``.  Inside roles and texts
a backslash is doubled and ``<|`` becomes ``<\\|`` (in roles a line feed becomes ``\\n``), so no text
can contain a control string and everything can be read back: :func:`parse` is the inverse.
``loss_spans`` are the places (from 0, in code points) of the assistant's texts.

Edge cases: null texts and roles are empty; turns are ordered by turn (null first), then role,
then text; repeated rows are turns of their own; a null conv_id is a conversation of its own; an
empty table gives no conversations.  Other columns are ignored.  A conversation is one row and so
one window group: its text must fit a string (2 GB); there is no other limit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

START, END = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Layout:
    """``rows``: (conversation, turn, role, text) columns of a table with a row for each turn.
    ``turns``: (array, role, text) of a record that lists its turns.
    ``fields``: (role, field, ...) of a record with fixed fields; several fields are joined by a blank line.
    """

    name: str
    rows: tuple[str, str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, ...], ...] = ()

    def paths(self) -> tuple[str, ...]:
        if self.rows:
            return tuple(sorted(self.rows))
        if self.turns:
            array, role, text = self.turns
            return tuple(sorted((array, f"{array}[].{role}", f"{array}[].{text}")))
        return tuple(sorted(x for role, *names in self.fields for x in names))


LAYOUTS = (
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("messages", turns=("messages", "role", "content")),
    Layout("share", turns=("conversations", "from", "value")),
    Layout("dialogue", turns=("dialogue", "speaker", "utterance")),
    Layout("instruction with input", fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Layout("instruction", fields=(("user", "instruction"), ("assistant", "output"))),
    Layout("system prompt", fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and response", fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("question and answer", fields=(("user", "question"), ("assistant", "answer"))),
)
#: Names of roles in the layouts that list turns, and their canonical names.
ROLES = {"human": "user", "user": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "assistant": "assistant", "chatgpt": "assistant", "system": "system"}


def schema_paths(kind: DataType, at: str = "") -> list[str]:
    """All nested field paths of a type; array elements are written ``[]``."""
    if isinstance(kind, ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    if not isinstance(kind, StructType):
        return []
    found = []
    for f in kind.fields:
        path = f"{at}.{f.name}" if at else f.name
        found += [path, *schema_paths(f.dataType, path)]
    return found


def fingerprint(paths: Column) -> Column:
    """The hash of the sorted distinct field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def typed_layout(df: DataFrame) -> Layout | None:
    """The layout that the table's schema selects: equal fingerprints first, else the first one it covers."""
    paths = sorted(set(schema_paths(df.schema)))
    prints = [F.lit("\n".join(x)) for x in (paths, *(layout.paths() for layout in LAYOUTS))]
    own, *known = df.sparkSession.range(1).select(*[F.xxhash64(x) for x in prints]).first()
    by_print = dict(zip(known, LAYOUTS, strict=True))
    return by_print.get(own) or next((x for x in LAYOUTS if set(x.paths()) <= set(paths)), None)


def turns_of_rows(df: DataFrame) -> DataFrame:
    """Canonical turns ``conv_id, turn, role, text`` of a typed table with a row for each turn."""
    layout = typed_layout(df)
    if layout is None or layout.rows is None:
        raise ValueError("the table's field paths fit no layout with a row for each turn")
    conv, turn, role, text = layout.rows
    return df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def _keys(c: Column) -> Column:
    return F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))


def _elements(c: Column) -> Column:
    """The elements of a JSON list as JSON texts; null for anything else."""
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, "array<string>"))


def json_paths(record: Column) -> Column:
    """The nested field paths of a JSON record: its fields, their own fields, and those of the elements of its lists (of all
    elements together, whatever each of them has)."""

    def below(e: Column) -> Column:
        inner = F.transform(_keys(e["value"]), lambda k: F.concat(e["key"], F.lit("."), k))
        listed = F.flatten(F.transform(F.coalesce(_elements(e["value"]), F.array().cast("array<string>")), _keys))
        return F.concat(F.array(e["key"]), inner, F.transform(F.array_distinct(listed), lambda k: F.concat(e["key"], F.lit("[]."), k)))

    fields = F.map_entries(F.when(_keys(record) != F.array().cast("array<string>"), F.from_json(record, "map<string,string>")))
    return F.coalesce(F.array_distinct(F.flatten(F.transform(fields, below))), F.array().cast("array<string>"))


def turns_of_json(df: DataFrame, conv_id: str, record: str) -> DataFrame:
    """Canonical turns of JSON records of any known layout: ``conv_id, layout, turn, role, text``.

    A list's layout is known by the fields of all its elements; what an element lacks is empty, and so is a text that is null.
    A text that is a list of parts is its text parts, one after the other.  A record that lists turns and also has the fields of
    another layout gives both, the list first (layout: both names); a ``system`` field before a list is its first turn.  A record
    with an empty list, or without a known layout (layout null), gives one row with turn, role and text null.
    """
    layouts = [x for x in LAYOUTS if not x.rows]
    base = df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record"))
    base = base.withColumn("paths", json_paths(F.col("record"))).withColumn("print", fingerprint(F.col("paths")))

    def picked(some: list[Layout]) -> Column:
        out = F.lit(None).cast("string")
        for layout in reversed(some):
            fits = F.size(F.array_except(F.array(*[F.lit(x) for x in layout.paths()]), "paths")) == 0
            if layout.turns:
                fits = fits | (F.size(_elements(F.get_json_object("record", f"$.{layout.turns[0]}"))) == 0)
            out = F.when(fits, F.lit(layout.name)).otherwise(out)
        for layout in some:  # equal fingerprints first
            out = F.when(F.col("print") == F.xxhash64(F.lit("\n".join(layout.paths()))), F.lit(layout.name)).otherwise(out)
        return out

    base = base.withColumns({"listed": picked([x for x in layouts if x.turns]), "given": picked([x for x in layouts if x.fields])})
    kind = "array<struct<role:string,text:string>>"
    none = F.array().cast(kind)

    def mapped(some: list[Layout], name: str) -> Column:
        out = none
        for layout in some:
            out = F.when(F.col(name) == layout.name, _mapping(layout).cast(kind)).otherwise(out)
        return out

    prompt = F.get_json_object("record", "$.system")
    alone = F.col("listed").isNotNull() & prompt.isNotNull() & ~F.coalesce(F.col("given") == "system prompt", F.lit(False))
    first = F.when(alone, F.array(F.struct(F.lit("system").alias("role"), prompt.alias("text"))).cast(kind)).otherwise(none)
    turns = F.concat(first, mapped([x for x in layouts if x.turns], "listed"), mapped([x for x in layouts if x.fields], "given"))
    layout = F.nullif(F.concat_ws(" + ", "listed", "given"), F.lit(""))
    return base.select("conv_id", layout.alias("layout"), F.posexplode_outer(turns).alias("turn", "t")).select("conv_id", "layout", "turn", "t.role", "t.text")


def _content(turn: Column, name: str) -> Column:
    """The text of a turn (a variant): a text, or the text parts of a list."""

    def part(x: Column) -> Column:
        return F.coalesce(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")), F.try_variant_get(x, "$.text", "string"), F.lit(""))

    parts = F.try_variant_get(turn, f"$.{name}", "array<variant>")
    return F.coalesce(F.array_join(F.transform(parts, part), ""), F.try_variant_get(turn, f"$.{name}", "string"), F.lit(""))


def _mapping(layout: Layout) -> Column:
    record = F.col("record")
    if layout.turns:
        array, role, text = layout.turns
        names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])

        def turn(x: Column) -> Column:
            v = F.try_parse_json(x)
            given = F.coalesce(F.try_variant_get(v, f"$.{role}", "string"), F.lit(""))
            return F.struct(F.coalesce(names[F.lower(given)], given).alias("role"), _content(v, text).alias("text"))

        return F.transform(_elements(F.get_json_object(record, f"$.{array}")), turn)
    out = []
    for role, *names in layout.fields:
        parts = [F.nullif(F.coalesce(F.get_json_object(record, f"$.{n}"), F.lit("")), F.lit("")) for n in names]
        out.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text")))
    return F.array(*out)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: every backslash starts a pair, read from the left."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    parts = F.split(role, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))), "\\")


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, n_turns, formatted, loss_spans`` of canonical turns ``conv_id, turn, role, text``."""
    head = F.concat(F.lit(START), _escape_role(F.col("role")), F.lit("\n"))
    rows = turns.select("conv_id", "turn", "role", "text").withColumns({"head": head, "body": escape(F.col("text"))})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", before + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start"), F.length("body").cast("long").alias("length")))
    rows = rows.select("conv_id", F.struct("at", "piece", span.alias("span")).alias("x"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("x", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text, chars of the escaped text)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        body = F.substr(piece, F.length(role) + 2, F.length(piece) - F.length(role) - 1 - len(END) - 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(body).alias("text"), F.length(body).alias("chars"))

    return F.transform(pieces, turn)


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask: each span of the formatted text, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), "")


def digests(formatted: DataFrame) -> DataFrame:
    """What the registered query returns, read back from the formatted text and the loss mask."""
    read = formatted.withColumn("turns", parse(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.withColumns({"said": said, "loss": masked(F.col("formatted"), F.col("loss_spans"))})
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
