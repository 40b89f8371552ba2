"""Dialogue records of any known layout as canonical turns, and turns as marked training text.

The library's tables hold no dialogues, so records are general here: an id and the columns of some layout.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Names that one layout has for the speakers.
SHARED_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))


@dataclass(frozen=True)
class Layout:
    """A mapping: the field paths a record has, and how its turns are made.

    ``turns`` lists (role, path) for layouts of single fields; ``each`` names (array, role field, text field), and
    ``roles`` what its roles are called elsewhere.
    """
    name: str
    turns: tuple[tuple[str, str], ...] = ()
    each: tuple[str, str, str] | None = None
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> list[str]:
        if self.each:
            array, role, text = self.each
            return sorted([f"{array}[].{role}", f"{array}[].{text}"])
        return sorted(path for _, path in self.turns)


LAYOUTS = [
    Layout("messages", each=("messages", "role", "content")),
    Layout("conversations", each=("conversations", "from", "value"), roles=SHARED_ROLES),
    Layout("prompt-completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt-response", (("user", "prompt"), ("assistant", "response"))),
    Layout("system-prompt-response", (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction-input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question-answer", (("user", "question"), ("assistant", "answer"))),
    Layout("data", (("user", "data.prompt"), ("assistant", "data.reply"))),
]


def _has(schema: StructType, path: str) -> Column | None:
    """Whether a record has this path: null where the table has no such column at all."""
    kind: DataType = schema
    for step in path.replace("[]", ".[]").split("."):
        if step == "[]":
            if not isinstance(kind, ArrayType):
                return None
            kind = kind.elementType
        elif isinstance(kind, StructType) and step in kind.fieldNames():
            kind = kind[step].dataType
        else:
            return None
    return F.col(path.split("[]")[0]).isNotNull()


def fingerprint(records: DataFrame, layouts: list[Layout] = LAYOUTS) -> Column:
    """A hash of the nested field paths that a record has, of all that the layouts name, in order.

    A path through an array counts if the array is there, however long it is; another if its value is there.
    """
    known = sorted({p for layout in layouts for p in layout.paths()})
    there = [(p, _has(records.schema, p)) for p in known]
    return F.xxhash64(F.concat_ws("\n", *[F.when(has, F.lit(p)) for p, has in there if has is not None]))


def canonical_turns(records: DataFrame, record_id: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``record_id``, ``layout`` and ``turns`` array of (role, text), one row per record.

    The fingerprint of a record selects its layout; a record of no known layout has null for both. Texts that
    are null become empty, a layout's own role names become the common ones, other roles stay. Columns
    that no layout names are ignored.
    """
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    def each_turn(layout: Layout) -> Column:
        array, role, text = layout.each

        def common(own: Column) -> Column:
            return reduce(lambda c, r: c.when(own == r[0], F.lit(r[1])), layout.roles, F.when(F.lit(False), own)).otherwise(own)

        return F.transform(array, lambda m: turn(common(m[role]), m[text]))

    own = "_" * max(map(len, records.columns)) + "print"  # no given column bears this name
    marked = records.select("*", fingerprint(records, layouts).alias(own))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in reversed(layouts):
        if any(_has(records.schema, p) is None for p in layout.paths()):
            continue
        if layout.each:
            made = each_turn(layout)
        else:
            made = F.array(*[turn(F.lit(role), F.col(path)) for role, path in layout.turns])
        match = F.col(own) == F.xxhash64(F.lit("\n".join(layout.paths())))
        name, turns = F.when(match, F.lit(layout.name)).otherwise(name), F.when(match, made).otherwise(turns)
    return marked.select(F.col(record_id), name.alias("layout"), turns.alias("turns"))


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
_ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("[", "\\b")]


def escaped(text: Column) -> Column:
    """No ``<`` and no ``[`` is left, so no control string of any template is; ``unescaped`` undoes it."""
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ESCAPES, text)


def unescaped(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), reversed(_ESCAPES), text)


def formatted(dialogues: DataFrame, record_id: str) -> DataFrame:
    """``record_id``, ``formatted`` text and ``loss`` array of (start, chars) from ``turns``, one row per row.

    A turn is the opening mark, its role, a line feed, its text and the closing mark, role and text escaped.
    ``loss`` says which characters are learned: the texts of the assistant's turns, escaped, in order; ``start``
    counts from 1. Null or no turns give an empty text and no loss.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<role:string,text:string>>"))
    parts = dialogues.select(F.col(record_id), F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(OPEN), F.replace(escaped(t["role"]), F.lit("\n"), F.lit("\\n")), F.lit("\n")).alias("head"),
        escaped(t["text"]).alias("text"), (t["role"] == "assistant").alias("learned"))).alias("_parts"))
    none = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans"))
    walked = F.aggregate("_parts", none, lambda a, p: F.struct(
        (a["at"] + F.length(p["head"]) + F.length(p["text"]) + len(CLOSE)).alias("at"),
        F.when(p["learned"], F.array_append(a["spans"], F.struct(
            (a["at"] + F.length(p["head"])).alias("start"), F.length(p["text"]).alias("chars")))).otherwise(a["spans"]).alias("spans")),
        lambda a: a["spans"])
    return parts.select(F.col(record_id), F.array_join(F.transform(
        "_parts", lambda p: F.concat(p["head"], p["text"], F.lit(CLOSE))), "").alias("formatted"), walked.alias("loss"))


def read_back(texts: DataFrame, record_id: str) -> DataFrame:
    """``record_id``, ``turns`` array of (role, text) and ``learned`` array of texts, from ``formatted`` and ``loss`` alone."""
    pieces = F.filter(F.split("formatted", r"\Q" + CLOSE + r"\E"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        role = F.replace(F.substr(head, F.lit(len(OPEN) + 1)), F.lit("\\n"), F.lit("\n"))
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(piece, F.length(head) + 2)).alias("text"))

    return texts.select(F.col(record_id), F.transform(pieces, turn).alias("turns"), F.transform(
        "loss", lambda s: unescaped(F.substr(F.col("formatted"), s["start"], s["chars"]))).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"))
