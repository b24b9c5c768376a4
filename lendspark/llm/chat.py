"""Chat formatting with array expressions.

A conversation's turns are collected as structs and sorted; adjacent turns of
one role are merged into one block; blocks are joined into one training string.
The template marks where blocks and turns begin and end, and every control
string inside a text is escaped, so the string can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: The template's control strings. Open and close marks by role;
#: any other role is written after ``[ROLE]`` and ends at ``[:]``.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]")
ROLE_END = "[:]"
NEXT_TURN = "[+]"
CONTROL = [m for pair in [*MARKS.values(), OTHER] for m in pair] + [ROLE_END, NEXT_TURN]

#: A block in the output: open mark, anything up to the first close mark.
_OPEN, _CLOSE = (r"<<SYS>>|\[INST\]|<s>|\[ROLE\]", r"<</SYS>>|\[/INST\]|</s>|\[/ROLE\]")
BLOCK = rf"(?s)(?:{_OPEN}).*?(?:{_CLOSE})"


def escape(text: Column) -> Column:
    r"""Writes ``\`` as ``\e`` and a control string's first character, ``<`` or
    ``[``, as ``\l`` or ``\b``; so no control string is left in it."""
    out = F.replace(text, F.lit("\\"), F.lit("\\e"))
    for mark in CONTROL:
        out = F.replace(out, F.lit(mark), F.lit(("\\l" if mark[0] == "<" else "\\b") + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    """The inverse of ``escape``: each backslash in it starts a pair."""
    out = F.replace(text, F.lit("\\l"), F.lit("<"))
    out = F.replace(out, F.lit("\\b"), F.lit("["))
    return F.replace(out, F.lit("\\e"), F.lit("\\"))


def _mark(role: Column, side: int) -> Column:
    other = F.concat(F.lit(OTHER[0]), escape(role), F.lit(ROLE_END)) if side == 0 else F.lit(OTHER[1])
    for name, pair in MARKS.items():
        other = F.when(role == name, F.lit(pair[side])).otherwise(other)
    return other


def format_chats(turns: DataFrame) -> DataFrame:
    """One row for each conv_id: conv_id, formatted, loss_spans, formatted_chars.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by turn (null
    first), then role and text; null texts and roles count as empty. loss_spans
    lists (start, length), in characters from 1, of each assistant text: what a
    trainer takes the loss of. A conversation is one string and thus one row of
    one task; its turns are all that is collected.
    """
    t = turns.select(
        "conv_id",
        F.struct(
            F.coalesce(F.col("turn").cast("long"), F.lit(-(2**63))).alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    chats = t.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # A turn opens a block if the turn before it has another role.
    opens = lambda ts, i: (i == 0) | (F.get(ts, i)["role"] != F.get(ts, F.greatest(i - 1, F.lit(0)))["role"])
    starts = lambda ts: F.filter(F.sequence(F.lit(0), F.size(ts) - 1), lambda i: opens(ts, i))
    ends = lambda ts, a: F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(ts)))
    cut = lambda ts, a: F.transform(F.arrays_zip(a.alias("a"), ends(ts, a).alias("z")), lambda s: F.slice(ts, s["a"] + 1, s["z"] - s["a"]))
    blocks = let(F.col("turns"), lambda ts: let(starts(ts), lambda a: cut(ts, a)))
    chats = chats.select("conv_id", blocks.alias("blocks"))
    # Pieces in order; of an assistant's block the texts bear the loss.
    mine = lambda b: b[0]["role"] == "assistant"
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))

    def pieces(b: Column) -> Column:
        role = b[0]["role"]
        body = F.flatten(
            F.transform(b, lambda x, i: F.array(piece(F.when(i > 0, F.lit(NEXT_TURN)).otherwise(F.lit("")), F.lit(False)), piece(escape(x["text"]), mine(b))))
        )
        return F.concat(F.array(piece(_mark(role, 0), F.lit(False))), body, F.array(piece(_mark(role, 1), F.lit(False))))

    chats = chats.select("conv_id", F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    lengths = F.transform("pieces", lambda p: F.struct(F.char_length(p["text"]).cast("long").alias("n"), p["loss"].alias("loss")))
    empty = F.expr("cast(array() as array<struct<start: bigint, length: bigint>>)")
    spans = F.aggregate(
        lengths,
        F.struct(F.lit(1).cast("long").alias("at"), empty.alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["n"]).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), p["n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("pieces", lambda p: p["text"]), "")
    return chats.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"), F.char_length(formatted).cast("long").alias("formatted_chars"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), one for each turn, read back from the output."""

    def block(b: Column) -> Column:
        other = b.startswith(OTHER[0])
        role = F.when(other, unescape(F.substring_index(F.substr(b, F.lit(len(OTHER[0]) + 1)), ROLE_END, 1)))
        head = F.when(other, F.locate(ROLE_END, b) + len(ROLE_END) - 1)
        tail = F.when(other, F.lit(len(OTHER[1])))
        for name, (a, z) in MARKS.items():
            here = b.startswith(a)
            role = F.when(here, F.lit(name)).otherwise(role)
            head = F.when(here, F.lit(len(a))).otherwise(head)
            tail = F.when(here, F.lit(len(z))).otherwise(tail)
        body = F.substr(b, head + 1, F.char_length(b) - head - tail)
        return F.transform(F.split(body, r"\[\+\]", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(0)), block))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, joined."""
    text = lambda f: F.transform(spans, lambda s: unescape(F.substr(f, s["start"].cast("int"), s["length"].cast("int"))))
    return let(formatted, lambda f: F.array_join(text(f), ""))
