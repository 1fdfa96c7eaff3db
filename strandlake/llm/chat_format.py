"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one block by
array functions (where blocks begin, the slice of turns of each, its bodies joined); the blocks are concatenated into
the training text::

    ### role:\nfirst body<|>second body</turn>\n

The loss mask is a property of that text: what stands in the bodies of blocks of ``loss_role``, between markers.
``read_back`` takes turns and masked text from the formatted text alone; ``segments`` lists the same text as pieces with
a flag for a tokenizer. Inside roles and bodies the characters of the markers are replaced by two-character codes
(backslash ``\\b``, ``<`` ``\\l``, ``#`` ``\\h``, ``:`` ``\\c``), so no text can forge a marker and the way back is exact.

Defined results: a null text or role is the empty string; turns that tie go by role, then text; a null turn
number comes first; repeated rows stay; rows without conv_id make one conversation; an empty table gives an
empty table. Other input columns are ignored. A conversation is one row of the result, so it must fit in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Character and its code; the backslash is first, and last on the way back.
CODES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
OPEN, HEAD, JOINT, CLOSE = "### ", ":\n", "<|>", "</turn>\n"


def escape(c: Column) -> Column:
    for char, code in CODES:
        c = F.replace(c, F.lit(char), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for char, code in reversed(CODES):
        c = F.replace(c, F.lit(code), F.lit(char))
    return c


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted text and its segments (piece, loss) for each conversation."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    begins = F.filter(places, lambda i: (i == 0) | (F.get("turns", i - 1)["role"] != F.get("turns", i)["role"]))
    cut = sorted_turns.select("conv_id", "turns", begins.alias("begins"))

    def merged(begin, j):
        end = F.coalesce(F.get("begins", j + 1), F.size("turns"))
        mine = F.slice("turns", begin + 1, end - begin)
        role = F.get("turns", begin)["role"]
        return F.struct(role.alias("role"), F.transform(mine, lambda t: escape(t["text"])).alias("bodies"))

    blocks = cut.select("conv_id", F.transform("begins", merged).alias("blocks"))
    text = F.transform("blocks", lambda b: F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD), F.array_join(b["bodies"], JOINT), F.lit(CLOSE)))
    piece = lambda c, loss: F.struct(c.alias("piece"), loss.alias("loss"))
    off = F.lit(False)

    def pieces(b):
        head, tail = piece(F.concat(F.lit(OPEN), escape(b["role"]), F.lit(HEAD)), off), piece(F.lit(CLOSE), off)
        bodies = F.flatten(F.transform(b["bodies"], lambda x, i: F.array(piece(F.when(i > 0, F.lit(JOINT)).otherwise(""), off), piece(x, b["role"] == loss_role))))
        return F.concat(F.array(head), bodies, F.array(tail))

    segments = F.filter(F.flatten(F.transform("blocks", pieces)), lambda s: (s["piece"] != "") | s["loss"])
    return blocks.select("conv_id", F.array_join(text, "").alias("formatted"), segments.alias("segments"))


def read_back(formatted: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Turns (array of role, text) and the text under the loss mask, both from the formatted text alone."""
    parts = F.split("formatted", F.lit(CLOSE))
    blocks = F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda b: F.struct(unescape(F.regexp_extract(b, r"^### ([^:]*):\n", 1)).alias("role"), F.split(F.regexp_extract(b, r"(?s)^### [^:]*:\n(.*)$", 1), r"<\|>").alias("bodies")),
    )
    cut = formatted.select("conv_id", "formatted", blocks.alias("blocks"))
    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["bodies"], lambda body: F.struct(b["role"].alias("role"), unescape(body).alias("text")))))
    masked = F.flatten(F.transform(F.filter("blocks", lambda b: b["role"] == loss_role), lambda b: F.transform(b["bodies"], unescape)))
    return cut.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))
