"""Conversations as training windows of bounded length, with only new assistant turns to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
# What a turn's marks cost, and the characters a token holds on average.
MARK_TOKENS = 5
CHARS_PER_TOKEN = 4

# A turn is written as <|role|>, a new line, its text, <|end|> and a new line. Backslashes, angle brackets
# and bars inside roles and texts are replaced, so neither can hold a mark.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("|", "\\2"))


def escape(text: Column) -> Column:
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Inverse of :func:`escape`: a backslash in escaped text always begins a code."""
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def tokens_of(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN) + MARK_TOKENS


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """``conv_id, window, formatted, repeated, loss`` of each window of each conversation.

    Prefix sums of the turns' tokens cut a conversation into cells of half the room that
    the system turn and the history leave in ``budget``; the turns that end in a cell make
    a window, so that no turn is cut and a window keeps to the budget. A turn longer than
    a cell has a window of its own, which alone may exceed it. A leading system turn
    stands at the head of every window. Turns of the window before that lie within the
    last ``history`` tokens are repeated. ``repeated`` counts the turns at the head of a
    window that an earlier window has too, and ``loss`` lists start and length of the
    texts of the assistant turns that are new, in code points of ``formatted``.

    Null roles and texts are empty. Rows of a conversation are ordered by turn, null
    first, then by role and text; repeated rows are repeated turns; rows without
    ``conv_id`` make one conversation. An empty table gives no rows; other columns are
    not read.
    """
    blank = F.lit("")
    turns = conversations.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    whole = Window.partitionBy("conv_id")
    ordered = whole.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = whole.orderBy("turn", "role", "text")
    numbered = turns.withColumn("number", F.row_number().over(before)).select(
        "*",
        ((F.col("number") == 1) & (F.col("role") == "system")).alias("system"),
        tokens_of(F.col("text")).alias("tokens"),
    )
    counted = numbered.select(
        "*",
        F.sum(F.when(F.col("system"), 0).otherwise(F.col("tokens"))).over(ordered).alias("end"),
        F.coalesce(F.max(F.when(F.col("system"), F.col("tokens"))).over(ordered), F.lit(0)).alias("system_tokens"),
    )
    cell = F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.col("system_tokens")) / 2))
    celled = counted.select("*", (F.col("tokens") > cell).alias("long"), F.floor((F.col("end") - 1) / cell).alias("cell"))
    changed = (
        F.col("long")
        | F.lag("long").over(before)
        | (F.lag("cell").over(before) != F.col("cell"))
        | F.lag("system").over(before)
    )
    flagged = celled.withColumn(
        "first", F.when(F.col("system"), 0).otherwise(F.coalesce(changed, F.lit(True)).cast("int"))
    )
    placed = flagged.withColumn("window", F.greatest(F.lit(0), F.sum("first").over(ordered) - 1)).select(
        "*",
        F.max("window").over(whole).alias("last"),
        F.max("end").over(Window.partitionBy("conv_id", "window")).alias("stop"),
    )
    own = F.array(F.struct(F.col("window").alias("window"), F.lit(False).alias("repeat")))
    follows = (
        ~F.col("system")
        & (F.col("window") < F.col("last"))
        & (F.col("end") - F.col("tokens") >= F.col("stop") - history)
    )
    next_one = F.array(F.struct((F.col("window") + 1).alias("window"), F.lit(True).alias("repeat")))
    others = F.transform(
        F.sequence(F.lit(1).cast("long"), F.col("last")), lambda w: F.struct(w.alias("window"), F.lit(True).alias("repeat"))
    )
    copies = F.when(F.col("system") & (F.col("last") > 0), F.concat(own, others)).when(follows, F.concat(own, next_one))
    role = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    text = escape(F.col("text"))
    pieces = placed.select(
        "conv_id",
        F.explode(copies.otherwise(own)).alias("copy"),
        "number",
        (F.col("role") == "assistant").alias("answers"),
        F.concat(role, text, F.lit(END)).alias("piece"),
        F.length(role).alias("head"),
        F.length(text).alias("size"),
    ).select("conv_id", "copy.window", "copy.repeat", "number", "answers", "piece", "head", "size")
    # What a window holds is bounded by the budget, or is a single turn and its history.
    parts = pieces.groupBy("conv_id", "window").agg(
        F.array_sort(F.collect_list(F.struct("number", "repeat", "answers", "piece", "head", "size"))).alias("parts")
    )
    span = "struct<start:int,length:int>"
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")),
        lambda seen, p: F.struct(
            (seen["at"] + F.length(p["piece"])).alias("at"),
            F.when(
                p["answers"] & ~p["repeat"],
                F.concat(
                    seen["spans"],
                    F.array(F.struct((seen["at"] + p["head"]).alias("start"), p["size"].alias("length"))),
                ),
            )
            .otherwise(seen["spans"])
            .alias("spans"),
        ),
        lambda seen: seen["spans"],
    )
    return parts.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
        F.size(F.filter("parts", lambda p: p["repeat"])).alias("repeated"),
        spans.alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, window, turns, learned``: the new turns (role, text) and the texts under the loss mask."""
    found = F.split("formatted", r"<\|end\|>\n")
    turn = F.transform(
        F.slice(found, F.col("repeated") + 1, F.greatest(F.lit(0), F.size(found) - 1 - F.col("repeated"))),
        lambda t: F.struct(
            unescape(F.substr(F.substring_index(t, CLOSE, 1), F.lit(len(OPEN) + 1))).alias("role"),
            unescape(F.substr(t, F.length(F.substring_index(t, CLOSE, 1)) + F.lit(len(CLOSE) + 1))).alias("text"),
        ),
    )
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(
        "conv_id", "window", turn.alias("turns"), learned.alias("learned"), F.length("formatted").alias("chars")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation: checksums of what is read back. A checksum needs the conversation in one row."""
    read = read_back(formatted)
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    rows = read.select(
        "conv_id",
        "chars",
        F.size("turns").alias("n"),
        F.struct("window", line.alias("turns"), F.array_join("learned", "").alias("learned")).alias("part"),
    )
    joined = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.sum("chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list("part")).alias("parts"),
    )
    turns = F.array_join(F.transform("parts", lambda p: p["turns"]), "")
    learned = F.array_join(F.transform("parts", lambda p: p["learned"]), "")
    return joined.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
    )
