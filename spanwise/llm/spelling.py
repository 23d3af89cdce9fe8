"""Spelling variants: one-edit neighbours found over a reduced alphabet."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.words import STEP, U, mix
from spanwise.session import materialise

# Symbols that letters are hashed to; a larger vocabulary may take more of them.
SYMBOLS = 6
LEAST_LENGTH = 7
LEAST_COUNT = 2
# A form is this many times as common as the word it stands for.
FORM_RATIO = 10
# A drop for every run whose checksum this divides.
DROP_EVERY = 31

UPPER = "".join(map(chr, range(65, 91)))
LETTERS = "".join(map(chr, [*range(97, 123), *range(0xC0, 0x100)]))
RUN = r"[A-Za-z\x{C0}-\x{FF}]"

POWER = STEP | U(1)
INVERSE = U(pow(int(POWER), -1, 1 << 64))
ODD = 0xD1342543DE82EF95
# Hashes that are held at a time, unless a single word has more.
HELD = 1 << 20
KEYED = "reduced string, home long, keys array<bigint>"


def symbol_of(letter: str, symbols: int) -> str:
    """The symbol a letter is hashed to, one of the first ``symbols`` letters of the alphabet."""
    return chr(97 + ((ord(letter) * 2654435761 % (1 << 32)) * symbols >> 32))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``word`` and its number of occurrences ``n`` over all of ``docs`` (doc_id, text).

    A word is a maximal run of letters with A-Z in lower case. Where 31 divides the
    checksum of ``<doc_id>:<run>``, the run loses the letter whose place is the checksum
    modulo its length. Words shorter or rarer than asked for are left out. Null texts
    have no words, a null ``doc_id`` is written as nothing, rows that repeat count
    again, an empty table has no words; other columns are not read.
    """
    # A shorter run can only lose a letter, so it is never long enough.
    found = F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_length},}}"), F.lit(0))
    runs = docs.select("doc_id", F.explode(found).alias("run")).select(
        "doc_id", F.translate("run", UPPER, UPPER.lower()).alias("run")
    )
    spelt = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    summed = runs.select("run", F.crc32(spelt.cast("binary")).alias("h"))
    place = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(
        F.col("run").substr(F.lit(1), place), F.col("run").substr(place + 2, F.length("run"))
    )
    words = summed.select(F.when(F.col("h") % DROP_EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    counted = words.filter(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= least_count)


def _length(size: int) -> np.uint64:
    return U(size * ODD % (1 << 64))


def neighbourhoods(codes: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words of one length, a row of symbols each: hashes of the words, of their neighbours, and how many.

    Neighbours are the word with one symbol left out and the word with one symbol
    replaced by a larger one. A word with an additional or a smaller symbol has this
    one among its own neighbours, so every pair is met from one of its sides.
    """
    rows, size = codes.shape
    values = mix(np.arange(1, symbols + 1, dtype=U) * STEP)
    powers = np.cumprod(np.full(size, POWER, U))
    own = values[codes]
    sums = np.cumsum(own * powers, axis=1, dtype=U)
    whole = sums[:, -1:]
    before = np.concatenate([np.zeros((rows, 1), U), sums[:, :-1]], axis=1)
    # What follows the place that is left out moves down by one.
    found = [mix(before + (whole - sums) * INVERSE + _length(size - 1))]
    # Leaving out any symbol of a run of equal ones gives the same word.
    wanted = [np.concatenate([np.ones((rows, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1)]
    for symbol in range(1, symbols):
        found.append(mix(whole + (values[symbol] - own) * powers + _length(size)))
        wanted.append(codes < symbol)
    keep = np.concatenate(wanted, axis=1)
    return mix(whole[:, 0] + _length(size)), np.concatenate(found, axis=1)[keep], keep.sum(axis=1)


def _keyed(symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).cast(pa.large_string())
            sizes = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
            sizes = np.diff(sizes)
            for size in np.unique(sizes).tolist():
                places = np.flatnonzero(sizes == size)
                step = max(1, HELD // (size * symbols))
                for begin in range(0, len(places), step):
                    some = words.take(pa.array(places[begin : begin + step]))
                    data = np.frombuffer(some.buffers()[2], np.uint8, count=len(some) * size)
                    home, keys, counts = neighbourhoods(data.reshape(len(some), size) - 97, symbols)
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                    columns = [some.cast(pa.string()), pa.array(home.view(np.int64)), lists]
                    yield pa.RecordBatch.from_arrays(columns, ["reduced", "home", "keys"])

    return run


def near_pairs(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """Pairs (a, a_n, b, b_n) of ``words`` (word, n) that differ by one letter, each once.

    Words are written in the reduced alphabet, in which a pair that is one edit apart
    stays equal or one edit apart. The one-edit neighbours of each distinct reduced
    word are joined by hash with the reduced vocabulary, and the original words behind
    a match are compared. The reduced words are as many as the vocabulary at most; the
    originals are compared while they are joined and never gathered. Long words cost
    keys in proportion to their length, each of eight bytes.
    """
    table = "".join(symbol_of(letter, symbols) for letter in LETTERS)
    spelt = words.withColumn("reduced", F.translate("word", LETTERS, table))
    reduced = materialise(spelt.select("reduced").distinct().mapInArrow(_keyed(symbols), KEYED), "reduced")
    members = materialise(
        spelt.join(reduced.select("reduced", "home"), "reduced").select("home", "word", "n"), "members"
    )
    known = reduced.select(F.col("home").alias("second"))
    apart = reduced.select(F.col("home").alias("first"), F.explode("keys").alias("second")).join(known, "second")
    homes = apart.select("first", "second").unionByName(known.select(F.col("second").alias("first"), "second"))
    a = members.select(F.col("home").alias("first"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    b = members.select(F.col("home").alias("second"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    one_edit = F.levenshtein("a", "b", 1) == 1
    once = (F.col("first") != F.col("second")) | (F.col("a") < F.col("b"))
    return homes.join(a, "first").join(b, "second").filter(once & one_edit).select("a", "a_n", "b", "b_n")


def group_variants(
    docs: DataFrame,
    symbols: int = SYMBOLS,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    ratio: int = FORM_RATIO,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for each word of :func:`vocabulary`.

    ``n_near`` is the number of words one letter away; ``form`` is the commonest of
    them (ties: the smallest) if it is at least ``ratio`` times as common as the word,
    else null; ``root`` is the last word reached by following forms. Counts grow along
    a chain of forms, which bounds its length (``ratio`` is above 1); each round doubles
    the steps taken.
    """
    words = materialise(vocabulary(docs, least_length, least_count), "words")
    pairs = materialise(near_pairs(words, symbols), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("a_n").alias("other_n"))
    )
    commonest = F.min(F.struct(F.negative("other_n").alias("rank"), F.col("other"))).alias("top")
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), commonest)
    top_n = F.negative("top.rank")
    is_form = top_n >= ratio * F.col("n")
    judged = materialise(
        words.join(near, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top.other")).alias("form"),
            F.when(is_form, top_n).alias("form_n"),
        ),
        "forms",
    )
    roots = judged.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = words.agg(F.max("n")).first()[0] or 1
    longest = 1 + math.floor(math.log(most) / math.log(ratio))
    steps = 1
    while steps < longest:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("last"))
        roots = materialise(
            roots.join(further, "root", "left").select("word", F.coalesce("last", "root").alias("root")), "roots"
        )
        steps *= 2
    return judged.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
