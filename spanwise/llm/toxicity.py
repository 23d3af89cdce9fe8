"""Toxicity by compression distance: which of two dictionaries shortens a text's windows more."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.boosting import Boosted
from spanwise.llm.tokens import process_memory, slices
from spanwise.llm.words import U, mix

# Windows of so many bytes, one begun every STRIDE bytes, each behind the same FILL bytes, so that
# even a short window makes a block that is compressed rather than stored.
WINDOW, STRIDE, FILL = 40, 28, 40
ORDINARY_BYTES, TOXIC_BYTES = 98_304, 4_096
# Tables large enough that no part of a dictionary hides another.
SEARCH = {"min_match": 6, "window_log": 17, "hash_log": 18, "chain_log": 18, "search_log": 6, "target_length": 48}
# Training reads at most about so many labelled documents, each of them whole.
SAMPLE_DOCS = 10_000
REJECT = 0.7

# So many characters are scored at a time.
SLICE_CHARS = 2_000_000

# What marks toxic text out: beginnings of words, of so many bytes with the space before them, in at least
# LEAST_DOCS toxic documents and in LEAST_SHARE of them, whose log odds against ordinary documents exceed
# ODDS and whose count lies DEVIATIONS above what ordinary documents let expect.
GRAMS = (5, 7)
LEAST_DOCS, LEAST_SHARE, ODDS, DEVIATIONS = 3, 0.02, 1.5, 5.0
GRAM_BITS = 21
LONGEST_WORD = 40
EXCERPT = 800
PARTS = 2
FOLD = 3


def held_out(doc_id) -> F.Column:
    """Documents whose labels are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLD == 1


def lowered(text: str) -> bytes:
    return text.lower().encode()


def _beginnings(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the beginnings of a text's words, and the place of the space before each word."""
    data = np.frombuffer(b" " + body, np.uint8)
    hashes, places = [], []
    for size in GRAMS:
        at = np.flatnonzero(data[: max(0, len(data) - size + 1)] == 32)
        total = np.full(len(at), U(size))
        for i in range(size):
            total = total * U(0xD1342543DE82EF95) + data[at + i].astype(U)
        hashes.append(mix(total) >> U(64 - GRAM_BITS))
        places.append(at)
    return np.concatenate(hashes).astype(np.int64), np.concatenate(places)


def _words(body: bytes, places: np.ndarray) -> list[bytes]:
    """The words behind the given spaces, each between two spaces."""
    padded = b" " + body + b" "
    words = (padded[at : padded.index(b" ", at + 1) + 1] for at in np.unique(places).tolist())
    return [w for w in words if len(w) < LONGEST_WORD]


class Classifier:
    """Two dictionaries, and boosted trees on how a document's windows compare under them."""

    def __init__(self, ordinary: bytes, toxic: bytes, model: Boosted | None) -> None:
        self.ordinary, self.toxic, self.model = ordinary, toxic, model

    def _compressors(self):
        import zstandard

        kept, made = process_memory("toxicity"), ("toxicity", self.ordinary, self.toxic)
        if made not in kept:
            settings = zstandard.ZstdCompressionParameters(
                strategy=zstandard.STRATEGY_DFAST,
                write_content_size=False,
                write_checksum=False,
                write_dict_id=False,
                **SEARCH,
            )
            pair = []
            for content in (self.ordinary, self.ordinary + self.toxic):
                dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                dictionary.precompute_compress(compression_params=settings)
                pair.append(zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary).compress)
            kept[made] = pair
        return kept[made]

    def features(self, body: bytes) -> list[float]:
        """How many bytes the toxic dictionary saves: its best windows, their number and share."""
        ordinary, toxic = self._compressors()
        fill = self.ordinary[-FILL:]
        windows = [fill + body[i : i + WINDOW] for i in range(0, max(1, len(body) - WINDOW + STRIDE), STRIDE)]
        saved = [len(a) - len(b) for a, b in zip(map(ordinary, windows), map(toxic, windows), strict=True)]
        saved = np.array(saved)
        top = np.sort(saved[saved >= np.partition(saved, -min(3, len(saved)))[-min(3, len(saved))]])[::-1][:3]
        counts = [int((saved >= k).sum()) for k in range(2, 9)]
        shares = [100 * c / len(saved) for c in counts]
        return [float(top[0]), float(top.mean()), float(saved.mean()), *counts, *shares, len(saved)]

    def scores(self, texts: list[str]) -> np.ndarray:
        """The probability that each text is toxic; zero for all if there was nothing to learn from."""
        if self.model is None or not texts:
            return np.zeros(len(texts))
        return self.model.probability(np.array([self.features(lowered(t)) for t in texts], float))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary, or the samples themselves if they are too few to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()[-size:]
    except (zstandard.ZstdError, ValueError):
        return b"".join(dict.fromkeys(samples))[:size]


def _contrast(bodies: list[bytes], toxic: list[int]) -> Classifier:
    """The two dictionaries of some labelled documents, without the trees.

    Toxic documents are mostly ordinary text. Their dictionary is trained on those of
    their words that hold a stretch far commoner in toxic documents, the other on plain
    excerpts of ordinary documents; the toxic one stands behind the ordinary one when
    compressing, so that the two differ in nothing else.
    """
    documents = np.zeros((2, 1 << GRAM_BITS), np.int32)
    for body, label in zip(bodies, toxic, strict=True):
        documents[label][np.unique(_beginnings(body)[0])] += 1
    seen = np.bincount(toxic, minlength=2)
    odds = [np.log((d + 0.5) / (n + 1)) for d, n in zip(documents, seen, strict=True)]
    expected = seen[1] * (documents[0] + 0.5) / (seen[0] + 1)
    marked = (odds[1] - odds[0] > ODDS) & (documents[1] >= max(LEAST_DOCS, LEAST_SHARE * seen[1]))
    marked &= documents[1] - expected > DEVIATIONS * np.sqrt(expected + 1)
    phrases, excerpts = [], []
    for number, (body, label) in enumerate(zip(bodies, toxic, strict=True)):
        if label:
            hashes, places = _beginnings(body)
            phrases += _words(body, places[marked[hashes]])
        else:
            at = int(mix(np.array([number], U))[0] % U(max(1, len(body) - EXCERPT)))
            excerpts += [body[i : i + 64] for i in range(at, min(len(body), at + EXCERPT), 64)]
    phrases = [phrases[i] for i in np.argsort(mix(np.arange(len(phrases), dtype=U)))]
    runs = [b"".join(phrases[i : i + 4]) for i in range(0, len(phrases), 4)]
    return Classifier(_dictionary(excerpts, ORDINARY_BYTES), _dictionary(runs, TOXIC_BYTES), None)


def learn(texts: list[str], toxic: list[int]) -> Classifier:
    """Dictionaries of all the documents, and trees that compare windows under them.

    The trees are fitted on documents under dictionaries that were trained on the others.
    """
    bodies = [lowered(t) for t in texts]
    folds = np.arange(len(bodies)) % PARTS
    rows: list[list[float]] = [[]] * len(bodies)
    for fold in range(PARTS):
        mine = [i for i in range(len(bodies)) if folds[i] != fold]
        if len({toxic[i] for i in mine}) < 2:
            return Classifier(b"", b"", None)
        made = _contrast([bodies[i] for i in mine], [toxic[i] for i in mine])
        for i in np.flatnonzero(folds == fold):
            rows[i] = made.features(bodies[i])
    made = _contrast(bodies, toxic)
    made.model = Boosted().fit(np.array(rows, float), np.array(toxic))
    return made


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_DOCS) -> Classifier:
    """Learn from about ``sample`` labelled documents outside the held-out fold, chosen by a hash of the id.

    The documents are bounded in number, not in length: their words are counted, and their
    windows compared, over whole texts. Null labels and texts are left out of training; a ``doc_id`` labelled twice counts as
    its larger label. With one sort of label only, nothing can be learned and all scores are 0.
    """
    known = (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
    )
    share = -(-known.count() // sample) or 1
    chosen = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    # About as many ids as the sample has documents.
    rows = (
        docs.select(F.col("doc_id").cast("long"), "text")
        .filter("text is not null")
        .join(F.broadcast(chosen), "doc_id")
        .dropDuplicates(["doc_id"])
        .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id")
        .select("text", "toxic")
        .toPandas()
    )
    return learn(rows.text.tolist(), rows.toxic.astype(int).tolist())


def score(docs: DataFrame, classifier: Classifier, column: str = "toxicity") -> DataFrame:
    """``docs`` with a ``column`` between 0 and 1, in place of any column of that name.

    Each whole text is scored, null as empty; equal texts have equal scores; all rows
    and other columns are kept.
    """
    kept = docs.drop(column)
    place = kept.columns.index("text")

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(place)), 0).to_pylist()
            for part in slices(sizes, SLICE_CHARS):
                rows = batch.slice(part.start, part.stop - part.start)
                found = classifier.scores([t or "" for t in rows.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found)], [*rows.schema.names, column])

    schema = T.StructType([*kept.schema.fields, T.StructField(column, T.DoubleType())])
    return kept.mapInArrow(rate, schema)
