"""Personal data: candidate spans, scored by boosted trees, with certain patterns always kept."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanwise.llm.boosting import Boosted
from spanwise.llm.tokens import process_memory, slices
from spanwise.llm.words import U, mix

# The kinds in order, and the patterns of the certain spans.
KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators of candidates: stretches of digits and their separators, and loosely written addresses.
STRETCH = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")
GROUP = re.compile(r"[0-9]+")
LOOSE_EMAIL = re.compile(
    r"[A-Za-z0-9._%+-]{1,64} ?(?:@|\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63}){1,4}"
)
HINT = re.compile(r"(?i)(tel|phone|call|fax|mobile|card|visa|mail|contact|addr|ip|server|host)\W*\Z")

# Greater features count as the first, and the greatest number in an address, at its place, as the second: so the
# candidates of any corpus have a bounded number of forms.
MOST, MOST_PART, PART = 100, 1000, 17
# A task hands its counts on once it holds so many forms.
HELD_FORMS = 50_000
# So many candidates are scored at a time.
JUDGED = 20_000
PRECISION = 0.995
DIGITS_MIN, DIGITS_MAX = 7, 19

SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType()),
            T.StructField("base", T.BooleanType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
)
ARROW_SPANS = pa.list_(
    pa.struct(
        [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]
    )
)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The certain spans as (kind, start, end), by start and then by kind."""
    found = []
    at = text.find("@")
    floor = 0
    while at >= 0:
        # A match holds this "@" and begins where the run of local characters before it does.
        local = EMAIL_LOCAL.search(text, max(floor, at - 64), at)
        if local and local.start() == max(floor, at - 64):
            local = EMAIL_LOCAL.search(text, floor, at)
        match = EMAIL.match(text, local.start()) if local else None
        if match:
            found.append(("email", match.start(), match.end()))
            floor = match.end()
        at = text.find("@", max(floor, at + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = digits_of(m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data; those that no rule can rule out by their digits."""
    found = []
    for m in STRETCH.finditer(text):
        groups = [(m.start() + g.start(), m.start() + g.end()) for g in GROUP.finditer(m[0])]
        for i, (begin, _) in enumerate(groups):
            total = 0
            for j in range(i, len(groups)):
                end = groups[j][1]
                total += sum("0" <= c <= "9" for c in text[groups[i][0] if total == 0 else last : end])
                last = end
                if total > DIGITS_MAX:
                    break
                lead = begin
                while lead > m.start() and text[lead - 1] in "+(":
                    lead -= 1
                if text[begin:end].count(".") == 3 and 4 <= total <= 12:
                    found.append(("ip", begin, end))
                if total >= DIGITS_MIN:
                    found.append(("phone", lead, end))
                if total >= 13:
                    found.append(("card", begin, end))
    found += [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)] if "@" in text or "at" in text else []
    return found


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Numbers on the span's format and on what stands beside it."""
    span = text[start:end]
    groups = [len(g) for g in GROUP.findall(span)] or [0]
    digits = digits_of(span)
    before, after = text[max(0, start - 24) : start], text[end : end + 1]
    found = [
        KINDS.index(kind),
        len(span),
        len(digits),
        len(groups),
        max(groups),
        min(groups),
        groups[0],
        groups[-1],
        groups[len(groups) // 2],
        sum(c.isalpha() for c in span),
        span.count("."),
        span.count("-"),
        span.count(" "),
        span.count("("),
        span.count("@"),
        float(span.count("(") == span.count(")")),
        float(luhn(digits)),
        min(max((int(g[-9:]) for g in GROUP.findall(span)), default=0), MOST_PART) if kind == "ip" else 0,
        float(before[-1:].isalnum()),
        float(before[-1:] in ("+", "=", '"', "'", ".", "-", "_")),
        float(after.isalnum()),
        float(after in ("-", "_", '"', "'")),
        float(bool(HINT.search(before))),
    ]
    return [x if i == PART else min(x, MOST) for i, x in enumerate(found)]


def _apart(found: list[tuple[str, int, int]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Those of ``found`` that overlap none of ``base``, which is in order of starts."""
    starts = [a for _, a, _ in base]
    # The furthest end of all that begin before a place.
    reach = [0, *accumulate((b for _, _, b in base), max)]
    return [c for c in found if reach[bisect_left(starts, c[2])] <= c[1]]


class Detector:
    """Base spans, and candidates beside them that the model scores above the threshold of their kind."""

    def __init__(self, model: Boosted | None = None, thresholds: dict[str, float] | None = None) -> None:
        self.model, self.thresholds = model, thresholds or {}

    def spans(self, text: str) -> list[dict]:
        base = base_spans(text)
        kept = [{"kind": k, "start": a, "end": b, "base": True, "score": 1.0} for k, a, b in base]
        if self.model is None:
            return kept
        free = _apart(candidates(text), base)
        if free:
            some = (free[i : i + JUDGED] for i in range(0, len(free), JUDGED))
            scores = [self.model.probability(np.array([features(text, *c) for c in part], float)) for part in some]
            likely = [
                (s, c) for s, c in zip(np.concatenate(scores).tolist(), free, strict=True) if s >= self.thresholds.get(c[0], 2.0)
            ]
            # Taken spans keep apart, so one that overlaps any overlaps a neighbour in their order.
            taken: list[tuple[int, int]] = []
            for s, (k, a, b) in sorted(likely, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
                place = bisect_left(taken, (a, b))
                if (place == 0 or taken[place - 1][1] <= a) and (place == len(taken) or taken[place][0] >= b):
                    taken.insert(place, (a, b))
                    kept.append({"kind": k, "start": a, "end": b, "base": False, "score": s})
        return sorted(kept, key=lambda s: (s["start"], KINDS.index(s["kind"])))


def drawn(found: list[tuple[str, int, int]], most: int) -> list[tuple[str, int, int]]:
    """At most so many candidates of each kind, from all over a document."""
    kept = []
    for kind in KINDS:
        own = [c for c in found if c[0] == kind]
        if len(own) > most:
            places = mix(np.array([(a << 20) + b - a for _, a, b in own], U))
            own = [own[i] for i in np.sort(np.argsort(places, kind="stable")[:most])]
        kept += own
    return kept


def forms(docs: DataFrame) -> DataFrame:
    """How often candidates of the same features ``x`` occur in all of ``docs``: ``n``, and ``y`` that are base spans."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("pii")
        held: Counter = Counter()
        positive: Counter = Counter()

        def close() -> pa.RecordBatch:
            columns = [list(held), list(held.values()), [positive[f] for f in held]]
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.list_(pa.float64()), pa.int64(), pa.int64()), strict=True)]
            held.clear()
            positive.clear()
            return pa.RecordBatch.from_arrays(arrays, ["x", "n", "y"])

        for batch in batches:
            for body in batch.column(0).to_pylist():
                found = candidates(body)
                base = set(base_spans(body)) if found else ()
                for c in found:
                    form = tuple(map(float, features(body, *c)))
                    held[form] += 1
                    if c in base:
                        positive[form] += 1
                if len(held) >= HELD_FORMS:
                    yield close()
        yield close()

    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.select(text.alias("text")).mapInArrow(gather, "x array<double>, n long, y long")
    return counted.groupBy("x").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))


def train(docs: DataFrame) -> Detector:
    """Fit the trees on all candidates of all documents, and set the thresholds on them.

    A candidate counts as personal data if it is a base span of its kind; what
    marks base spans alone (the plus sign of a phone number) is no feature, so that
    other writings of the same shape score high too. The candidates are counted by
    their features in the tasks, and only the counts of equal ones come to the driver,
    in an order of their own, so that the trees do not hang on the partitions. Each
    kind's threshold is set at a precision of ``PRECISION`` over all its candidates.
    Without examples of either sort only base spans are found.
    """
    counts = forms(docs).toPandas()  # as many rows as forms, which the bounds of the features limit
    if not counts.y.sum() or (counts.y == counts.n).all():
        return Detector()
    x = np.stack(counts.x.to_numpy())
    order = np.lexsort(x.T)
    x, n, y = x[order], counts.n.to_numpy()[order], counts.y.to_numpy()[order]
    labels = np.repeat([0, 1], len(x))
    times = np.concatenate([n - y, y])
    seen = times > 0
    model = Boosted().fit(np.concatenate([x, x])[seen], labels[seen], times[seen])
    scored = pd.DataFrame({"kind": x[:, 0].astype(int), "score": model.probability(x), "n": n, "y": y})
    scored = scored.groupby(["kind", "score"], as_index=False).sum()
    return Detector(model, {k: _threshold(scored[scored.kind == i]) for i, k in enumerate(KINDS)})


def _threshold(counts) -> float:
    """The smallest score from which on a share of ``PRECISION`` are base spans; above 1 if there is none."""
    falling = counts.sort_values("score", ascending=False)
    fits = (falling.y.cumsum() / falling.n.cumsum() >= PRECISION).to_numpy()
    return float(falling.score.to_numpy()[fits][-1]) if fits.any() else 2.0


def find(docs: DataFrame, detector: Detector) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end in code points, base, score) of each row.

    A null text is empty and has none; equal rows give equal rows; a document of any
    length is searched whole; other columns are not read.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("pii")
        for batch in batches:
            for part in slices(batch.column(2).to_pylist()):
                found = [detector.spans(t) for t in batch.column(1)[part].to_pylist()]
                columns = [batch.column(0)[part], pa.array(found, ARROW_SPANS)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "spans"])

    text = F.coalesce(F.col("text"), F.lit(""))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", SPANS)])
    return docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.length(text).alias("n")).mapInArrow(
        search, schema
    )


def redact(docs: DataFrame, detector: Detector) -> DataFrame:
    """``docs`` with each span replaced by its kind in angle brackets; null texts stay null.

    Of overlapping spans the first covers the rest. All columns and rows are kept.
    """
    place = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for s in detector.spans(text):
            if s["start"] >= done:
                out += [text[done : s["start"]], f"<{s['kind']}>"]
            done = max(done, s["end"])
        return "".join([*out, text[done:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process_memory("pii")
        for batch in batches:
            column = batch.column(place)
            texts = pa.array([clean(t) for t in column.to_pylist()], column.type)
            yield batch.set_column(place, batch.schema.field(place), texts)

    return docs.mapInArrow(rewrite, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts and the checksum of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["base"])

    def listed(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
