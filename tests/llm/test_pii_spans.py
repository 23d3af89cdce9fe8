import random
import time

from spanwise.llm import pii
from spanwise.llm.boosting import Boosted

WORDS = ["+49 170 1234567", "a.b@c.example.org", "4111 1111 1111 1111", "10.0.0.17", "word", "(030) 44-55", "x at y dot com"]
THRESHOLDS = {"email": 0.3, "ip": 0.4, "card": 0.5, "phone": 0.6}


class Scores:
    """Some score for any features."""

    def probability(self, x):
        return (x.sum(axis=1) * 0.137) % 1.0


def one_by_one(text):
    """Every candidate held against every span taken before it."""
    base = pii.base_spans(text)
    kept = {(k, a, b) for k, a, b in base}
    free = [c for c in pii.candidates(text) if not any(a < c[2] and c[1] < b for _, a, b in base)]
    scored = [(float(Scores().probability(pii.np.array([pii.features(text, *c)], float))[0]), c) for c in free]
    taken = []
    for s, (k, a, b) in sorted(scored, key=lambda x: (-x[0], x[1][1] - x[1][2], x[1])):
        if s >= THRESHOLDS[k] and not any(x < b and a < y for x, y in taken):
            taken.append((a, b))
            kept.add((k, a, b))
    return kept


def test_spans_against_all_pairs():
    rng = random.Random(3)
    detector = pii.Detector(Scores(), THRESHOLDS)
    for _ in range(120):
        number = lambda: str(rng.randint(1, 10 ** rng.randint(1, 9)))
        text = " ".join(rng.choice([*WORDS, number(), number(), number()]) for _ in range(40))
        assert {(s["kind"], s["start"], s["end"]) for s in detector.spans(text)} == one_by_one(text)


def test_many_numbers_take_linear_time():
    rng = random.Random(4)
    detector = pii.Detector(Scores(), THRESHOLDS)

    def seconds(n):
        text = " ".join(str(rng.randint(100, 9999)) for _ in range(n))
        begun = time.process_time()
        assert detector.spans(text)
        return time.process_time() - begun

    seconds(1_000)
    assert seconds(48_000) < 12 * seconds(8_000) + 1


def test_counts_and_thresholds_come_from_every_document(spark):
    """More documents than a sample of 4,000 would hold, each with one candidate of its own kind of writing."""
    rows = [(i, f"call +49 170 {1000000 + i}") for i in range(9000)] + [(9000 + i, f"no {1000000 + i}") for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.forms(docs).collect()
    assert sum(r["n"] for r in found) == sum(len(pii.candidates(t)) for _, t in rows)
    assert sum(r["y"] for r in found) == 9000
    assert pii.train(docs).thresholds["phone"] <= 1


def test_counted_rows_fit_the_same_trees_as_written_out_rows():
    rng = pii.np.random.default_rng(8)
    x = rng.integers(0, 6, (60, 3)).astype(float)
    times = rng.integers(1, 9, 60)
    y = (x[:, 0] + rng.integers(0, 3, 60) > 4).astype(int)
    once = Boosted().fit(x, y, times)
    out = Boosted().fit(pii.np.repeat(x, times, axis=0), pii.np.repeat(y, times))
    assert pii.np.allclose(once.probability(x), out.probability(x))
