import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from spanwise.llm import spelling as S

COLUMNS = ["word", "n", "n_near", "form", "form_n", "root"]
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def counted(docs):
    words = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                words[run] += 1
    return {w: n for w, n in words.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """Every word compared with every other."""
    words = counted(docs)
    near = {w: [o for o in words if one_edit(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 10 * words[w]:
            form[w] = best
    result = set()
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        result.add((w, n, len(near[w]), form.get(w), words[form[w]] if w in form else None, root))
    return result


def found(frame, **parameters):
    rows = S.group_variants(frame, **parameters).select(*COLUMNS).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def texts(seed):
    rng = random.Random(seed)
    letters = "abcéÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 10))) for _ in range(25)]
    docs = []
    for doc in range(120):
        words = []
        for _ in range(40):
            word = list(bases[min(int(rng.expovariate(0.3)), 24)])
            for _ in range(rng.choice([0, 0, 0, 0, 1, 2])):
                place = rng.randrange(len(word))
                word[place : place + rng.randint(0, 1)] = rng.choice(["", rng.choice(letters), rng.choice("xyZ")])
            words.append("".join(word))
        docs.append((doc, " ".join(words)))
    return docs


@pytest.mark.parametrize("symbols", [2, 6])
def test_against_all_pairs(spark, symbols):
    docs = texts(symbols)
    result = found(spark.createDataFrame(docs, "doc_id long, text string"), symbols=symbols)
    assert result == brute(docs)
    assert any(r[3] for r in result)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    clashing = odd_docs.selectExpr("*", "1 AS word", "2 AS n", "'z' AS reduced")
    assert found(clashing) == brute(rows)
    assert found(no_docs) == set()


def test_chain_of_forms_and_ties(spark):
    counts = {"abcdefgh": 2, "abcdefgx": 20, "abcdefxx": 200, "abcdexxx": 2000, "abcdefgy": 20, "abcdexxy": 2000}
    docs = [(0, " ".join(" ".join([w] * n) for w, n in counts.items()))]
    # The same document for all, so that the checksum drops letters of a whole word or of none.
    assert len(counted(docs)) == len(counts)
    result = {r[0]: r for r in found(spark.createDataFrame(docs, "doc_id long, text string"))}
    assert result == {r[0]: r for r in brute(docs)}
    assert result["abcdefgh"][3] == "abcdefgx" and result["abcdefgh"][5] == "abcdexxx"


def test_very_long_words(spark):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghij") for _ in range(60_000))
    docs = [(1, f"{word} {word} {word[:30_000]}{word[30_001:]} {word[:30_000]}{word[30_001:]} {word}x {word}x")]
    assert found(spark.createDataFrame(docs, "doc_id long, text string")) == brute(docs)


def test_neighbourhoods_against_strings():
    """Keys agree exactly where the reduced words do."""
    rng = random.Random(7)
    words = {"".join(rng.choice("abc") for _ in range(size)) for size in (5, 6, 6, 7) for _ in range(60)}
    home, keys = {}, {}
    for word in words:
        codes = np.frombuffer(word.encode(), np.uint8).reshape(1, -1) - 97
        one, some, count = S.neighbourhoods(codes, 3)
        home[word], keys[word] = int(one[0]), some.tolist()
        assert len(set(keys[word])) == len(keys[word]) == count[0]
    for a in words:
        for b in words:
            met = (home[b] in keys[a]) + (home[a] in keys[b])
            assert met == one_edit(a, b)
