import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanwise.llm import packing, token_files
from spanwise.llm.queries import QUERIES
from spanwise.llm.tokens import TextEncoder, slices

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"


def plain(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_words_encode_like_whole_texts(name, small_docs):
    odd = ["", " ", "  a  b\n\n c's d ", "x́ ́y \x1c z", "a\x85 b", "ΑΣ Σας ΣΑΣ", "| a | b", "İ İx <|endoftext|> q", "क़ क़"]
    texts = [r["text"] for r in small_docs.select("text").collect()] + odd
    encoder, reference = TextEncoder(public_tokenizers.path(name)), plain(name)
    for _ in range(2):
        ids, ends = encoder.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [reference(t) for t in texts]


def test_slices_keep_order_and_size():
    assert list(slices([3, 3, 9, 1, 1], 6)) == [slice(0, 2), slice(2, 3), slice(3, 5)]
    assert list(slices([], 6)) == []


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, (1 << 32) - 1)), st.sampled_from([1, 2]))
def test_coding_round_trip(ranks, bits):
    values = np.array(ranks, np.uint32) & np.uint32(0xFFFF if bits == 1 else 0xFFFFFFFF)
    control, data = token_files.encode(values, bits)
    assert len(control) == -(-len(values) * bits // 8)
    assert np.array_equal(token_files.decode(control, data, len(values), bits), values)


def checksum(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_files_hold_all_documents_in_order(spark, small_docs):
    encode = plain(FILES[0])
    rows = sorted((r["doc_id"], r["text"]) for r in small_docs.select("doc_id", "text").collect())
    wanted, start = [], 0
    for doc, text in rows:
        ids = [*encode(text), 0]
        wanted.append((doc, start, len(ids), checksum(ids)))
        start += len(ids)
    found = QUERIES["op10_token_files"](spark, SMALL).collect()
    assert sorted(tuple(r) for r in found) == wanted


def test_files_of_odd_rows(spark, odd_docs, no_docs):
    path = public_tokenizers.path(FILES[0])
    folder = token_files.token_folder(spark)
    files = token_files.write(odd_docs, path, 50_257, folder)
    found = sorted(tuple(r) for r in token_files.read(spark, files, folder).filter("doc_id IS NOT NULL").collect())
    encode = plain(FILES[0])
    texts = {r["doc_id"]: r["text"] or "" for r in odd_docs.collect()}
    assert [(d, n, c) for d, _, n, c in found] == sorted(
        (d, len(encode(t)) + 1, checksum([*encode(t), 0])) for d, t in [*texts.items(), (6, texts[6])] if d is not None
    )
    folder = token_files.token_folder(spark)
    assert token_files.read(spark, token_files.write(no_docs, path, 50_257, folder), folder).collect() == []


def test_packing_places_every_piece_once(spark, small_docs):
    encode, size = plain(FILES[1]), 256
    path = public_tokenizers.path(FILES[1])
    placed = packing.pack(small_docs, path, size=size)
    rows = placed.collect()
    texts = {r["doc_id"]: [*encode(r["text"]), 0] for r in small_docs.select("doc_id", "text").collect()}
    bins = {}
    for r in rows:
        ids = texts[r["doc_id"]]
        assert r["start"] == r["piece"] * size and r["length"] == min(size, len(ids) - r["start"])
        assert r["ids_crc32"] == checksum(ids[r["start"] : r["start"] + r["length"]])
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert len(rows) == sum(-(-len(ids) // size) for ids in texts.values())
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:i]) for i in range(len(parts))]
        assert sum(n for _, n in parts) <= size
    least = -(-sum(map(len, texts.values())) // size)
    assert len(bins) <= 1.02 * least + 2
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(small_docs, placed, path).collect()}
    assert all(whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == texts[r["doc_id"]][r["start"] : r["start"] + r["length"]] for r in rows)


def test_sum_of_squares_places_as_by_definition():
    rng = np.random.default_rng(1)
    packer, size, bins = packing.SumOfSquares(30), 30, []

    def squares(levels):
        gaps = [size - x for x in levels if x < size]
        return sum(gaps.count(g) ** 2 for g in set(gaps))

    for length in rng.integers(1, 31, 300).tolist():
        options = [(squares([*bins[:i], bins[i] + length, *bins[i + 1 :]]), i) for i in range(len(bins)) if bins[i] + length <= size]
        best = min([s for s, _ in options] + [squares([*bins, length])])
        place, offset = packer.place(length)
        if place == len(bins):
            bins.append(0)
        assert offset == bins[place]
        bins[place] += length
        assert bins[place] <= size and squares(bins) == best


def test_packing_odd_rows(odd_docs, no_docs):
    path = public_tokenizers.path(FILES[1])
    rows = packing.pack(odd_docs, path, size=64, shard=3).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] in (1, 2, 3)) == 3
    assert len([r for r in rows if r["doc_id"] == 6]) == 2 and [r for r in rows if r["doc_id"] is None]
    assert packing.pack(no_docs, path).collect() == []
