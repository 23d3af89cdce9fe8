"""Token ids of whole texts, with the encoding of repeated words reused."""

from __future__ import annotations

import gc
import os
import re
import sys
import types
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# A single space between two characters that no tokenizer takes for white space. Neither pre-tokenizer
# lets a token cross such a place, and Python's white space contains the Unicode one.
BETWEEN_WORDS = re.compile(r" (?<=\S )(?=\S)")
# White space of either kind, as a class of a pattern that knows no Unicode classes.
WHITE = r"\x00-\x20\x7f-\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# Words beside which a space is not such a place.
SPACE_AT_EDGE = rf"^$|^[{WHITE}]|[{WHITE}]$"
# Work on so many characters at a time, whatever the size of a batch.
SLICE_CHARS = 6_000_000
# So many words are given to the tokenizer as one text.
RUN = 8192
# Known words are forgotten beyond so many characters; they are then encoded anew, with the same ids.
MEMORY_CHARS = 14_000_000


def process_memory(owner: str) -> dict:
    """Objects that later tasks of the same Python worker may use again.

    They last as long as the worker's tasks belong to one ``owner``: an operator that
    begins frees what the one before it kept.
    """
    module = sys.modules.setdefault("_spanwise_task_memory", types.ModuleType("_spanwise_task_memory"))
    if module.__dict__.get("owner") != owner:
        module.__dict__.update(owner=owner, kept={})
        gc.collect()
        pa.default_memory_pool().release_unused()
    return module.__dict__["kept"]


def slices(sizes: Iterable[int], most: int = SLICE_CHARS) -> Iterator[slice]:
    """Runs of consecutive rows of about ``most`` in total; a larger row stands alone."""
    begin = total = 0
    end = -1
    for end, size in enumerate(sizes):
        if total and total + size > most:
            yield slice(begin, end)
            begin, total = end, 0
        total += size
    if end >= begin:
        yield slice(begin, end + 1)


def _grown(array: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``array`` with ``more`` behind its first ``used`` elements, in a larger one if need be."""
    if used + len(more) > len(array):
        larger = np.empty(max(2 * len(array), used + len(more)), array.dtype)
        larger[:used] = array[:used]
        array = larger
    array[used : used + len(more)] = more
    return array


class TextEncoder:
    """Encodes texts with a tokenizer file, without special tokens.

    The ids equal those of encoding each text as a whole: texts are cut only where
    no token can cross, and each distinct word is given to the tokenizer once, many
    of them in one text.
    """

    MARK = "|"

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        mark = self._ids([f" {self.MARK}"])[0]
        self.mark = mark[0] if len(mark) == 1 else None
        # Tokens that only begin, or only end, a word after a space; None if the vocabulary marks neither.
        size, vocabulary = self.tokenizer.get_vocab_size(), self.tokenizer.get_vocab().items()
        begins, ends = np.zeros(size, bool), np.zeros(size, bool)
        begins[[i for t, i in vocabulary if t.startswith("\u0120")]] = True
        ends[[i for t, i in vocabulary if t.endswith("</w>")]] = True
        self.begins = begins if begins.any() else None
        self.ends = ends if ends.any() else None
        self._forget()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _forget(self) -> None:
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.used = self.known = self.chars = 0
        self.starts = np.empty(1 << 16, np.int32)
        self.sizes = np.empty(1 << 16, np.int32)

    def _add(self, ids: np.ndarray, sizes: np.ndarray, words: list[str], known: dict[str, int]) -> None:
        begin = self.known
        known.update(zip(words, range(begin, begin + len(words)), strict=True))
        self.chars += sum(map(len, words))
        self.flat = _grown(self.flat, self.used, ids)
        self.starts = _grown(self.starts, begin, self.used + np.cumsum(sizes) - sizes)
        self.sizes = _grown(self.sizes, begin, sizes)
        self.known += len(words)
        self.used += len(ids)

    def _codes(self, words: list[str], known: dict[str, int], prefix: str) -> np.ndarray:
        """Numbers of ``words``; those met for the first time are encoded."""
        codes = list(map(known.get, words))
        unknown = [i for i, c in enumerate(codes) if c is None]
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            if prefix == " ":
                for i in range(0, len(new), RUN):
                    self._learn_run(new[i : i + RUN], known)
            else:
                self._learn(new, self._ids([prefix + w for w in new]), known)
            for i in unknown:
                codes[i] = known[words[i]]
        return np.array(codes, np.int32)

    def _learn_run(self, words: list[str], known: dict[str, int]) -> None:
        """Encode words that follow a space as one text, and tell them apart by their first or last ids."""
        if self.ends is not None:
            plain = [w for w in words if w.isalpha()]
            words = [w for w in words if not w.isalpha()]
        else:
            plain, words = (words, []) if self.begins is not None else ([], words)
        ids = np.array(self._ids([" " + " ".join(plain)])[0] if plain else [], np.int64)
        if plain and self.ends is not None:
            stops = np.flatnonzero(self.ends[ids]) + 1
        else:
            stops = np.append(np.flatnonzero(self.begins[ids])[1:], len(ids)) if plain else np.empty(0, np.int64)
        if len(stops) == len(plain) and (not plain or stops[-1] == len(ids)):
            self._add(ids, np.diff(stops, prepend=0), plain, known)
        else:
            words = words + plain
        marked = [w for w in words if self.mark is not None and self.MARK not in w]
        if marked:
            ids = np.array(self._ids(["".join(f" {w} {self.MARK}" for w in marked)])[0], np.int64)
            stops = np.flatnonzero(ids == self.mark)
            self._add(np.delete(ids, stops), np.diff(stops, prepend=-1) - 1, marked, known)
        rest = [w for w in words if self.mark is None or self.MARK in w]
        self._learn(rest, self._ids([" " + w for w in rest]), known)

    def _learn(self, words: list[str], found: list[list[int]], known: dict[str, int]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self._add(np.fromiter((i for x in found for i in x), np.int64, int(sizes.sum())), sizes, words, known)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the non-null ``texts`` one after another, and where each text's ids end."""
        if self.chars > MEMORY_CHARS:
            self._forget()
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        edged = pc.match_substring_regex(coded.dictionary, SPACE_AT_EDGE).to_numpy(zero_copy_only=False)
        numbers = np.zeros(len(edged), np.int32)
        numbers[~edged] = self._codes(coded.dictionary.filter(pa.array(~edged)).to_pylist(), self.later, " ")
        at = coded.indices.to_numpy(zero_copy_only=False)
        codes = numbers[at]
        begins, counts = words.offsets.to_numpy()[:-1], np.diff(words.offsets.to_numpy())
        # Splitting a text gives one word at least.
        plain = ~np.logical_or.reduceat(edged[at], begins) if len(texts) else np.zeros(0, bool)
        opening = begins[plain]
        codes[opening] = self._codes(words.flatten().take(pa.array(opening)).to_pylist(), self.first, "")
        if not plain.all():
            codes = codes[np.repeat(plain, counts)]
            rest = [BETWEEN_WORDS.split(t) for t in texts.filter(pa.array(~plain)).to_pylist()]
            counts[~plain] = [len(r) for r in rest]
            mixed = np.empty(int(counts.sum()), np.int32)
            own = np.repeat(plain, counts)
            mixed[own] = codes
            other = self._codes([w for r in rest for w in r], self.later, " ")
            other[np.cumsum([0, *map(len, rest[:-1])])] = self._codes([r[0] for r in rest], self.first, "")
            mixed[~own] = other
            codes = mixed
        sizes = self.sizes[codes]
        stops = np.cumsum(sizes, dtype=np.int64)
        total = int(stops[-1]) if len(stops) else 0
        at = np.arange(total, dtype=np.int32)
        at += np.repeat(self.starts[codes] - (stops - sizes).astype(np.int32), sizes)
        ids = self.flat[at]
        return ids, stops[np.cumsum(counts) - 1] if len(counts) else counts


def text_encoder(path: str) -> TextEncoder:
    """The encoder of a tokenizer file; loaded once by a worker process."""
    kept = process_memory("tokens")
    if path not in kept:
        kept[path] = TextEncoder(path)
    return kept[path]
