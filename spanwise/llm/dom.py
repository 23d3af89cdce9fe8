"""Element trees of web pages, and their alignment by simple tree matching."""

from __future__ import annotations

import hashlib
import html
import re
from collections import defaultdict

import numpy as np

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*+>?", re.S
)
NAMES = re.compile(r"\b(class|id|hidden|style|aria-hidden|role)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
TOKEN = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# Elements of the markup language.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp template".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th"
    " thead tr ul".split()
)
SAME_CLOSES = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"),
               "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}

# Weight of an equal text in an alignment; more than any tree has nodes.
SAME_TEXT = 1 << 32


class Node:
    """An element: its tag, the tokens of its class, id and role, and its texts and elements in order."""

    __slots__ = ("tag", "tokens", "names", "hidden", "parts", "kids", "text", "number")

    def __init__(self, tag: str, tokens: frozenset = frozenset(), hidden: bool = False, names: frozenset = frozenset()) -> None:
        self.tag, self.tokens, self.hidden, self.names = tag, tokens, hidden, names
        self.parts: list = []
        self.kids: list[Node] = []
        self.text, self.number = 0, -1

    @property
    def key(self) -> str:
        return f"{self.tag}.{'.'.join(sorted(self.tokens))}"


def _node(tag: str, attributes: str) -> Node:
    if not attributes or attributes.isspace():
        return Node(tag)
    tokens: list[str] = []
    names: list[str] = []
    hidden = False
    for name, value in NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            # Numbers in names tell records apart, not kinds of them.
            tokens += [t for t in TOKEN.findall(value.lower()) if not t.isdigit()]
            names += value.lower().split() if name != "id" else []
        else:
            hidden |= name == "hidden" or (name == "aria-hidden" and value == "true") or bool(HIDDEN.search(value))
    return Node(tag, frozenset(tokens), hidden, frozenset(names))


class Open:
    """The elements that are open while a page is read, and where those of each tag stand."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.stack))
        if node.tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, *tags: str) -> int:
        """The innermost place of any of these tags; 0 if none is open."""
        return max((self.places[t][-1] for t in tags if self.places[t]), default=0)

    def close(self, place: int) -> None:
        """Close the element at a place, and all in it; nothing at place 0."""
        if place:
            for node in self.stack[place:]:
                self.places[node.tag].pop()
                if node.tag in BLOCK:
                    self.blocks.pop()
            del self.stack[place:]


def parse(source: str) -> Node:
    """The tree of a page; missing end tags are implied, stray ones ignored, scripts and the like left empty.

    Pages may be of any length and depth; the time is in proportion to the length.
    """
    root = Node("#root")
    now = Open(root)
    at = 0
    while True:
        found = MARKUP.search(source, at)
        text = source[at : found.start()] if found else source[at:]
        if text:
            now.stack[-1].parts.append(html.unescape(text))
        if not found:
            break
        at = found.end()
        tag = (found[2] or "").lower()
        if not tag:
            continue
        if found[1]:
            now.close(now.last(tag))
            continue
        # A paragraph ends where a block begins, unless another block has begun inside it.
        paragraph = now.last("p") if tag in BLOCK else 0
        if paragraph and now.blocks[-1] == paragraph:
            now.close(paragraph)
        if tag in SAME_CLOSES:
            closed, bound = (now.last(*x.split()) for x in SAME_CLOSES[tag])
            if closed > bound:
                now.close(closed)
        node = _node(tag, found[3])
        now.stack[-1].parts.append(node)
        now.stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif tag not in VOID and not found[3].rstrip().endswith("/"):
            now.push(node)
    _finish(root)
    return root


def digest(text: str) -> int:
    """64 bits of a text, the same in every process; 0 if there is none."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1 if text else 0


def _finish(root: Node) -> None:
    """Number all nodes from the root on and give each the digest of the text that stands directly in it."""
    for number, node in enumerate(nodes(root)):
        node.number = number
        node.text = digest(" ".join(" ".join(p for p in node.parts if isinstance(p, str)).split()))


def nodes(root: Node) -> list[Node]:
    """All nodes of a tree, each before its kids."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += reversed(node.kids)
    return found


def align(a: Node, b: Node) -> dict[int, int]:
    """Simple tree matching: numbers of nodes of ``a`` by those of ``b``, in a heaviest match.

    Matched nodes have the same key, matched parents and the same order. Matches of
    nodes with the same own text come first, then the number of matched nodes: without
    texts in common this is a largest match. Brothers of equal content at either end of
    two lists are matched at once, which loses nothing.
    """
    sides = nodes(a), nodes(b)
    common = {n.text for n in sides[0] if n.text} & {n.text for n in sides[1] if n.text}
    # Subtrees that differ in texts only one side has are of equal content; contents are numbered.
    numbers: dict[tuple, int] = {}
    contents: list[dict[int, int]] = [{}, {}]
    for side, held in zip(sides, contents, strict=True):
        for n in reversed(side):
            text = n.text if n.text in common else 0
            content = (n.tag, n.tokens, text, tuple(held[k.number] for k in n.kids))
            held[n.number] = numbers.setdefault(content, len(numbers))
    ours, theirs = contents
    weights: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def weight(x: Node, y: Node) -> int | None:
        """What a match of both brings; none if that is not known yet."""
        if x.tag != y.tag or x.tokens != y.tokens:
            return 0
        return weights.get((ours[x.number], theirs[y.number]))

    def ends(x: Node, y: Node) -> tuple[int, int]:
        """How many kids are of equal content from the first on, and from the last on."""
        left, right = [ours[k.number] for k in x.kids], [theirs[k.number] for k in y.kids]
        least = min(len(left), len(right))
        lo = hi = 0
        while lo < least and left[lo] == right[lo]:
            lo += 1
        while hi < least - lo and left[-1 - hi] == right[-1 - hi]:
            hi += 1
        return lo, hi

    def choose(x: Node, y: Node, lo: int, hi: int) -> None:
        """Match the kids of both, whose weights are known."""
        n, m = len(x.kids), len(y.kids)
        pairs = [(i, i) for i in range(lo)] + [(n - 1 - i, m - 1 - i) for i in range(hi)]
        total = sum(weight(x.kids[i], y.kids[j]) for i, j in pairs)
        n, m = n - lo - hi, m - lo - hi
        if n and m:
            each = np.array([[weight(p, q) for q in y.kids[lo : lo + m]] for p in x.kids[lo : lo + n]], dtype=np.int64)
            best = np.zeros((n + 1, m + 1), dtype=np.int64)
            for i in range(n):
                np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + each[i]), out=best[i + 1, 1:])
            i, j = n, m
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((lo + i, lo + j))
            total += int(best[n, m])
        known = (ours[x.number], theirs[y.number])
        chosen[known] = pairs
        weights[known] = 1 + total + (SAME_TEXT if x.text and x.text == y.text else 0)

    # Kids before their parents, on a stack of its own: trees may be of any depth.
    waiting = [(a, b)]
    while waiting:
        x, y = waiting[-1]
        if weight(x, y) is not None:
            waiting.pop()
            continue
        lo, hi = ends(x, y)
        n, m = len(x.kids), len(y.kids)
        outer = [(i, i) for i in range(lo)] + [(n - 1 - i, m - 1 - i) for i in range(hi)]
        wanted = [(x.kids[i], y.kids[j]) for i, j in outer]
        wanted += [(p, q) for p in x.kids[lo : n - hi] for q in y.kids[lo : m - hi]]
        open_pairs = [(p, q) for p, q in wanted if weight(p, q) is None]
        if open_pairs:
            waiting += open_pairs
        else:
            choose(x, y, lo, hi)
            waiting.pop()

    matched: dict[int, int] = {}
    todo = [(a, b)] if weight(a, b) else []
    while todo:
        x, y = todo.pop()
        matched[y.number] = x.number
        todo += [(x.kids[i], y.kids[j]) for i, j in chosen[ours[x.number], theirs[y.number]]]
    return matched
