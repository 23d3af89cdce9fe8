"""Main texts of web pages by wrappers induced for each host and layout."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.dom import BLOCK, Node, align, digest, nodes, parse
from spanwise.session import materialise

# Pages of a host and layout that go to one task; larger groups are split.
PART_PAGES = 2_000
PARSED_AT_ONCE = 500
# A node is template if so many other pages were aligned with it and so many of them have the same text there;
# in an article, where documents may share lines, the same share of all pages must have it.
LEAST_PAGES, SAME_SHARE = 3, 0.9

# Levels below the body that tell layouts apart: by their blocks in order, and by the set of containers.
DEPTHS = (2, 4)
CONTAINERS = set("article aside center details div fieldset footer form header main menu nav section table".split())

# What stands around an article.
NEVER = set("script style noscript template iframe object svg canvas head title nav aside footer form button select dialog".split())
AROUND = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar"
    " navigation breadcrumb breadcrumbs footer cookie cookies consent notice notices alert popup modal newsletter"
    " subscribe subscription share sharing social related recommended comment comments reply replies respond disqus"
    " widget pagination pager toolbar login signup search".split()
)
HEADERS = set("header masthead topbar".split())
# What an article is written in: an anchor's id, or a word of a longer name, says nothing about it.
PROSE = set("h1 h2 h3 h4 h5 h6 p blockquote pre figcaption".split())

ROW = "page_id long, url string, text string, n_chars long"


def around(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article, by its tag, its names or for being hidden."""
    if node.tag in NEVER or node.hidden or (node.names if node.tag in PROSE else node.tokens) & AROUND:
        return True
    return not inside and (node.tag == "header" or bool(node.tokens & HEADERS))


def regions(root: Node, template: set[int]) -> list[Node]:
    """The outermost articles, else the main elements, that hold more than template; else nothing."""
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.tag == tag or (tag == "main" and "main" in node.tokens):
                found.append(node)
            elif not around(node, False):
                todo += reversed(node.kids)
        if any(blocks(n, template) for n in found):
            return found
    return []


def blocks(region: Node, template: set[int]) -> list[str]:
    """The texts of the blocks of a region in page order; white space inside each is one space."""
    done: list[str] = []
    line: list[str] = []

    def close() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            done.append(text)

    # Elements wait on the stack with their parts still to come; None ends a block.
    todo: list = [region]
    while todo:
        part = todo.pop()
        if part is None:
            close()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif part is region or not around(part, region.tag != "#root"):
            parts = [p for p in part.parts if not (isinstance(p, str) and part.number in template)]
            if part.tag in BLOCK:
                close()
                todo.append(None)
            todo += reversed(parts)
    close()
    return done


def main_text(root: Node, template: set[int]) -> str:
    """What varies in the article elements; without one that varies, all that is neither template nor around an article."""
    texts = [t for n in regions(root, template) or [root] for t in blocks(n, template)]
    return "\n".join(texts)


def articles(root: Node) -> set[int]:
    """The numbers of the nodes in article and main elements."""
    found, todo = set(), [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside |= node.tag in ("article", "main") or "main" in node.tokens
        if inside:
            found.add(node.number)
        todo += [(k, inside) for k in node.kids]
    return found


def constants(pivot: Node, template: set[int], page: Node) -> set[int]:
    """The nodes of a page that are aligned with template and have its text."""
    if not template:
        return set()
    texts = {n.number: n.text for n in nodes(pivot) if n.number in template}
    pairs = align(pivot, page)
    return {n.number for n in nodes(page) if n.text and texts.get(pairs.get(n.number)) == n.text}


def packed(root: Node) -> str:
    """A tree without its texts, of which only digests are kept."""
    lines, todo = [], [(root, 0)]
    while todo:
        node, depth = todo.pop()
        lines.append(f"{depth} {node.tag} {f'{node.text:x}' if node.text else ''} {' '.join(sorted(node.tokens))}")
        todo += [(k, depth + 1) for k in reversed(node.kids)]
    return "\n".join(lines)


def unpacked(source: str) -> Node:
    """The tree of ``packed``."""
    path: list[Node] = []
    for number, line in enumerate(source.split("\n")):
        depth, tag, text, tokens = line.split(" ", 3)
        node = Node(tag, frozenset(tokens.split()))
        node.number, node.text = number, int(text or "0", 16)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return path[0]


def layouts(root: Node) -> tuple[int, int]:
    """Digests of the upper tree: of its blocks in order, and of the set of its containers."""
    body = next((n for n in nodes(root) if n.tag == "body"), root)
    containers: set[str] = set()

    def outline(node: Node, depth: int) -> str:
        if depth > DEPTHS[1] or node.tag in ("article", "main"):
            return node.key
        kids = []
        for kid in node.kids:
            if kid.tag in BLOCK:
                if kid.tag in CONTAINERS:
                    containers.add(kid.key)
                own = outline(kid, depth + 1)
                # The number of brothers alike is no matter of layout.
                if own not in kids[-1:]:
                    kids.append(own)
        return f"{node.key}({' '.join(kids)})" if depth <= DEPTHS[0] and kids else node.key

    fine = "".join(outline(body, 0))
    return digest(fine), digest(" ".join(["set", *sorted(containers)]))


def _rows(pages: DataFrame) -> DataFrame:
    """``pages`` by host; a page without a host shares one with the others like it."""
    host = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)
    return pages.select(
        F.col("page_id").cast("long"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html")
    ).withColumn("host", F.lower(host))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    arrays = [pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _parsed(rows: DataFrame) -> DataFrame:
    """``rows`` read once: ``fine, coarse`` layouts, ``digest`` of the main text, ``plain`` text, and the packed ``tree``.

    The main text is that without a template. Where there is none, layouts and tree are null.
    """
    schema = pa.schema(
        {"page_id": pa.int64(), "url": pa.string(), "html": pa.string(), "host": pa.string(), "fine": pa.int64(),
         "coarse": pa.int64(), "digest": pa.int64(), "plain": pa.string(), "tree": pa.string()}
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few pages at a time: their trees are many times as large.
            for begin in range(0, batch.num_rows, PARSED_AT_ONCE):
                some = batch.slice(begin, PARSED_AT_ONCE)
                found = []
                for source in some.column("html").to_pylist():
                    root = parse(source)
                    text = main_text(root, set())
                    known = (*layouts(root), digest(text)) if text else (None, None, None)
                    found.append((*known, text, packed(root) if text else None))
                own = [some.column(c).cast(schema.field(c).type) for c in ("page_id", "url", "html", "host")]
                more = [pa.array([f[i] for f in found], t) for i, t in enumerate(schema.types[4:])]
                yield pa.RecordBatch.from_arrays([*own, *more], schema=schema)

    columns = rows.select("page_id", "url", "html", "host")
    return columns.mapInArrow(
        place,
        "page_id long, url string, html string, host string, fine long, coarse long, digest long, plain string, tree string",
    )


def _dealt(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Pages (``source``) by part of their group, each part led by the group's pivot and what is known of it."""
    lead = wrappers.select(
        "host",
        "layout",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.lit(False).alias("page"),
        F.lit(None).cast("long").alias("page_id"),
        F.lit(None).cast("string").alias("url"),
        F.col("pivot").alias("source"),
        "template",
    )
    own = pages.select(
        "host",
        "layout",
        F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(PART_PAGES))).alias("part"),
        F.lit(True).alias("page"),
        "page_id",
        "url",
        "source",
        F.lit(None).cast("array<int>").alias("template"),
    )
    key = ("host", "layout", "part")
    return lead.unionByName(own).repartition(*key).sortWithinPartitions(*key, "page")


def _pages(batches: Iterator[pa.RecordBatch]):
    """((host, layout), pivot's packed tree, template, page_id, url, source) of each page."""
    group = pivot = template = None
    for batch in batches:
        names = batch.schema.names
        at = [names.index(c) for c in ("host", "layout", "page", "page_id", "url", "source", "template")]
        for i in range(batch.num_rows):
            host, layout, page, page_id, url, source, known = (batch.column(c)[i].as_py() for c in at)
            if not page:
                group, pivot, template = (host, layout), source, set(known or ())
            elif layout is None:
                yield (host, None), None, set(), page_id, url, source
            else:
                yield group, pivot, template, page_id, url, source


def _kinds(shapes: DataFrame) -> DataFrame:
    """``host, fine, coarse, layout, pages``: the group of pages whose wrapper serves those of each layout.

    That is the layout itself if enough pages with different texts have it, else the
    pages of the same containers, else the whole host.
    """
    fine = shapes.groupBy("host", "fine", "coarse", "text").agg(F.count(F.lit(1)).alias("n"))
    fine = fine.groupBy("host", "fine", "coarse").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("pages"))
    coarse = fine.groupBy("host", "coarse").agg(F.sum("texts").alias("coarse_texts"))
    layout = (
        F.when(F.col("texts") > LEAST_PAGES, F.concat_ws(" ", "coarse", "fine"))
        .when(F.col("coarse_texts") > LEAST_PAGES, F.col("coarse").cast("string"))
        .otherwise(F.lit(""))
    )
    return fine.join(coarse, ["host", "coarse"]).select("host", "fine", "coarse", layout.alias("layout"), "pages")


def induce(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``host, fine, coarse, layout, parts`` and ``host, layout, parts, pivot, template``.

    The first names the group of pages whose wrapper serves a layout, the second has
    for each group a pivot page and the numbers of its template nodes. Every page is
    aligned with the pivot of its group by simple tree matching. A pivot node whose own
    text stays the same on nearly all aligned pages is template. Pages with the same
    text apart from what stands around articles are copies and count once, pages
    without such text do not count. Counts are added up in the tasks before they are
    shuffled. Node -1 stands for all pages that were counted.
    """
    shapes = parsed.filter("digest IS NOT NULL").select("host", "fine", "coarse", F.col("digest").alias("text"), "tree")
    kinds = materialise(_kinds(shapes), "kinds")
    groups = kinds.groupBy("host", "layout").agg(F.ceil(F.sum("pages") / PART_PAGES).cast("long").alias("parts"))
    ways = F.array(F.concat_ws(" ", "coarse", "fine"), F.col("coarse").cast("string"), F.lit(""))
    members = shapes.withColumn("layout", F.explode(ways)).join(groups, ["host", "layout"])
    # Groups serve pages of rare layouts too, but are induced from all pages that they cover.
    pivots = materialise(
        members.groupBy("host", "layout").agg(
            F.min_by("tree", F.struct(F.xxhash64("text"), "text", "tree")).alias("pivot"),
            F.first("parts").alias("parts"),
            F.ceil(F.count(F.lit(1)) / PART_PAGES).cast("long").alias("all_parts"),
        ),
        "pivots",
    )
    distinct = members.groupBy("host", "layout", "text").agg(F.min("tree").alias("source"))
    distinct = distinct.join(pivots.select("host", "layout", F.col("all_parts").alias("parts")), ["host", "layout"])
    distinct = distinct.withColumnRenamed("text", "page_id").withColumn("url", F.lit(None).cast("string"))
    schema = pa.schema({"host": pa.string(), "layout": pa.string(), "node": pa.int32(), "inside": pa.bool_(), "seen": pa.int64(), "same": pa.int64()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        same: Counter = Counter()
        last = None
        for group, source, _, _, _, tree in _pages(batches):
            if group != last:
                last, pivot = group, unpacked(source)
                model, inside = {n.number: n.text for n in nodes(pivot) if n.text}, articles(pivot)
            if tree == source:
                continue
            page = unpacked(tree)
            own = {n.number: n.text for n in nodes(page) if n.text}
            pairs = [(p, own[n]) for n, p in align(pivot, page).items() if n in own and p in model]
            seen.update([(*group, -1, False), *((*group, p, p in inside) for p, _ in pairs)])
            same.update((*group, p, p in inside) for p, t in pairs if model[p] == t)
        yield _batch([(*k, n, same[k]) for k, n in seen.items()], schema)

    unknown = pivots.select("host", "layout", F.col("all_parts").alias("parts"), "pivot", F.lit(None).cast("array<int>").alias("template"))
    counts = _dealt(distinct, unknown).mapInArrow(
        count, "host string, layout string, node int, inside boolean, seen long, same long"
    )
    total = counts.groupBy("host", "layout", "node", "inside").agg(F.sum("seen").alias("seen"), F.sum("same").alias("same"))
    by_group = total.groupBy("host", "layout").agg(
        F.max(F.when(F.col("node") == -1, F.col("seen"))).alias("all"),
        F.collect_list(F.struct("node", "inside", "seen", "same")).alias("nodes"),
    )
    constant = F.filter(
        "nodes",
        lambda n: (n["seen"] >= LEAST_PAGES)
        & (n["same"] >= SAME_SHARE * F.when(n["inside"], F.col("all")).otherwise(n["seen"])),
    )
    template = by_group.select("host", "layout", F.transform(constant, lambda n: n["node"]).alias("template"))
    served = kinds.join(groups, ["host", "layout"]).select("host", "fine", "coarse", "layout", "parts")
    wrappers = pivots.join(template, ["host", "layout"], "left")
    return served, wrappers.select("host", "layout", "parts", "pivot", "template")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of each row of ``pages``: its main text, block by block.

    Null and empty pages have an empty text; pages without markup are their own text;
    equal rows give equal rows; an empty table gives no rows; other columns are not read.
    """
    rows = _rows(pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(zip(*held, strict=True), (pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)
            arrays = [pa.array(c, t) for c, t in columns]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text", "n_chars"])

        last = pivot = None
        for group, tree, template, page_id, url, source in _pages(batches):
            if group != last:
                last, pivot = group, unpacked(tree) if template else None
            page = parse(source)
            text = main_text(page, constants(pivot, template, page))
            held.append((page_id, url, text, len(text)))
            if len(held) >= 500:
                yield flush()
        if held:
            yield flush()

    rows = _rows(pages)
    parsed = materialise(_parsed(rows).drop("html"), "parsed", "zstd")
    served, wrappers = induce(parsed)
    wrappers = materialise(wrappers, "wrappers")
    # Only where something is template does the text change, and is the page read again.
    acting = wrappers.filter(F.size("template") > 0)
    key = ["host", "fine", "coarse"]
    changed = materialise(served.join(acting.select("host", "layout"), ["host", "layout"]), "acting")
    settled = parsed.join(changed.select(*key), key, "left_anti").select(
        "page_id", "url", F.col("plain").alias("text"), F.length("plain").cast("long").alias("n_chars")
    )
    of_hosts = rows.join(changed.select("host").distinct(), "host", "left_semi")
    again = _parsed(of_hosts).join(changed, key).withColumnRenamed("html", "source")
    return settled.unionByName(_dealt(again, acting).mapInArrow(read, ROW))
