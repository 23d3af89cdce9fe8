import base64
import hashlib
import json
import html
import random
import time

import pytest
import re

from spanwise.llm import warc, wrapper
from spanwise.llm.dom import Node, _finish, align, nodes, parse
from spanwise.llm.queries import QUERIES
from spanwise.llm.wrapper import packed, unpacked

SMALL = "/root/testdata/sf0.001"
COLUMNS = "page_id long, url string, html string, host string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], COLUMNS)


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in wrapper.extract(pages(spark, rows)).collect()}


def test_articles_of_the_given_pages(spark):
    found = {r["page_id"]: r for r in QUERIES["op2_wrapper"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        body = r["html"].split("<article>")[1].split("</article>")[0]
        body = re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|h1)>", "\0", body.replace("<br>", " ")))
        lines = (" ".join(html.unescape(x).split()) for x in body.split("\0"))
        text = "\n".join(x for x in lines if x)
        assert (found[r["page_id"]]["text"], found[r["page_id"]]["n_chars"]) == (text, len(text))


def test_what_stands_around_an_article_is_left_out(spark):
    page = """<body><header>Site</header><div class="cookie-notice">We use</div><aside>Side</aside><main><article>
      <header><h2>Title &amp; more</h2></header><p>First&nbsp;&#8211; line<br>goes  on<p>Second <b>bo</b>ld</p>
      <ul><li>one<li>two</ul><div class=ad>Buy</div><form><input>Send</form><script>x < "</p>"</script><!-- <p>no</p> -->
      <section id="comments"><p>Nice!</p></section><p hidden>gone</p><p style="display:none">gone</p>5 &lt; 6</article></main>
      <footer>Foot</footer>"""
    expected = "Title & more\nFirst – line goes on\nSecond bold\none\ntwo\n5 < 6"
    odd = [(2, "http://a.org/2", None), (3, None, ""), (4, "::bad", "no markup &amp; such"), (4, "::bad", "no markup &amp; such"), (None, "http://a.org/5", "<p>x"), (6, "http://a.org/6", "<p a='unclosed <p>y")]
    found = wrapper.extract(pages(spark, [(1, "http://a.org/1", page), *odd])).collect()
    by_id = {r["page_id"]: r["text"] for r in found}
    assert len(found) == 7 and by_id[1] == expected
    assert by_id[2] == by_id[3] == "" and by_id[4] == "no markup & such" and by_id[None] == "x"
    assert wrapper.extract(pages(spark, [(1, "u", "x")]).limit(0)).collect() == []


def test_constant_nodes_of_a_host_are_template(spark):
    rng = random.Random(1)
    rows, wanted = [], {}
    for i in range(12):
        own = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(rng.randint(1, 4))]
        body = "".join(f"<p>{p}</p>" for p in own)
        rows.append((i, f"https://Host.example:80/{i}", f"<div><p>All rights reserved</p></div><div>{body}</div><div><span>Back to top</span></div>"))
        wanted[i] = "\n".join(own)
    # A host with the same page over and over says nothing about what is template.
    rows += [(100 + i, f"https://other.example/{i}", "<div><p>Same text</p></div><div><p>again</p></div>") for i in range(9)]
    wanted |= {100 + i: "Same text\nagain" for i in range(9)}
    assert texts(spark, rows) == wanted


def test_constant_text_in_articles_is_template(spark):
    rng = random.Random(2)
    rows, wanted = [], {}
    for i in range(12):
        own = [" ".join(rng.choices("abcdefghij", k=12)) for _ in range(rng.randint(2, 6))]
        # A line that some documents share is no template, wherever it stands.
        own += ["Shared by some"] * (i % 3 == 0)
        # The notice is wherever the paragraphs end, and one page has none.
        notice = "" if i == 7 else "<p>Read our <i>notice</i></p>"
        body = f"<p>Advert</p>{''.join(f'<p>{p}</p>' for p in own)}{notice}"
        rows.append((i, f"https://host.example/{i}", f"<body><article><p>Teaser</p></article><article>{body}</article></body>"))
        wanted[i] = "\n".join(own)
    assert texts(spark, rows) == wanted


def test_boilerplate_may_outweigh_the_text(spark):
    long = " ".join(["All rights reserved"] * 40)
    page = "<div><p>{0}</p></div><div><p>Only {1}</p></div><div><p>{0}</p></div>"
    rows = [(i, f"https://host.example/{i}", page.format(long, i)) for i in range(9)]
    assert texts(spark, rows) == {i: f"Only {i}" for i in range(9)}


def test_each_layout_has_a_wrapper(spark):
    rows, wanted = [], {}
    kinds = ["<div><p>Top</p></div><div><p>{0}</p></div><div>Foot</div>", "<section><div>{0}</div></section><div><b>Left</b></div>", "<table><tr><td>Bar<td>{0}</table>"]
    for i in range(30):
        rows.append((i, f"https://host.example/{i}", kinds[i % 3].format(f"Only {i}")))
        wanted[i] = f"Only {i}"
    # Empty pages.
    rows += [(100 + i, f"https://host.example/{100 + i}", [None, "", " <p> </p>"][i % 3]) for i in range(60)]
    wanted |= {100 + i: "" for i in range(60)}
    # Copies of one page, of either layout, are one page.
    rows += [(200 + i, f"https://copies.example/{i}", kinds[i % 2].format("Again and again")) for i in range(20)]
    wanted |= {200 + i: ["Top\nAgain and again\nFoot", "Again and again\nLeft"][i % 2] for i in range(20)}
    assert texts(spark, rows) == wanted


def test_packed_trees():
    page = parse("<body id='a b'>x<div class=c><p>one<p>two</div><x-y.z>y")
    again = unpacked(packed(page))
    assert [(n.key, n.text, n.number) for n in nodes(page)] == [(n.key, n.text, n.number) for n in nodes(again)]
    assert align(page, again) == {n.number: n.number for n in nodes(page)}


def tree(rng, depth):
    node = Node(rng.choice("ab"))
    for _ in range(rng.randint(0, 3) if depth else 0):
        child = tree(rng, depth - 1)
        node.kids.append(child)
        node.parts.append(child)
    return node


def matched(a, b):
    """The size of a largest match, straight from the definition."""
    if a.key != b.key:
        return 0
    table = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
    for i, x in enumerate(a.kids, 1):
        for j, y in enumerate(b.kids, 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + matched(x, y))
    return 1 + table[-1][-1]


def test_alignment_is_largest():
    rng = random.Random(6)
    for _ in range(300):
        a, b = tree(rng, 4), tree(rng, 4)
        _finish(a)
        _finish(b)
        pairs = align(a, b)
        assert len(pairs) == matched(a, b) == len(set(pairs.values()))
    same = parse("<ul><li>a<li>b</ul>")
    assert align(same, parse("<ul><li>x<li>y</ul>")) == {i: i for i in range(4)}


def test_archives_of_the_given_pages(spark):
    found = {r["page_id"]: tuple(r)[1:] for r in QUERIES["op6_warc"](spark, SMALL).collect()}
    rows = spark.read.parquet(f"{SMALL}/pages.parquet").collect()
    assert len(found) == len(rows)
    for r in rows:
        body = r["html"].encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert found[r["page_id"]] == (len(body), digest, "response", None)


def test_records_come_back_and_copies_are_revisits(spark):
    rows = [(1, "http://a/1", "<p>é"), (2, "http://a/2", "<p>é"), (3, "http://a/3\r\nX: y%", ""), (4, None, None), (5, "u", "z" * 100_000), (9, "http://a/9", "<p>é"), (9, "http://a/9b", "<p>é"), (None, "n", "<p>é")]
    folder = warc.archive_folder(spark)
    warc.write(pages(spark, rows), folder)
    read = warc.read(spark, folder, payload=True)
    found = sorted(((r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], None if r["payload"] is None else bytes(r["payload"])) for r in read.collect()), key=repr)
    e = "<p>é".encode()
    assert found == sorted([
        (0, "n", "response", None, 5, e), (1, "http://a/1", "revisit", 9, 5, None), (2, "http://a/2", "revisit", 9, 5, None),
        (3, "http://a/3\r\nX: y%", "revisit", 4, 0, None), (4, None, "response", None, 0, b""), (5, "u", "response", None, 100_000, b"z" * 100_000),
        (9, "http://a/9", "response", None, 5, e), (9, "http://a/9b", "response", None, 5, e),
    ], key=repr)
    assert read.filter("record_type = 'revisit' AND page_id IN (2, 3, 5)").select("page_id").count() == 2
    plan = read.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (record_type" not in plan
    folder = warc.archive_folder(spark)
    warc.write(pages(spark, rows), folder, least_bytes=1)
    kept = {r["page_id"]: r["record_type"] for r in warc.read(spark, folder).collect()}
    assert kept[3] == kept[4] == "response" and kept[1] == "revisit"
    folder = warc.archive_folder(spark)
    warc.write(pages(spark, rows).limit(0), folder)
    assert warc.read(spark, folder).collect() == []


def test_digests_are_taken_from_the_payloads(spark):
    rows = [(1, "a", "<p>é"), (2, "b", "<p>é"), (3, None, ""), (4, "d", None), (5, "e", "z" * 100_000), (5, "f", "y"), (None, "g", "y")]
    folder = warc.archive_folder(spark)
    warc.write(pages(spark, rows), folder)
    found = {(r["page_id"], r["url"]): (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.verified(spark, folder).collect()}
    refers = {(1, "a"): 2, (3, None): 4}
    for page_id, url, html in rows:
        body = (html or "").encode()
        kind = "revisit" if (page_id, url) in refers else "response"
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert found[page_id, url] == (len(body), digest, kind, refers.get((page_id, url)))
    assert len(found) == len(rows)


def test_payloads_that_do_not_agree_with_their_headers(spark):
    right = base64.b32encode(hashlib.sha1(b"right").digest()).decode()
    good = warc.record(1, "a", right, None, b"right")
    cases = {
        "payload": [good, warc.record(2, "b", right, None, b"wrong")],
        "revisit of nothing": [good, warc.record(2, "b", right, 7, b"right")],
        "revisit of other bytes": [good, warc.record(2, "b", "A" * 32, 1, b"other")],
    }
    for records in cases.values():
        folder = warc.archive_folder(spark)
        name = warc.put(folder, "part", b"".join(records))
        system, path = warc.place(folder)
        with system.open_output_stream(f"{path}/{warc.LIST}") as out:
            out.write(json.dumps([str(name)]).encode())
        with pytest.raises(Exception, match="does not agree with its headers"):
            warc.verified(spark, folder).collect()


@pytest.mark.parametrize("depth", [700, 20_000])
def test_deep_pages(spark, depth):
    """Pages of any depth are read and aligned."""
    rows = [
        (i, f"http://deep.org/{i}", "<body>" + "<div>" * depth + f"<p>Text number {'abcdefg'[i]} of this host.</p>" + "</div>" * (depth - i))
        for i in range(6)
    ]
    found = texts(spark, rows)
    assert found == {i: f"Text number {'abcdefg'[i]} of this host." for i in range(6)}


def test_long_menus_and_unclosed_elements_take_linear_time():
    begun = time.process_time()
    parse("<div>" * 60_000 + "</span>" * 60_000 + "<p>x" * 60_000 + "<li>y" * 60_000)
    assert time.process_time() - begun < 20


def test_anchors_and_longer_names_stay(spark):
    article = (
        '<article><h2 id="related-work">Related work</h2><p class="no-ad">One.</p><h2 id="search">Search</h2>'
        '<p class="lead">Two.</p><p class="ad">Buy.</p><div class="ad-box">Buy more.</div></article>'
    )
    found = texts(spark, [(1, "http://a.org/1", f"<body><nav>Menu</nav>{article}</body>")])
    assert found == {1: "Related work\nOne.\nSearch\nTwo."}
