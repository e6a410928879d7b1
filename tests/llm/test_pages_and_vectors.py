import hashlib
import random
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunedata.llm import render, topk, warc

PAGES = "page_id long, url string, html string, digest string, file string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "f", 3) for r in rows], PAGES)


def test_archive(spark):
    long = "é" * 80
    rows = [(5, "u", long), (3, "u", long), (9, "v\r\nX: y", long), (1, None, None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"),
            (None, "u", long), (3, "u", long), (7, "u", "<p>\r\n\r\n" + "y" * 300_000), (8, "u", "x" * 99), (10, "u", "x" * 99)]
    index, folder = warc.archive(pages(spark, rows))
    assert index.count() == len(rows)
    got = sorted((tuple(r) for r in warc.read_records(index, folder).collect()), key=repr)
    want = []
    for page_id, url, html in rows:
        body = html or ""
        revisit = html == long and page_id not in (3, None)
        want.append((page_id, (url or "about:blank").replace("\r\n", ""), "revisit" if revisit else "response", 3 if revisit else None, len(body.encode()),
                     hashlib.sha256(body.encode()).hexdigest(), None if revisit else body))
    assert got == sorted(want, key=repr)
    some = warc.read_records(index.filter("page_id in (7, 2)"), folder).collect()
    assert sorted(len(r["payload"]) for r in some) == [0, 300_007]
    index, folder = warc.archive(pages(spark, []))
    assert warc.read_records(index, folder).count() == 0


def test_large_page_ids_beside_null(spark):
    first, second, long = 2 ** 60 + 1, 2 ** 60 + 3, "x" * 200
    rows = [(first, "u", long), (second, "u", long), (None, "u", "y" * 200), (2 ** 62 + 1, "u", "z")]
    index, folder = warc.archive(pages(spark, rows).coalesce(1))
    want = [(None, None), (first, None), (2 ** 62 + 1, None), (second, first)]
    for found in (index, warc.read_records(index, folder)):
        assert sorted(((r["page_id"], r["refers_to"]) for r in found.collect()), key=repr) == sorted(want, key=repr)


def test_reads_are_coalesced():
    reads = warc.coalesced([(0, 10), (10, 5), (20, 5), (100, 5), (105, 500)], gap=8, most=200)
    assert [(b, e, n) for b, e, n in reads] == [(0, 25, [0, 1, 2]), (100, 105, [3]), (105, 605, [4])]


@pytest.mark.parametrize("html,text", [
    ("<p>one<p>two <b>bold</b><br>x", "one\n\ntwo bold\nx"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>q<li value=7>r</ol>", "* a\n* b\n  * c\n\n3. q\n7. r"),
    ("<table><tr><th>Name<th>Qty<tr><td>apple<td>12</table>", "Name   Qty\napple  12"),
    ("<table><td>a<td>日本<tr><td>longer<td>x</table>", "a       日本\nlonger  x"),
    ("<head><title>T</title><style>p{}</style>seen", "seen"),
    ("a<div hidden>no</div><i style='display:none'>no</i><script>if (a<b) '</p>'</script>b", "ab"),
    ("<pre> a\n  b</pre>", " a\n  b"),
    ("1 < 2 &lt;b&gt; &amp; &eacute;<!-- c --><!-- open", "1 < 2 <b> & é"),
    ("<p title='>'>in</p><a b=\"", "in"),
    ("<blockquote>q<p>r</blockquote>s", "    q\n\n    r\n\ns"),
    ("</p></div>x</table>", "x"), ("", ""), ("plain\n text", "plain text"), ("<img alt='pic'> <input type=hidden value=1>", "pic"),
])
def test_render(html, text):
    assert render.visible_text(html) == text


@pytest.mark.parametrize("html,text", [
    ("<table><tr><td rowspan=2>A<td>B<tr><td>C</table>", "A  B\n   C"),
    ("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>", "A  B\n   C\n   D"),
    ("<table><tr><td colspan=2 rowspan=2>A<td>B<tr><td>C<tr><td>x<td>y<td>z</table>", "A     B\n      C\nx  y  z"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span><ul><li>no</ul></div>", "yes"),
    ("<tr><div style='Visibility: Collapse'>no</div>", ""),
    ("<select><option>a<option selected>b</select>", "b"), ("<select><option disabled>a<option>b<option>c</select>", "b"),
    ("<select multiple><optgroup label=g><option>c<option>d</select>", "c d"),
    ("<input type=search value=q><input type=email value=e><input type=password value=p><input value=v><input type=checkbox value=1>", "q e v"),
    ("<svg><title>no</title><path d='1'/><text>see</text></svg>", "see"), ("<math><mi>x</mi><annotation>no</annotation></math>", "x"),
])
def test_what_shows(html, text):
    assert render.visible_text(html) == text


def test_any_depth(spark):
    deep = {
        "<table>" * 100_000 + "x": "x", "<table><tr><td>" * 30_000 + "x": "x", "<div>" * 100_000 + "<div hidden>SECRET</div>y": "y",
        "<div>" * 450 + "<div hidden>SECRET</div>": "", "<p><table><td>" + "<div>" * 50_000 + "z": "z", "<b><i>" * 50_000 + "w" + "</b>" * 50_000: "w",
        "<blockquote>" * 50_000 + "q": " " * 100 + "q",
    }
    rows = pages(spark, [(i, "u", html) for i, html in enumerate(deep)])
    got = {r["page_id"]: r["visible_text"] for r in render.with_visible_text(rows).collect()}
    assert [got[i] for i in range(len(deep))] == list(deep.values())


class Plain(HTMLParser):
    """Another reading of a page: its words in order, by the standard library's parser."""

    def __init__(self):
        super().__init__()
        self.parts, self.unseen = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("head", "script", "style", "title"):
            self.unseen += 1
        elif tag not in ("a", "b", "i", "em", "span"):
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in ("head", "script", "style", "title"):
            self.unseen -= 1
        elif tag not in ("a", "b", "i", "em", "span"):
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.unseen:
            self.parts.append(data)


def test_all_pages_against_another_reading(spark, sf_dir):
    from tunedata.llm.queries import QUERIES

    given = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op9_visible_text"](spark, sf_dir).collect()
    assert len(found) == len(given)
    for row in found:
        plain = Plain()
        plain.feed(given[row["page_id"]] or "")
        lines = [line.strip() for line in row["visible_text"].split("\n")]
        words = " ".join(line[2:] if line.startswith("* ") else line for line in lines).split()
        assert words == "".join(plain.parts).split()


def test_broken_markup_ends():
    for html in ("<div>" * 50_000 + "x", "<" * 100_000, "<a \"" * 50_000, "<!--" * 50_000, "<p><b>" * 20_000, "<table><tr><td>" * 3000, "<a b='" * 30_000):
        render.visible_text(html)


def test_render_rows(spark):
    rows = pages(spark, [(1, "u", None), (1, "u", "<b>x</b>"), (1, "u", "<b>x</b>"), (None, None, "")])
    out = render.with_visible_text(rows, into="digest")
    assert out.columns == rows.columns and [r["digest"] for r in out.collect()] == [None, "x", "x", ""]
    assert render.with_visible_text(pages(spark, [])).count() == 0


def top(rows, queries, k):
    """By brute force; rows: (id, vector)."""
    size = max((len(v) for _, v in rows), default=0)
    pad = lambda v: np.array(list(v) + [0] * (size - len(v)), dtype=np.int64)
    out, seen = [], set()
    for q, v in queries:
        if q in seen:
            continue
        seen.add(q)
        scores = sorted((-int(pad(v) @ pad(w)), i) for i, w in rows if i != q)[:k]
        out += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("ring,block,n", [(512, 4096, 300), (8, 16, 400)])
def test_top_k(spark, monkeypatch, ring, block, n):
    monkeypatch.setattr(topk, "RING_ROWS", ring)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = random.Random(6)
    centres = [[rng.randint(-500, 500) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.randint(-30, 30) for c in rng.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, []), (2001, [5]), (2002, [900] * 6), (7, rows[7][1]), (2000, [1, 2])]
    usable = spark.createDataFrame(rows + [(None, [1, 2]), (3000, None)], "id long, vector array<long>")
    got = topk.top_k(usable, usable.filter("id % 10 = 0"), 7)
    asked = {q: v for q, v in rows if q % 10 == 0}
    two = [q for q, _ in rows if q == 2000]
    want = top(rows, [(q, v) for q, v in asked.items() if q != 2000], 7)
    assert sorted(tuple(r) for r in got.filter("query_id != 2000").collect()) == want
    assert len(two) == 2 and got.filter("query_id = 2000").count() == 7


@pytest.mark.parametrize("most", [2**20, 2**28, 2**30])
def test_large_components(spark, monkeypatch, most):
    """Sums far above 2^53 are exact, whatever the annuli exclude."""
    monkeypatch.setattr(topk, "RING_ROWS", 6)
    rng = random.Random(most)
    centres = [[rng.randint(-most, most) for _ in range(5)] for _ in range(4)]
    rows = [(i, [c + rng.randint(-9, 9) for c in rng.choice(centres)]) for i in range(150)]
    rows += [(900, [most] * 5), (901, [-most] * 5), (902, [1, 0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "id long, vector array<long>")

    def score(v, w):
        return sum(a * b for a, b in zip(v, w))

    got = sorted(map(tuple, topk.top_k(df, df.filter("id % 50 = 0 or id = 901"), 7, pivots=9).collect()))
    want = []
    for q, v in rows:
        if q % 50 == 0 or q == 901:
            scores = sorted((-score(v, w), i) for i, w in rows if i != q)[:7]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_products():
    rng = random.Random(0)
    for bits in (3, 24, 26, 31, 40):
        q, x = ([[rng.randint(-2**bits, 2**bits) for _ in range(n)] for _ in range(9)] for n in (7, 7))
        if bits < 31:
            assert topk.products(np.array(q), np.array(x)).tolist() == [[sum(a * b for a, b in zip(v, w)) for w in x] for v in q]
    q, x = np.array([[2**40, 3]]), np.array([[2**10, -5], [1, 2**61]])
    assert topk.products(q, x)[0, 0] == 2**50 - 15
    with pytest.raises(OverflowError):
        topk.products(np.array([[2**40]]), np.array([[2**30]]))
    assert topk.products(np.array([[2**62, 2**62]]), np.array([[1, -1]]))[0, 0] == 0


def test_few_vectors(spark):
    few = spark.createDataFrame([(0, [1, 2]), (100, [3, 4])], "id long, vector array<long>")
    assert sorted(map(tuple, topk.top_k(few, few, 10).collect())) == [(0, 1, 100, 11), (100, 1, 0, 11)]
    assert topk.top_k(few.limit(0), few.limit(0), 3).count() == 0
    assert topk.top_k(few, few.limit(0), 3).count() == 0


def test_whole_vectors(spark):
    given = spark.createDataFrame([(1, [0.5, -0.0001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.whole_vectors(given, "vec_id", "embedding").collect())) == [(1, [512, -1]), (6, [])]
    assert given.select(F.count("*")).first()[0] == 6
