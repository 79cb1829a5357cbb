import html
import re

import pytest

from tidepool.llm import html_template as h
from tidepool.llm import queries


def plain(source):
    """For pages of the test tables, whose main text is in one article of flat blocks."""
    inner = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", source or "", re.S)
    blocks = re.split(r"</?(?:p|h1|br)>", inner[1]) if inner else []
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>?", "", b)).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def test_query_against_plain(spark, sf):
    source = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op2_html(spark, sf).collect()
    assert len(rows) == len(source)
    for r in rows:
        assert r.text == plain(source[r.page_id])
        assert r.n_chars == len(r.text)


def page(body, extra=""):
    return f"<html><head><title>t</title></head><body>{body}{extra}</body></html>"


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_template_without_semantic_elements(spark, monkeypatch, limit):
    monkeypatch.setattr(h, "BROADCAST_TOKENS", limit)
    story = [f"Story {i} tells at some length of {i * 7} things that happened nowhere else in the world." for i in range(6)]
    rows = [(i, f"http://a.example/{i}", page(f"<div id=top>Daily Paper of Somewhere</div><div class=x1><p>{s}<p>More of {s}</div><div class=x2>Call our office for a price</div>")) for i, s in enumerate(story)]
    rows.append((9, "http://b.example/1", page("<p>Alone &amp; well</p>")))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in h.extract(df).collect()}
    assert got == {**{i: f"{s}\nMore of {s}" for i, s in enumerate(story)}, 9: "Alone & well"}


def test_regions_and_references(spark):
    body = """<header>Site</header><nav><a href=/>Home</a></nav><main><article><header><h1>Title &eacute; &#8212; x</h1></header>
    <div class="ad-box">Buy</div><p>One <b>bold</b> and <a href="/z?a>b">link</a>,&nbsp;two
    spaces<ul><li>First<li>Second</ul><script>if (a < b) "</p>"</script><form>Name <input></form>
    <section class=comments><article class=comment>Nice!</article></section></article></main>
    <aside>Side</aside><div role=alert>Notice</div><footer>&copy; us</footer>"""
    df = spark.createDataFrame([(1, "http://c.example/", page(body), 5)], "page_id long, url string, html string, text int")
    assert h.extract(df).first().text == "Title é — x\nOne bold and link, two spaces\nFirst\nSecond"


def test_odd_rows(spark):
    long = page("<article>" + "<p>para</p>" * 50_000 + "</article>")
    rows = [(1, None, None), (2, "http://[bad", ""), (None, "x", "<p>cut &amp"), (3, "u", "<" * 2000), (4, "u", long), (4, "u", long), (5, "u", "<div>" * 3000 + "deep"), (6, "u", '<a title="unclosed>text')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = h.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.id: r.text for r in got}
    assert text[1] == text[2] == "" and text[None] == "cut &" and text[5] == "deep"
    assert text[4].count("\n") == 49_999
    assert h.extract(df.limit(0)).count() == 0


def test_equal_vectors_form_a_template(spark):
    rows = [(f"http://t.example/{i}", page(f"<div class=a><p>Always here</p></div><div class=b><p>Page {i} only</p></div>")) for i in range(5)]
    (r,) = h.templates(spark.createDataFrame(rows, "url string, html string")).collect()
    roles = dict(zip(r.tokens, r["values"], strict=True))
    p = h.Page(rows[0][1])
    assert roles == {h.block_token(p.token[p.blocks[0][0]], "Always here"): 2, p.token[p.parent[p.blocks[1][0]]]: 3}


def test_classes_against_vectors(spark):
    """Sums tell the same vectors apart as vectors held whole."""
    rows = [("http://v.example/", page("".join(f"<div class=c{j}><p>{j}</p></div>" * (1 + (i * j) % 3) for j in range(1 + i % 4, 7)), f"<p>{i}</p>")) for i in range(12)]
    (r,) = h.classes_of(spark.createDataFrame(rows, "url string, html string")).collect()
    counts = [h.Page(s).tokens() for _, s in rows]
    vectors = {t: tuple(c[t] for c in counts) for t in set().union(*counts)}
    vectors = {t: v for t, v in vectors.items() if sum(map(bool, v)) >= max(h.LEAST_PAGES, h.SUPPORT * len(rows))}
    assert dict(zip(r.tokens, zip(r.pages, r.total, strict=True), strict=True)) == {t: (sum(map(bool, v)), sum(v)) for t, v in vectors.items()}
    classes = dict(zip(r.tokens, r["values"], strict=True))
    assert all((vectors[a] == vectors[b]) == (classes[a] == classes[b]) for a in vectors for b in vectors)


def test_order_and_nesting():
    order, crossed = h.spans_of([(1, 1, 7, 10), (2, 2, 7, 11), (3, 3, 7, 10), (4, 4, 7, 11)])
    assert order[7] >= 0 and not crossed
    order, _ = h.spans_of([(1, 1, 7, 10), (2, 2, 7, 11), (3, 3, 7, 11), (4, 4, 7, 10)])
    assert order[7] == -1
    _, crossed = h.spans_of([(1, 1, 7, 10), (2, 2, 8, 20), (3, 3, 7, 11), (4, 4, 7, 12), (5, 5, 8, 21)])
    assert crossed == {8}
    _, crossed = h.spans_of([(1, 9, 7, 10), (2, 4, 8, 20), (5, 6, 8, 21)])
    assert not crossed
    # Tokens that change places on one page of the host are no class.
    bodies = ["<div class=a>A</div><div class=b>B</div>"] * 4 + ["<div class=b>B</div><div class=a>A</div>"]
    pages = [h.Page(page(b)) for b in bodies]
    classes = {t: 1 for t in pages[0].tokens()}
    assert len({p.layout(classes)[p.token[-1]][0] for p in pages}) == 2


def test_template_against_misleading_names(spark):
    """No semantic element, and class names that say the contrary: content decides."""
    story = lambda i: f"<p>Report {i} says at length what nobody else has said about {i * 31} of them.<p>It goes on, {i} times, and ends well for all {i * 17}."
    rows = [
        (i, f"http://w.example/{i}", page(f"<div class=main>Offer {i} of the day</div><div class=article><a href=/1>One</a> <a href=/2>Two</a></div><div class=z9><div class=q>{story(i)}</div></div><div class=content>Set on day {i}</div>"))
        for i in range(8)
    ]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.by_template for r in got)
    assert {r.id: r.text for r in got} == {i: f"Report {i} says at length what nobody else has said about {i * 31} of them.\nIt goes on, {i} times, and ends well for all {i * 17}." for i in range(8)}


def test_names_of_a_single_page_keep_its_text(spark):
    body = '<article><p>One</p><div class="related work"><p>Two</p></div><section id="notice-of-1850"><p>Three</p></section><div class="ad">Buy</div></article>'
    lone = "<p><a href=/>A linked headline line</a></p><p>Text</p><ul><li><a>A</a><li><a>B</a><li><a>C</a></ul>"
    deep = "<div>" * 520 + "<script>var x=1;</script><nav>MENU</nav><p>Body"
    rows = [(1, "http://1.example/", page(body)), (2, "http://2.example/", page(lone)), (3, "http://3.example/", page(deep))]
    got = {r.id: r.text for r in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "One\nTwo\nThree", 2: "A linked headline line\nText", 3: "Body"}


def test_hot_host_is_dealt(spark):
    rows = [(i, f"http://h.example/{i}", page(f"<div class=x><p>Words of page {i} and more of {i * 3}</p></div><div>Foot</div>")) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, url string, html string").select("url", "html", "id")
    found = h.templates(df.select("url", "html")).checkpoint()

    def work(batches):
        for b, _, known in batches:
            yield h.pa.RecordBatch.from_arrays([b.column(2), h.pa.array([h.Page(s).text(t)[0] for s, t in zip(b.column(1).to_pylist(), known, strict=True)])], ["id", "text"])

    a, b = (sorted(map(tuple, h.templated(df, found, work, "id long, text string", limit, 7).collect())) for limit in (1 << 20, 0))
    assert a == b == [(i, f"Words of page {i} and more of {i * 3}") for i in range(40)]


def test_copies_of_a_page_are_no_template(spark):
    mirror = page("<div class=a><h1>Title</h1><p>One story that three addresses have</p></div>")
    rows = [(i, f"http://m.example/{i}", mirror) for i in range(3)]
    story = [page(f"<div id=top>Daily Paper</div><div class=x><p>Story {i} tells of {i * 7} things</p></div>") for i in range(3)]
    rows += [(10 + i, f"http://n.example/{i}", story[min(i, 2)]) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in h.extract(df).collect()}
    assert [got[i] for i in range(3)] == ["Title\nOne story that three addresses have"] * 3
    assert [got[10 + i] for i in range(9)] == [f"Story {min(i, 2)} tells of {min(i, 2) * 7} things" for i in range(9)]
