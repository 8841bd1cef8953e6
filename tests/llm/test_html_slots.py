"""Main texts against an independent cut of the marked article, and template deduction."""

import html
import re

import pyarrow as pa

from tickloom.llm import html_slots
from tickloom.llm.queries import QUERIES
from tickloom.llm.support import settings, written


def cut(page):
    """The text of the article element, for pages whose articles hold blocks only."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)
    parts = re.split(r"</?(?:h1|p)>", inside[1]) if inside else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
    return "\n".join(t for t in texts if t)


def test_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op4_main_text"](spark, sf_dir).collect()}
    assert len(got) == len(pages)
    for page in pages:
        row = got[page.page_id]
        assert (row.url, row.text, row.n_chars) == (page.url, cut(page.html), len(cut(page.html)))


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body class=home>
<div id="top-menu"><a href="/">Home</a></div><div class="wrap"><div class="story">
<h1>Title {n}</h1><p>First{n}&nbsp;&amp; second
 line {n}<br>more{n} <i>of{n}</i> it{n}<p>Next {n} &lt;b{n}&gt;
<div class="ad">buy</div><ul><li>one{n}<li>two{n}</ul><script>var a = "<p>no</p>";</script></div>
<div class="comments"><p>nice!</p></div></div><footer>foot</footer></body></html>"""
TEXT = "Title {n}\nFirst{n}\xa0& second line {n} more{n} of{n} it{n}\nNext {n} <b{n}>\none{n}\ntwo{n}"


def test_unmarked_article(spark):
    rows = [(n, f"http://h.example/{n}", PAGE.format(n=n)) for n in range(6)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_slots.page_texts(pages).collect()}
    assert got == {n: TEXT.format(n=n) for n in range(6)}


def test_template(spark):
    rows = [(n, "h", f"{n}", PAGE.format(n=n)) for n in range(4)]
    pages = spark.createDataFrame(rows, "n long, host string, key string, html string")
    counts = html_slots.token_counts(pages)
    row = html_slots.templates(counts).first()
    names = {t.place: t.name for t in row.template}
    assert row.pages == 4 and len(row.regions) == 1
    around = {t.name: names.get(t.parent) for t in row.template if t.name in ("body", "h1")}
    assert around == {"body": "html", "h1": "div"}
    numbers = {t.name: t.number for t in row.template}
    assert numbers["html"] == numbers["body"]


def test_edges(spark):
    rows = [
        (1, None, None, "x"),
        (2, "http://a/", "", "x"),
        (3, "http://a/", "plain  text", "x"),
        (3, "http://a/", "plain  text", "x"),
        (4, "bad url", "<nav>menu<article>a<p>b</article>c", "x"),
        (5, "http://b/", "<article>one</article><article>two &am", "x"),
        (6, "http://c/", "<article><header>h</header>x < y <!-- open", "x"),
        (7, "http://d/", "<main><form>f</form><P CLASS='Cookie-Notice'>n</P>m</main>", "x"),
        (8, "http://e/", "<article><script>never closed", "x"),
        (None, "http://f/", "<article>" + "word " * 300_000 + "</article>", "x"),
        (9, "http://g/", "<div>" * 3000 + "deep", "x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(
        ((r.page_id or 0, r.text) for r in html_slots.page_texts(pages).collect()), key=str
    )
    assert got == sorted(
        [
            (1, ""), (2, ""), (3, "plain text"), (3, "plain text"), (4, "a\nb"),
            (5, "one\ntwo &am"), (6, "x < y"), (7, "m"), (8, ""),
            (0, ("word " * 300_000).strip()), (9, "deep"),
        ],
        key=str,
    )
    assert html_slots.page_texts(pages.limit(0)).count() == 0


def test_class_words_spare_what_holds_the_text(spark):
    page = "<body class='no-sidebar'>{}<p>Story {} told as {n}x, word by {n}y.</p>{}</body>"
    side = "<div class='sidebar'>Also read</div>"
    wrap = page.format("<div class='page-with-sidebar'>" + side, "{n}", "</div>", n="{n}")
    story = "Story {n} told as {n}x, word by {n}y."
    cases = {
        "body": (page.format(side, "{n}", "", n="{n}"), story),
        "wrap": (wrap, story),
        "post": ("<article class='post category-social'><p>" + story + "</article>", story),
        "main": ("<main id=has-comments><p>" + story + side + "</main>", story),
        "left": ("<div class=promo>Card<nav>menu</nav></div><footer>foot</footer>", "Card"),
    }
    rows = [
        (f"{name} {n}", f"http://{name}.example/{n}", text.format(n=n))
        for name, (text, _) in cases.items()
        for n in range(4)
    ]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.text for r in html_slots.page_texts(pages).collect()}
    assert got == {
        f"{name} {n}": text.format(n=n) for name, (_, text) in cases.items() for n in range(4)
    }


def test_words_of_the_template(spark):
    def page(n):
        # Every page has its own words, in paragraphs of its own number.
        story = "".join(f"<p>tale {n}x{i} of the day{n}x{i} this ends</p>" for i in range(n % 5 + 2))
        notice = "<p class=hint>Get our mail</p>" if n % 3 else ""
        share = f"<p>Share this on X<br>Filed under <b>topic{n}</b></p>"
        return f"<div class=story><h1>Head{n} of {n}</h1>{story}{share}{notice}</div>"

    def text(n):
        story = [f"tale {n}x{i} of the day{n}x{i} this ends" for i in range(n % 5 + 2)]
        return "\n".join([f"Head{n} of {n}", *story, f"topic{n}"])

    rows = [(n, f"http://h.example/{n}", page(n)) for n in range(40)]
    copy = "<article><p>the same story on every page of this host</article>"
    rows += [(100 + n, f"http://copies.example/{n}", copy) for n in range(20)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_slots.page_texts(pages).collect()}
    assert [got[n] for n in range(40)] == [text(n) for n in range(40)]
    assert all(got[100 + n] == "the same story on every page of this host" for n in range(20))


def own_words(n, size):
    """Words that no other page has, in the order of no other page."""
    return " ".join(f"p{n}w{i}" for i in range(size))


def test_templates_of_plain_divs(spark):
    """No tag or class tells anything here: the occurrence vectors alone show the template."""
    menu = " ".join(f"menu{i}" for i in range(120))

    def heavy(n):
        return f"<div><div>{menu}</div><div>{own_words(n, 30)}</div></div>"

    def small(n):
        return (
            f"<div><div><div>{own_words(n, 40)}{' of the day' * (n % 2)}</div>"
            "<div>Share this article with friends</div></div><div>All rights reserved here</div></div>"
        )

    def notice(n):
        mail = "<div>Get our letter every single week</div>" if n % 4 else ""
        return f"<div><div>{own_words(n, 25 + n)}</div>{mail}<div>{own_words(n + 100, 9)}</div></div>"

    def two(n):
        return f"<div><div>One two three four five six seven</div><div>{own_words(n, 20)} in the end</div></div>"

    hosts = {
        "heavy": (heavy, 30, lambda n: own_words(n, 30)),
        "small": (small, 6, lambda n: f"{own_words(n, 40)}{' of the day' * (n % 2)}"),
        "notice": (notice, 16, lambda n: f"{own_words(n, 25 + n)}\n{own_words(n + 100, 9)}"),
        "two": (two, 2, lambda n: f"{own_words(n, 20)} in the end"),
    }
    rows = [
        (f"{name} {n}", f"http://{name}.example/{n}", f"<div>{page(n)}</div>")
        for name, (page, size, _) in hosts.items()
        for n in range(size)
    ]
    pages = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {r.page_id: r.text for r in html_slots.page_texts(pages).collect()}
    want = {f"{name} {n}": text(n) for name, (_, size, text) in hosts.items() for n in range(size)}
    assert got == want
    # Without the template all of it would be text.
    off = [html_slots.main_text(page, ()) for _, _, page in rows]
    changed = [text != got[row[0]] for text, row in zip(off, rows)]
    assert sum(changed) == len(rows) - 4  # four pages have no notice


def test_equal_pages_keep_their_text(spark):
    rows = [(n, "http://same.example/", "<div><div>the same text on both</div></div>") for n in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_slots.page_texts(pages).collect()} == {"the same text on both"}


def test_runs():
    marks = ["", None, "", "row", None, "row", "row", "row", None, "row", "row"]
    last = [False, True, True, True, False, False, False]
    assert html_slots.in_runs(marks, 1) == [True, False, True, True, *last]
    assert html_slots.in_runs(marks, 2) == [False, False, True, True, *last]
    assert html_slots.in_runs(marks, 3) == [False, False, False, False, *last]


def test_every_page_shows_the_words_to_count(spark, monkeypatch):
    """A word of the template is counted whichever pages have it, however many the host has."""

    def page(n):
        letter = "Get our letter every single week"
        return f"<div><div>{own_words(n, 20)}</div><div>{letter if n % 2 else own_words(n + 200, 6)}</div></div>"

    rows = [("h", str(n), page(n), 130, False) for n in range(130)]
    pages = spark.createDataFrame(rows, "host string, key string, html string, pages long, marked boolean")
    found = html_slots.likely_words(pages).first()["words"]
    assert set(found.values()) == {"Get", "our", "letter", "every", "single", "week"}
    looked_at = spark.sparkContext.accumulator(0)
    likely = html_slots.likely

    def counted(texts, *more):
        looked_at.add(len(texts))
        return likely(texts, *more)

    monkeypatch.setattr(html_slots, "likely", counted)
    html_slots.likely_words(pages).collect()
    assert looked_at.value == len(rows)


def test_pages_of_a_host_share_their_words():
    hosts = ["a", "b", "a", "a", "c"]
    words = pa.array([[(1, "x")], [(2, "y")], [(1, "x")], [(1, "x")], None], html_slots.WORDS)
    found = list(html_slots.words_by_host(hosts, words, {}))
    assert found == [{1: "x"}, {2: "y"}, {1: "x"}, {1: "x"}, {}]
    assert found[0] is found[2] is found[3]
    held = {str(i): {} for i in range(html_slots.HOSTS)}
    assert list(html_slots.words_by_host(["a"], words, held)) == [{1: "x"}]
    assert list(held) == ["a"]


def test_tables_of_hosts_have_few_files(spark, monkeypatch):
    files = {}

    def counted(frame, purpose):
        table = written(frame, purpose)
        files[purpose] = len(table.inputFiles())
        return table

    monkeypatch.setattr(html_slots, "written", counted)
    page = "<body><nav>menu {0}</nav><article><p>text {0} of its own</p></article></body>"
    rows = [(i, f"http://h{i % 40}.org/{i}", page.format(i)) for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    with settings(spark, keys):
        texts = {r.page_id: r.text for r in html_slots.page_texts(pages).collect()}
    assert texts == {i: f"text {i} of its own" for i in range(120)}
    assert files["templates"] == 1 and files["hosts"] == 1 and "words" not in files
