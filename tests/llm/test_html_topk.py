"""Main text of pages, and exact top-k against all products."""

import random

import numpy as np
from pyspark.sql import functions as F

from corpusloom.llm.html_text import main_text
from corpusloom.llm.nra_topk import Lists, exact_top_k

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<nav><ul><li><a href="/">Home</a></li></ul></nav><header><h1>Site</h1></header><!-- ad --><div class="cookie-notice">We use cookies, yes.</div>
%s<aside>See also, and more, and more.</aside><div id="comments"><p>First, great, comment, by a reader.</p></div><form>Name</form><footer>&copy; x</footer></body></html>"""


def test_articles():
    body = "<article><h1>Head&eacute;</h1><p>One,\n  two <b>th</b>ree.<br>Four<p>Fi<i>ve &amp; &lt;six&gt;</article>"
    assert main_text(PAGE % body) == "Headé One, two three. Four Five & <six>"
    div = "<div class='post-content'><p>" + "Long text, with commas, and so on. " * 8 + "</p><div class='ad'>Buy now</div><p>Second part, short.</p></div>"
    assert main_text(PAGE % div) == ("Long text, with commas, and so on. " * 8).strip() + " Second part, short."
    table = "<main><table><tr><td>a, b</td><td>c</td></tr></table><ul><li>one<li>two</ul></main>"
    assert main_text(PAGE % table) == "a, b c one two"


def test_broken_and_empty_pages():
    assert [main_text(x) for x in (None, "", "  ", "<html></html>", "<nav>x</nav>")] == [""] * 5
    assert main_text("<p>a<p>b") == "a b" and main_text("bare text") == "bare text"
    assert main_text("<article><p>cut &am") == "cut &am"
    assert main_text("<div>" * 5000 + "deep, text" + "</div>" * 100) == "deep, text"
    assert len(main_text("<article><p>" + "word, " * 100_000)) == 599_999


def brute(rows, k=20):
    import math

    vectors = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in vectors:
        if q % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=True)), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [round(rng.gauss(0, 0.3), 1) for _ in range(8)]) for i in range(300)]  # coarse values: many ties
    rows += [(300, None), (320, []), (340, [None] * 8), (360, [float("nan")] * 8), (380, [float("inf")] * 8), (None, [0.1] * 8), (400, [0.0] * 8), (420, [0.5, 0.5])]
    rows += [rows[40], rows[41]]
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>").withColumn("rank", F.lit("x"))
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for block, query_block in ((4096, 512), (37, 5)):
        got = exact_top_k(df, F.col("id") % 20 == 0, block=block, query_block=query_block).collect()
        assert {tuple(r) for r in got} == brute(exact) and len(got) == len(brute(exact))
    assert exact_top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def plain(ids, values, query, query_id, k):
    return sorted((-int(v @ query), i) for i, v in zip(ids.tolist(), values, strict=True) if i != query_id)[:k]


def test_reading_stops_when_no_outsider_can_qualify():
    rng = np.random.default_rng(2)
    ids = np.arange(2000)
    # A few candidates are at the good end of all lists: their lists need not be read far.
    values = rng.integers(-20, 20, (2000, 8))
    values[100:110] = 100 + np.arange(10)[:, None]
    lists = Lists(ids, values)
    query = rng.integers(1, 9, 8)
    found, scores, read = lists.top(query[None], np.array([-1]), 10)[0]
    assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == plain(ids, values, query, -1, 10)
    assert read.known == read.resolved == 16 < len(ids)
    # Where scores lie close together, lists are read on, to the end at last.
    values = rng.integers(-20, 20, (2000, 8))
    reads = []
    for _ in range(20):
        query = rng.integers(-9, 9, 8)
        found, scores, read = Lists(ids, values).top(query[None], np.array([7]), 10)[0]
        assert [(-s, i) for s, i in zip(scores.tolist(), found.tolist())] == plain(ids, values, query, 7, 10)
        reads.append(read)
    assert all(r.known <= r.resolved for r in reads) and max(r.resolved for r in reads) == 2000


def test_few_candidates_and_great_components(spark):
    ids, values = np.array([5, 3, 9]), np.array([[1, 2], [1, 2], [0, 0]])
    lists = Lists(ids, values)
    assert [x.tolist() for x in lists.top(np.array([[1, 1]]), np.array([9]), 20)[0][:2]] == [[3, 5], [3, 3]]
    assert [x.tolist() for x in lists.top(np.array([[0, 0]]), np.array([3]), 1)[0][:2]] == [[5], [0]]
    assert lists.top(np.array([[1, 1]]), np.array([9]), 0)[0][0].tolist() == [] and Lists(ids[:1], values[:1]).top(values[:1], ids[:1], 20)[0][0].tolist() == []
    import pytest

    with pytest.raises(ValueError, match="2\\*\\*53"):
        Lists(np.array([1]), np.array([[1 << 40, 0]])).top(np.array([[1 << 30, 0]]), np.array([2]), 1)
    huge = spark.createDataFrame([(20, [1e300, 1.0]), (1, [1e300, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="components too large"):
        exact_top_k(huge, F.col("id") % 20 == 0).collect()


def test_names_and_forms_drop_no_article_text():
    body = '<article><p>See <a class="related">the related work</a> of A, B.</p><p class="notice-board">Board.</p><div class="share-price">Price 4.</div><div class="ad-slot">Buy</div><div id="postComments">Me too</div></article>'
    assert main_text(body) == "See the related work of A, B. Board. Price 4."
    form = "<form><div class='nav'>menu</div><article><p>Text, in a form.</p><input><select><option>x</select><button>Go</button></article></form>"
    assert main_text(form) == "Text, in a form."
    assert main_text("<div><p>" + "Long text, of a page. " * 20 + "</p><form><p>Your name, please</p><textarea>x</textarea></form></div>") == ("Long text, of a page. " * 20).strip()


def test_pages_put_together_from_known_blocks():
    """The text that a page was made from, against what is found in it."""
    import html

    rng = random.Random(21)
    kinds = [("<p>", "</p>"), ("<p>", ""), ("<div>", "</div>"), ("<h2>", "</h2>"), ("<blockquote>", "</blockquote>"), ("<ul><li>", "</ul>"), ("<table><tr><td>", "</table>")]
    junk = ['<nav><a href="/">Home, and more</a></nav>', '<div class="cookie-notice"><p>We, too, use cookies.</p></div>', "<script>if (a < b) document.write('<p>x</p>')</script>", '<aside><p>Most read, today, here.</p></aside>', '<div class="ad-banner">Buy, now</div>', "<!-- <p>not this</p> -->", '<section id="comments"><p>First, as ever, says a reader.</p></section>']
    words = ["one", "two,", "thrée", "a < b", "R&D", "“so”", "五，六"]
    for _ in range(300):
        blocks, page = [], []
        for _ in range(rng.randrange(3, 9)):
            picked = rng.choices(words, k=rng.randrange(8, 40))
            start, end = rng.choice(kinds)
            inner = [f"<{t}>{html.escape(w)}</{t}>" if (t := rng.choice(["", "", "", "b", "em", "span"])) else html.escape(w) for w in picked]
            page.append(start + rng.choice([" ", "\n\t", "  "]).join(inner) + end)
            blocks.append(" ".join(picked))
            if rng.random() < 0.3:
                page.append(rng.choice(junk))
        tag = rng.choice(["article", "main"])
        assert main_text(PAGE % (f"<{tag}>" + "\n".join(page) + f"</{tag}>")) == " ".join(blocks)


def test_long_pages_take_time_in_proportion():
    import time

    for page in ("<p>text, here</p>" + "<span></b>" * 20_000, "<b><article>" + "<span></b>" * 20_000 + "x", "<div><header>x</header>" * 20_000 + "text", "<form>" * 20_000 + "<p>" + "word " * 100):
        begun = time.time()
        main_text(page)
        assert time.time() - begun < 10


def test_pages_of_a_table(spark):
    from corpusloom.llm.op8 import extract

    big = 9007199254740993
    rows = [(big, "u", "<p>a</p>", 1), (None, None, None, 2), (big, "u", "<p>a</p>", 1), (4, "v", "", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text long").coalesce(1)
    assert [tuple(r) for r in extract(pages).collect()] == [(big, "u", "a", 1), (None, None, "", 0), (big, "u", "a", 1), (4, "v", "", 0)]
    assert extract(pages.limit(0)).count() == 0
