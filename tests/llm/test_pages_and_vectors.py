"""Main text and nearest neighbours."""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pytest
from loamworks.llm import ann, html_extract, queries
from pyspark.sql import functions as F

from ..conftest import same_rows

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1><p>Tagline</p></header>
<div class="cookie-notice"><p>We use cookies to make things better for everyone in the whole wide world.</p></div>
<nav><a href="/">Home</a> <a href="/x">More</a></nav><main><article><header><h1>Title A &amp; B</h1></header>
<p>First   para <a href="x">link</a> text &lt;b&gt; &#233;.<p>Second<br>para<ul><li>one</li><li>two</li></ul><aside>Related stuff</aside>
<form><input><button>Go</button>Sign up now</form><script>var t="</p>";</script><section id="comments"><p>Nice post, thanks for all the fish and chips.</p></section>
<div hidden>secret</div></article></main><div id="sidebar">Links <a href=y>x</a></div><footer>(c)</footer><noscript>js</noscript></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Title A & B\n\nFirst para link text <b> é.\n\nSecond para\n\none\n\ntwo"


def test_pages_without_an_article():
    body = " ".join(["word"] * 60)
    page = f"<body><ul><li><a href=a>One</a><li><a href=b>Two</a></ul><h1>{'Head ' * 9}</h1><p>{body}</p><p>{body}</p><div class=footer>Legal</div>"
    assert html_extract.main_text(page) == "\n\n".join([("Head " * 9).strip(), body, body])


def test_malformed():
    for page in ["", "<", "<p", "a < b", "<p class='x>text", "<!-- open", "<script>x", "</p></div>", "<article><p>x &am &amp y", "<a <b>"]:
        assert isinstance(html_extract.main_text(page), str)
    assert html_extract.main_text("<article><p>x &am &amp y") == "x &am & y"
    assert html_extract.main_text("<article>" + "<div>" * 5000 + "deep") == "deep"


def test_open_elements_end_where_html_says():
    assert html_extract.main_text("<article><p class=notice>Cookies!<p>Real<ul><li class=ad>Buy<li>Item</ul><p class='share'>x</p>End</article><p>Out") == "Real\n\nItem\n\nEnd"
    assert len(html_extract.blocks("<div>" * 20_000 + "</b></i>" * 20_000 + "deep")) == 1


def test_wrappers_of_the_article_are_not_something_else():
    page = "<nav><a href=x>Home</a></nav><article><h1>Title</h1><p>The body of this article.<aside>Ad</aside></article><div>Legal</div>"
    for wrapper in ["<form id=aspnetForm>%s</form>", "<div class='layout has-sidebar'>%s</div>", "<div id=sidebar>%s</div>", "<form><div class=widget>%s</div></form>", "<body style='display:none'>%s"]:
        assert html_extract.main_text(wrapper % page) == "Title\n\nThe body of this article."
    assert html_extract.main_text("<div class=content>Hi</div><form>%s</form>" % page) == "Hi\n\nTitle\n\nThe body of this article."
    for wrapper in ["<div hidden>%s</div>", "<section id=comments>%s</section>"]:
        assert html_extract.main_text(wrapper % page) == ""
    body = " ".join(["word"] * 60)
    assert html_extract.main_text(f"<form><h1>Head</h1><p>{body}</p><p>{body}</p></form>") == f"Head\n\n{body}\n\n{body}"
    assert html_extract.main_text(f"<article><p>Photo.</p></article><aside><article>{body}</article></aside><section id=comments><article>{body}</article></section>") == "Photo."
    assert html_extract.main_text("<form>" * 5000 + "<article>" * 5000 + "deep") == "deep"


def test_words_and_links_decide_in_and_outside_of_articles():
    body, link = " ".join(["word"] * 60), "<li><a href=x>One more of the stories that we have</a>"
    assert html_extract.main_text(f"<article><p>{body}</p><ul>{link * 4}</ul></article>") == body
    assert html_extract.main_text(f"<article><p>{body}</p><p><a href=x>A whole sentence that is one link.</a></p><p>{body}</p></article>").count("\n\n") == 2
    assert html_extract.main_text(f"<article><p>Teaser.</p></article><p>{body}</p><p>{body}</p><p>{body}</p><p>Legal</p>") == "\n\n".join(["Teaser.", body, body, body])
    assert html_extract.main_text(f"<article><p>{body}</p></article><p>Legal</p><p>{body}</p><p>Out</p>") == body


def test_tree_fits_its_table():
    rows = [list(map(float, line.split())) for line in html_extract.LABELLED.strip().split("\n")[1:]]
    assert all(html_extract.decided(r[:-1])[0] == r[-1] for r in rows) and len(rows) < 200


def test_names_that_say_little():
    body, short = " ".join(["word"] * 60), "<p>Buy this now</p>"
    assert html_extract.main_text(f'<div class="share-page main-search"><p>{body}</p><p>{body}</p></div>') == f"{body}\n\n{body}"
    assert html_extract.main_text(f'<article><p>{body}</p><p class="related">{body}</p><p class=promo>Buy this now</p><p>{body}</p></article>') == "\n\n".join([body] * 3)
    assert html_extract.main_text(f'<div class="post">teaser</div><div><p>{body}</p><p>{body}</p><p>{body}</p></div>') == "\n\n".join(["teaser", *[body] * 3])
    assert html_extract.main_text(f'<div class="has-sidebar"><p>{body}</p><div class=ad>{short}</div><p>{body}</p></div><div class=sidebar><p>{body}</p></div>') == f"{body}\n\n{body}"


def test_raw_elements_that_nothing_closes():
    for tag in ("select", "svg", "object", "iframe", "math"):
        assert html_extract.main_text(f"<article><p>One<{tag} x=1><p>Two</article>") == "One\n\nTwo"
    assert html_extract.main_text("<article><p>One<script>x<p>Two</article>") == "One"


def articles(spark, folder):
    """(page, blocks of its <article>)."""
    for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect():
        inner = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        found = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        yield r["html"], [b for b in found if b]


def test_word_counts_and_link_densities_decide(spark):
    """Of pages without any mark but <p>, <li> and <a>, and with classes that mislead; and how many blocks ask for them."""
    plain = {"<article>": "<div>", "</article>": "</div>", "<nav>": "<div>", "</nav>": "</div>", "<footer>": "<div>", "</footer>": "</div>", '<div class="ad">': "<div>"}
    right = blocks = asked = exact = pages = 0
    for html, want in articles(spark, "/root/testdata/sf0.01"):
        for mislead in ("<div>", '<div class="share-page search-main">'):
            page = html
            for a, b in plain.items():
                page = page.replace(a, mislead if a == "<article>" and len(" ".join(want).split()) > 45 * len(want) else b)
            found = html_extract.blocks(page)
            judged = [html_extract.decided(x) for x in html_extract.described(found)]
            truth = [b.text in want for b in found]
            right += sum(label == t for (label, _), t in zip(judged, truth, strict=True))
            asked += sum(any(f < 6 for f in features) for _, features in judged)
            blocks, pages = blocks + len(found), pages + 1
            exact += [b.text for b, (label, _) in zip(found, judged, strict=True) if label] == want
    assert right > 0.96 * blocks and asked > 0.9 * blocks and exact > 0.7 * pages, (right, asked, blocks, exact, pages)


def test_op2(spark, small):
    for r in queries.op2_main_text(spark, small).join(spark.read.parquet(f"{small}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        blocks = [" ".join(unescape(re.sub("<br>", " ", re.sub("</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(filter(None, blocks)) and r["n_chars"] == len(r["text"])


def test_extract_edge(spark):
    pages = spark.createDataFrame([(1, None, None, "z"), (None, "u", "", None), (2, "u", PAGE, "z"), (2, "u", PAGE, "z"), (3, "u", "<article>" + "<p>ab</p>" * 20_000, None)], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(r["n_chars"] for r in got.collect()) == sorted([0, 0, *[len(html_extract.main_text(PAGE))] * 2, 4 * 20_000 - 2])
    assert html_extract.extract(pages.limit(0)).count() == 0


def brute(rows, mod, k):
    """Answers of each query row, as (query id, answer) in order."""
    seen = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    units = [np.array(v) / np.abs(v).max() for _, v in seen]
    units = [u / np.linalg.norm(u) for u in units]
    out = []
    for a, (i, _) in enumerate(seen):
        if i % mod == 0:
            own = [(-round(float(np.dot(units[a], u)), 11), seen[b][0]) for b, u in enumerate(units) if len(u) == len(units[a]) and a != b]
            out.append((i, [(j, -s) for s, j in sorted(own)[:k]]))
    return sorted(out)


def found(df):
    """The same of a result: rows of a query id, dealt to its answers by rank."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"], r["vec_id"])):
        out.setdefault(r["query_id"], {}).setdefault(r["rank"], []).append((r["vec_id"], round(r["score"], 11)))
    answers = []
    for q, ranks in out.items():
        assert sorted(ranks) == list(range(1, len(ranks) + 1))
        answers += [(q, list(own)) for own in zip(*(ranks[r] for r in sorted(ranks)), strict=True)]
    return sorted(answers)


def vectors():
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(20).round(3).tolist()) for i in range(250)]
    rows += [(1000 + i, rows[50][1]) for i in range(40)] + [(2000, None), (2050, [0.0] * 20), (2100, [float("nan")] * 20), (2150, [1.0, None]), (2160, [float("inf")] * 20), (None, rows[1][1])]
    return rows + [(3000, [1.0, 2.0]), (3001, [1.0, 2.0]), (3002, [1.0, -1.0]), (3050, [3.0]), (2250, []), rows[100], (201, rows[7][1])]


@pytest.mark.parametrize("blocks", [{}, {"block_entries": 40, "block_queries": 3}, {"error_span": float("inf")}])
def test_nearest_against_brute_force(spark, blocks):
    rows = vectors()
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "vec_id long, embedding array<double>, vector string, score string")
    assert found(ann.nearest(df, F.col("vec_id") % 50 == 0, **blocks)) == [(q, a) for q, a in brute(rows, 50, 5) if a]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_vectors_of_any_size(spark):
    rows = [(0, [1e-200, 2e-200]), (50, [1e200, 1e200]), (1, [1.0, 2.1]), (2, [3e-310, 1e-310]), (3, [-1e308, 1e308]), (4, [1.0, 0.9]), (100, [0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(ann.nearest(df, F.col("vec_id") % 50 == 0, 3))
    assert got == brute(rows, 50, 3) and all(np.isfinite(s) for _, a in got for _, s in a)


def test_rows_that_repeat_are_candidates(spark):
    rows = [(50, [1.0, 0.0])] * 3 + [(7, [0.0, 1.0]), (51, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = found(ann.nearest(df, F.col("vec_id") % 50 == 0, 2))
    assert got == brute(rows, 50, 2) and got.count((50, [(50, 1.0), (50, 1.0)])) == 3


def test_estimates_are_within_their_bounds():
    rng = np.random.default_rng(5)
    for dim in (8, 64, 100):
        a, q = rng.standard_normal((800, dim)), rng.standard_normal((40, dim))
        near, error = ann.estimate(*ann.encode(a), ann.turn(q))
        exact = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (a / np.linalg.norm(a, axis=1, keepdims=True)).T
        assert (np.abs(near - exact) <= error).mean() > 0.999 and abs((near - exact).mean()) < 0.02


def test_op3_recall(spark):
    """Over several blocks, on vectors in clusters, and on the given table."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((30, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(centres[rng.integers(0, 30, 6000)] + 0.7 * rng.standard_normal((6000, 64)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    given = "/root/testdata/sf0.1"
    own = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{given}/embeddings.parquet").collect()]
    for got, all_rows in ((ann.nearest(df, F.col("vec_id") % 50 == 0, block_entries=700, block_queries=50), rows), (queries.op3_nearest(spark, given), own)):
        answers, want = dict(found(got)), dict(brute(all_rows, 50, 5))
        assert answers.keys() == want.keys()
        hits = [len({j for j, _ in answers[q]} & {j for j, _ in want[q]}) for q in want]
        assert sum(hits) >= 0.99 * 5 * len(want)


def test_op3(spark, small, tables):
    same_rows(queries.op3_nearest(spark, small), tables.sql(queries.SQL["op3_nearest"]))


def test_sql_of_op3_on_odd_vectors():
    import duckdb

    rows = vectors()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    got = con.sql(queries.SQL["op3_nearest"]).fetchall()
    want = {(q, rank, score) for q, answers in brute(rows, 50, 5) for rank, (_, score) in enumerate(answers, 1)}
    assert {(q, rank, round(score, 11)) for q, rank, _, score in got} == want


def test_products_are_those_of_a_plain_loop():
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((50, 67)), rng.standard_normal((50, 67))
    for x, y, got in zip(a.tolist(), b.tolist(), ann.products(a, b).tolist(), strict=True):
        total = 0.0
        for u, v in zip(x, y, strict=True):
            total += u * v
        assert total == got
