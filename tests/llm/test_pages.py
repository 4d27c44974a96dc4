"""Main text of pages: reading blocks, the field against enumeration, held-out and given pages."""

import itertools
import time
from random import Random

import duckdb
import numpy as np
import pytest

from footfall.llm import pages
from footfall.llm.page_layouts import drawn_page

SCHEMA = "page_id long, url string, html string"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def field():
    return pages.fit(pages.drawn_pages(), Random(1))


def texts(html):
    return [b.text for b in pages.blocks(html)]


@pytest.mark.parametrize(("html", "found"), [
    ("", []), ("plain", ["plain"]), ("a < b &lt; c", ["a < b < c"]), ("<p>one<p>two", ["one", "two"]),
    ("<p>a<br>b<b>c</b>d&nbsp;\n e</p>", ["a bcd e"]), ("<div>x<p>y</p>z</div>", ["x", "y", "z"]),
    ("<script>var t = '</p><p>no';</script>yes<style>p{}</style>", ["yes"]), ("a<!-- <p>no --><!-- open", ["a"]),
    ("<head><title>no</title><body><p>yes", ["yes"]), ("<head><p>yes", ["yes"]), ("<p>yes</p><div cla", ["yes"]),
    ("<p>T&amp;&amp &copy; &quo", ["T&& © &quo"]), ("<p title='a>b' x=\"it's\">t</p>", ["t"]), ("<select><option>no</select>yes", ["yes"]),
    ("<ul><li>a<li>b</ul></p></nav>c", ["a", "b", "c"]), ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
    ("<SCRIPT>no</ſcript>no</Script>yes<ſcript>", ["yes<ſcript>"]), ("<p>  \n</p>", []),
])
def test_blocks(html, found):
    assert texts(html) == found


def test_surroundings():
    first, second = pages.blocks('<div class="Cookie-notice topBar"><p>a</p></div><article id=x><p>b <a href=y>c</a></p></article>')
    assert {"div", "p", ".cookie", ".notice", ".top", ".bar"} == first.around and first.own == "p"
    assert {"article", ".x", "p"} == second.around and second.linked == 1 and second.container != first.container


@pytest.mark.parametrize("html", [
    "<p>word " * 200_000, "<div class='a b c d'>x" * 100_000, "</div>" * 300_000, "<a <a " * 200_000, "<!-- " * 200_000, "<x a='" * 150_000,
    "<div>" * 100_000 + "x" + "</div>" * 100_000, "<script>" * 100_000, "&amp" * 300_000, "<td>x<tr>" * 60_000])
def test_long_pages_take_linear_time(html):
    start = time.perf_counter()
    pages.blocks(html, frozenset({"div", "p"}))
    assert time.perf_counter() - start < 20


def test_viterbi_equals_enumeration():
    rng = np.random.default_rng(3)
    page = pages.blocks("<div>a<p>bb</p><p>ccc</p></div><section><p>dd <a>d</a></p>e</section><ul><li>f<li>g</ul>")
    for _ in range(30):
        names = {f for s, b in zip(pages.shape(page), page, strict=True) for f in [*s, *b.around]}
        field = pages.Field({f: float(rng.normal()) for f in sorted(names)}, rng.normal(size=(2, 2, 2)) * 2)

        def score(labels):
            own = sum(field.weights[f] for s, b, on in zip(pages.shape(page), page, labels, strict=True) if on for f in [*s, *b.around])
            steps = zip(page, page[1:], labels, labels[1:], strict=False)
            return own + sum(field.pairs[int(a.container == b.container), int(x), int(y)] for a, b, x, y in steps)

        best = max(itertools.product([False, True], repeat=len(page)), key=score)
        assert field.labels(page) == list(best)


def test_gradient_leads_to_the_most_likely_weights():
    """At the end of the fit no weight moved a little makes the labels likelier, counted by enumeration."""
    rng = Random(5)
    made = [pages.Labelled([["=a"] if rng.random() < 0.5 else ["=b"] for _ in range(4)], [[]] * 4, [0, 0, 1, 1],
                           [rng.random() < 0.6 for _ in range(4)]) for _ in range(30)]
    field = pages.fit(made, Random(0), rounds=600)

    def loss(weights, pairs):
        total = 0.0
        for p in made:
            def score(labels, p=p):
                own = sum(weights[f] for s, on in zip(p.shapes, labels, strict=True) if on for f in s)
                return own + sum(pairs[int(p.containers[i] == p.containers[i + 1]), int(labels[i]), int(labels[i + 1])] for i in range(3))
            every = [score(x) for x in itertools.product([False, True], repeat=4)]
            total += np.logaddexp.reduce(every) - score(p.labels)
        return total / len(made) + 0.5e-3 * (sum(w * w for w in weights.values()) + (pairs**2).sum())

    least = loss(field.weights, field.pairs)
    for name in field.weights:
        for step in (-0.05, 0.05):
            assert loss({**field.weights, name: field.weights[name] + step}, field.pairs) > least
    for at in np.ndindex(2, 2, 2):
        for step in (-0.05, 0.05):
            pairs = field.pairs.copy()
            pairs[at] += step
            assert loss(field.weights, pairs) > least


def test_held_out_layouts(field):
    right = wrong = 0
    for i in range(200):
        html, mark = drawn_page(Random(f"held-out {i}"))
        page = pages.blocks(html)
        wanted = [mark in b.text for b in page]
        found = field.labels([b._replace(text=b.text.replace(mark, "")) for b in page])
        right += sum(a == b for a, b in zip(found, wanted, strict=True))
        wrong += sum(a != b for a, b in zip(found, wanted, strict=True))
    assert wrong / (right + wrong) < 0.03


def test_parts_inside_and_around_an_article(field):
    long = "Words of a long sentence that goes on and on, with commas, and ends at last. " * 4
    html = (
        f"<header><h1><a href=/>Site</a></h1></header><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>"
        f"<div class='cookie-notice'><p>{long}</p></div><article><h1>Title</h1><p>{long}</p><p>Short.</p><div class='ad'>{long}</div>"
        f"<p>{long} <a href=x>more</a></p><p>End.</p></article><section class='comments'><div class='comment'><p>{long}</p></div></section>"
        f"<aside class='sidebar'><p>{long}</p></aside><form><label>Name</label><p>{long}</p></form><footer>&copy; Site &middot; {long}</footer>")
    page = pages.blocks(html)
    long = long.strip()
    assert [b.text for b, on in zip(page, field.labels(page), strict=True) if on] == ["Title", long, "Short.", f"{long} more", "End."]


def test_given_pages_equal_their_articles(spark):
    from html import unescape
    import re

    rows = duckdb.sql(f"SELECT page_id, html FROM '{FOLDER}/pages.parquet'").fetchall()
    wanted = {}
    for i, html in rows:
        inside = re.sub(r"(?s).*<article>|</article>.*", "", html)
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", p))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        wanted[i] = "\n\n".join(p for p in parts if p)
    df = spark.read.parquet(f"{FOLDER}/pages.parquet")
    found = pages.main_text(df, pages.train(df), keep=["page_id"]).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == wanted[r["page_id"]] and r["n_chars"] == len(r["text"])


def test_odd_rows_and_clashing_columns(spark):
    article = "<nav><a href=/>x</a></nav><article><p>Some text here, and more of it.</p><p>Again some text.</p></article><footer>&copy;</footer>"
    rows = [(1, "u", None), (2, None, ""), (None, "u", article), (3, "u", article), (3, "u", article), (4, "u", "<p></p>")]
    df = spark.createDataFrame([(*r, 7, "y") for r in rows], SCHEMA + ", n_chars int, text string")
    found = pages.main_text(df, pages.train(df, drawn=150))
    got = sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in found.collect())
    whole = "Some text here, and more of it.\n\nAgain some text."
    assert got == [(0, whole, len(whole)), (1, "", 0), (2, "", 0), (3, whole, len(whole)), (3, whole, len(whole)), (4, "", 0)]
    empty = df.limit(0)
    assert pages.main_text(empty, pages.train(empty, drawn=150)).count() == 0
