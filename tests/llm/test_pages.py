"""Page extraction: the parser on odd markup, the field against brute force, held-out layouts and the given template."""

import html
import itertools
import os
import random
import re
import time

import numpy as np
import pytest

from caseloom.llm import layouts, pages
from caseloom.llm.dom import Block, blocks


def texts(page):
    return [b.text for b in blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>a\n b&nbsp;c<br>d<p>e", ["a b c d", "e"]),
        ("<p>a<b>b<p>c</p>d</b>", ["ab", "c", "d"]),
        ("<script>var t='</p>';</script>x<style>y</style><SCRIPT>z</SCRIPT ><p>w", ["x", "w"]),
        ("a<script>never closed <p>b", ["a"]),
        ("a<!-- <p>b</p> -->c<!-->d<!-- e --!>f<!-- open", ["acdf"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", ["a", "b", "c"]),
        ("<div title='a > b'>x</div><p data-x=\"<p>\">y", ["x", "y"]),
        ("<p don't>a</p><p class=x/>b", ["a", "b"]),
        ("1 < 2 &lt;p&gt; &copy &#x41;&#66;; </>x</ y>z", ["1 < 2 <p> © AB; xz"]),
        ("<p>a</div></span>b</section>c", ["a", "b", "c"]),
        ("<button>go</button><select><option>a</select><textarea><p>b</textarea><template><p>c</p></template>d<svg><text>e</text></svg>f", ["df"]),
        ("<p>cut &am", ["cut &am"]),
        ("<p>cut <a href='x", ["cut"]),
        ("<p>cut</p><foot", ["cut"]),
    ],
)
def test_markup(page, want):
    assert texts(page) == want


def test_ancestors_and_links():
    (a, b) = blocks("<body><div id='siteFooter' hidden><p>x <a href=y>link</a></div><article role=main>z")
    assert {"in:div", "in:p", "in:body", "says:foot", "says:top", "says:hidden"} == set(a.above)
    assert (a.linked, a.links, a.tag) == (4, 1, "p") and "says:content" in b.above and b.links == 0


@pytest.mark.parametrize("page", ["<div>" * 50_000 + "x" + "<li>a</li>" * 50_000, '<a href="x' * 100_000, "<" * 300_000, "<!--" * 100_000, "</p " * 100_000, "<p x='" * 50_000, "<p>" + "word " * 400_000, "<a>" * 100_000, "&" * 300_000, "<p>a" * 30_000])
def test_linear(page):
    start = time.perf_counter()
    chain = blocks(page)
    pages.features(chain)
    assert time.perf_counter() - start < 10


def _random_chain(rng, n):
    return [Block("a b.", 0, 0, frozenset(rng.sample(["in:p", "in:nav", "says:foot"], 2)), "p", rng.randrange(3), rng.randrange(3)) for _ in range(n)]


def test_field_against_all_paths():
    """Viterbi and gradients equal those from all state sequences."""
    rng = random.Random(3)
    gen = np.random.default_rng(3)
    field = pages.Field({"in:p": 0, "in:nav": 1, "says:foot": 2}, gen.normal(size=(3, 2)), gen.normal(size=(3, 2, 2)), gen.normal(size=(2, 2)))
    for n in range(1, 7):
        chain = _random_chain(rng, n)
        score, kind = field.scores(chain), pages._together(chain)

        def weight(path, score=score, kind=kind):
            return field.ends[0, path[0]] + field.ends[1, path[-1]] + sum(score[i, s] for i, s in enumerate(path)) + sum(field.step[k, a, b] for k, a, b in zip(kind, path, path[1:]))

        paths = list(itertools.product((0, 1), repeat=n))
        assert field.decode(chain) == [bool(s) for s in max(paths, key=weight)]
        # padded to eight blocks
        truth = [rng.randrange(2) for _ in range(n)]
        p = np.exp([weight(x) for x in paths])
        wide, kinds, gold = np.zeros((1, 8, 2)), np.full((1, 7), 2), np.zeros((1, 8), int)
        wide[0, :n], kinds[0, : n - 1], gold[0, :n] = score, kind, truth
        like, d_score, d_step, d_ends = pages.gradients(wide, kinds, np.array([n]), gold, field.step, field.ends)
        assert np.isclose(like, weight(truth) - np.log(p.sum()))
        share = np.array([[sum(q for q, x in zip(p, paths) if x[i] == s) / p.sum() for s in (0, 1)] for i in range(n)])
        assert np.allclose(d_score[0, :n], np.eye(2)[truth] - share) and np.allclose(d_score[0, n:], 0)
        assert np.allclose(d_ends[1], np.eye(2)[truth[-1]] - share[-1])
        pairs = np.zeros((3, 2, 2))
        for q, x in [*((-q / p.sum(), x) for q, x in zip(p, paths)), (1, truth)]:
            for k, a, b in zip(kind, x, x[1:]):
                pairs[k, a, b] += q
        assert np.allclose(d_step, pairs)


def test_held_out_layouts():
    field, right, wrong, total = pages.learnt(), 0, 0, 0
    for i in range(300):
        chain, truth = pages.labelled(layouts.page(random.Random(f"held out {i}")))
        got = field.decode(chain)
        right += got == truth
        wrong += sum(a != b for a, b in zip(got, truth))
        total += len(truth)
    assert right >= 0.93 * 300 and wrong <= 0.01 * total


HAND = [
    ("<html><body><div id=cookie-banner><p>We use cookies to help you.</p></div><div class='site-header'><a href=/>Home</a></div><div class='post'><h1>A day out</h1><p>We left at dawn, all of us, and walked.</p><p>Then it rained.</p></div>"
     "<div id='comments'><div class='comment'><p>Lovely story, thank you for this.</p></div></div><footer>© 2024 Me. All rights reserved.</footer>", ["A day out", "We left at dawn, all of us, and walked.", "Then it rained."]),
    ("<body><nav><a href=/a>One</a> <a href=/b>Two</a></nav><main><h1>Über uns &amp; mehr</h1><p>Ein Satz, der hier steht, und noch ein Satz.</p><ul><li>Erstens steht das hier.</li><li>Zweitens auch.</li></ul></main>"
     "<aside><h3>Related</h3><ul><li><a href=/x>Another story about things</a></li></ul></aside>", ["Über uns & mehr", "Ein Satz, der hier steht, und noch ein Satz.", "Erstens steht das hier.", "Zweitens auch."]),
]


_STORY = "<h1>The river in spring</h1><p>Water came down from the hills all week, and the mill was closed.</p><p>Short one.</p><ul><li>First point of the list</li></ul><h2>After the flood</h2><p>People cleaned their houses &amp; shops.</p>"
_TOLD = ["The river in spring", "Water came down from the hills all week, and the mill was closed.", "Short one.", "First point of the list", "After the flood", "People cleaned their houses & shops."]
HAND += [
    (f"<body><table><tr><td><a href=1>Home</a><br><a href=2>Links</a></td><td>{_STORY}</td></tr></table><p>&copy; 1999</p>", _TOLD),
    (f"<body>{_STORY}<form action=/s><label>Your email</label><input><p>Subscribe to get our weekly letter in your inbox.</p></form>", _TOLD),
    (f"<body><div class='wrapper'><div class='ad-banner'><p>Buy the new phone now. It is the best phone that money can buy, and it is on sale.</p></div><div class='post-body'>{_STORY}<div class='promo'>Sponsored: visit our shop for more.</div><p>The last paragraph follows an advert, as it often does.</p></div>"
     "<div class='comments-area'><ol><li class='comment'><p>What a story. I was there, and the water was high.</p></li></ol></div></div>", [*_TOLD, "The last paragraph follows an advert, as it often does."]),
    (f"<body><article>{_STORY}<p>All rights reserved.</p><section class=comments><h2>Comments</h2><article class=comment><p>Reader text that is quite long, with commas, and such things as readers write.</p></article></section><nav class=related><a href=1>Next story</a></nav></article>", [*_TOLD, "All rights reserved."]),
]


@pytest.mark.parametrize(("page", "want"), HAND)
def test_pages_by_hand(page, want):
    assert pages.extract(page, pages.learnt()).split("\n") == want


def test_rows(spark):
    rows = [(1, "u", None), (None, None, ""), (3, "v", "<p>"), (4, "w", HAND[0][0]), (4, "w", HAND[0][0]), (5, "x", "<article><h1>T</h1><p>" + "Long words here. " * 60_000 + "</p></article><footer>end</footer>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' as text", "1 as n_chars")
    got = {(r.page_id, r.url): r for r in pages.main_text(df).collect()}
    assert pages.main_text(df).count() == 6 and got[1, "u"].text == got[None, None].text == got[3, "v"].text == "" and got[1, "u"].n_chars == 0
    assert got[4, "w"].text == "\n".join(HAND[0][1]) and got[5, "x"].n_chars == 2 + 17 * 60_000 - 1
    assert pages.main_text(df.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_given_pages(spark):
    """The given template has its text between <article> and </article>."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {}
    for r in df.collect():
        lines = (" ".join(html.unescape(re.sub("<[^>]+>", "", x)).split()) for x in re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", r.html, re.S).group(1)))
        want[r.page_id] = "\n".join(x for x in lines if x)
    got = {r.page_id: r.text for r in pages.main_text(df).collect()}
    assert got == want
