import itertools

import numpy as np
import pytest

from orthoplan.llm import html_tree

P = "<p>The council met on Tuesday to discuss the new bridge over the river, its costs and the time it takes to build.</p>"


@pytest.fixture(scope="module")
def model():
    return html_tree.trained()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    t = html_tree.parsed("<div><p>a<b>x</b></p><ul><li>1<li>2</ul></div><nav>m</nav>")
    f = html_tree.forest([t], {"bias": 0, "tag:p": 1, "tag:li": 2, "tag:nav": 3})
    w, pair = rng.standard_normal(4), rng.standard_normal((html_tree.N_GROUPS, 2, 2))
    got, _ = html_tree.marginals(f, w, pair)
    n = len(f.parent)
    unary = np.bincount(f.rows, w[f.ids], minlength=n)
    total = np.zeros((n, 2))
    for y in itertools.product((0, 1), repeat=n):
        s = sum(unary[v] * y[v] for v in range(n)) + sum(pair[f.group[v], y[f.parent[v]], y[v]] for v in range(n) if f.parent[v] >= 0)
        for v in range(n):
            total[v, y[v]] += np.exp(s)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True))


def test_held_out_pages(model):
    wrong = pieces = 0
    for seed in range(10_000, 10_120):
        t, y = html_tree.labelled(seed)
        content = html_tree.marginals(html_tree.forest([t], model.number), model.weights, model.pair)[0][:, 1] >= 0.5
        told = [v for v, s in t.pieces if v >= 0 and s.strip()]
        wrong += sum(content[v] != y[v] for v in told)
        pieces += len(told)
    assert wrong <= 0.01 * pieces


CASES = [
    (f"<html><body><nav><a href=/>Home</a> <a href=/n>News</a></nav><article><h1>A  bridge\n&amp; more</h1>{P}<p>Sec<b>ond</b> &eacute;&#33; one<br>two</article><footer>&copy; 2024 Us</footer></body></html>", ["A bridge & more", "The council met", "Second é! one two"], ["Home", "2024"]),
    (f"<body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies.</p></div><main>{P}<div class=ad>Buy now!</div>{P}<form><p>Join us</p><input></form></main><aside><p>Also read this.</p></aside><section class='comments'><div class=comment><p>I do not agree with this at all, it is a long comment.</p></div></section>", ["The council met"], ["Site", "cookies", "Buy", "Join", "Also", "agree"]),
    (f"<div id=page><div class='post-body'>{P}<script>var x = '<p>no</p>';</script><style>p{{}}</style><!-- <p>gone</p> -->{P}</div><div class=sidebar><ul><li><a href=1>One</a></ul></div></div>", ["The council met"], ["no", "gone", "One"]),
]


@pytest.mark.parametrize("page, has, lacks", CASES)
def test_parts_of_pages(model, page, has, lacks):
    text = html_tree.main_texts(model, [page])[0]
    assert all(x in text for x in has) and not any(x in text for x in lacks), text


def test_broken_markup_and_odd_rows(spark, model):
    odd = [None, "", "   ", "<", "<<<>>", "</p></div>", "<p", "<!-- open", "<script>never closed", "<a href='x", "plain text", "<div>" * 3000 + "deep", "<article>" + P * 3000 + "</article>"]
    pages = spark.createDataFrame([(i if i else None, "u", h, "clash") for i, h in enumerate(odd)] + [(3, None, "", None)], "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): r for r in html_tree.extracted(pages.repartition(3), model).collect()}
    assert len(got) == len(odd) + 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert [got[i, "u"].text for i in (None, 1, 2, 7, 8)] == [""] * 5
    assert got[12, "u"].text.count("The council met") == 3000
    assert html_tree.extracted(pages.limit(0), model).count() == 0
