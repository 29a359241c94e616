"""Main text by template votes, license scans of any row, neighbours of unequal norms."""

import re

import numpy as np
import pytest

from trawl.llm import ann, licenses, mainpage


def text(html, *others):
    return mainpage.content(mainpage.tree(html), [mainpage.outline(mainpage.tree(h)) for h in others])


def page(i, notice="Subscribe to our daily letter!"):
    return f"<article><h1>T{i}</h1><p>own text number {i} that is long enough</p><p>{notice}</p></article>"


def test_template_goes_inside_an_article_too():
    own = ["T1", "own text number 1 that is long enough"]
    assert text(page(1), page(2), page(3)) == own
    assert text(page(1), page(2)) == [*own, "Subscribe to our daily letter!"]  # one other page is no proof
    assert text(page(1), page(2), page(3, "other"), page(4, "more")) == [*own, "Subscribe to our daily letter!"]


def test_near_copies_keep_their_paragraphs():
    pages = [f"<article><p>par one of it</p><p>par two of it</p><p>changed {i}</p></article>" for i in range(4)]
    assert text(pages[0], *pages) == ["par one of it", "par two of it", "changed 0"]


def test_roles_and_inline_elements():
    html = ('<body class="share"><header class="site-header">gone</header><article class="social science">'
            '<div class="article-header"><h1>Head</h1></div><p>x <span class="ad">buy</span>y<span class=share>s</span> z</p>'
            '<header>sub head</header></article></body>')
    assert text(html) == ["Head", "x y z", "sub head"]


def test_deep_and_odd_markup():
    assert text("<div>" * 10_000 + "deep") == ["deep"]
    assert text("<p>a<![foo[x]]>b<![CDATA[y]]>c") == ["abc"] and text("<!weird x>t<!-- c --><?php z ?>u<![") == ["tu"]
    assert text("<div>" * 3000 + "a", "<div>" * 3000 + "b") == ["a"]


@pytest.mark.parametrize("cells", [mainpage.CELLS, 0])
def test_alignment_of_lists(monkeypatch, cells):
    monkeypatch.setattr(mainpage, "CELLS", cells)
    own = "<div>" + "".join(f"<p>x{i}</p>" for i in range(300)) + "<p>same</p></div>"
    ref = "<div><p>new</p>" + "".join(f"<p>y{i}</p>" for i in range(280)) + "<p>x7</p><p>same</p></div>"
    assert set(text(own, ref)) <= {f"x{i}" for i in range(300)} and len(text(own, ref)) >= 299
    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = ([int(x) for x in rng.integers(0, 6, rng.integers(0, 12))] for _ in range(2))
        found = sorted(mainpage.aligned(a, b))
        assert all(a[i] == b[j] for i, j in found)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))
        if cells:  # a longest common subsequence
            t = np.zeros((len(a) + 1, len(b) + 1), int)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    t[i + 1, j + 1] = max(t[i, j + 1], t[i + 1, j], t[i, j] + (x == y))
            assert len(found) == t[-1, -1]


ROWS = [(None, "Released under the MIT License."), (None, "nothing"), (None, None), (3, "nothing"), (3, "released under the MIT license"),
        (4, "Licensed under the Creative Commons Attribution 4.0 International License"), (5, "GNU General Public License, CC BY"),
        (6, "x " * 30 + "Licensed under a creative commons attribution" + " y" * 30), (7, "under the"), (7, "under the"), (8, "")]


def test_licenses_equal_brute_force_and_null_ids_are_scanned(spark):
    df = spark.createDataFrame([(*r, 1, "t") for r in ROWS], "doc_id long, text string, key int, spans string")
    got = sorted((str(r.doc_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in licenses.scan(df).collect())
    want = []
    for i, t in ROWS:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        base = {label for _, label in at}
        # whole wordings, word by word
        more = {label for label, x in licenses.TEMPLATES for k in range(len(w)) if w[k:k + len(x.split())] == x.split()}
        starts = [k for k, _ in at]
        want.append((str(i), len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                     ",".join(sorted(base | more))))
    assert got == sorted(want)


def test_one_changed_word_still_votes(spark):
    df = spark.createDataFrame([(1, "licensed under the Creative Commons Attribution")], "doc_id long, text string")
    r = licenses.scan(df).first()
    assert r.labels == "cc" and 0.8 <= r.score < 1


def test_neighbours_with_unequal_norms_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(6000, 24)) * np.exp(0.5 * rng.normal(size=6000))[:, None]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(7000 + i, [1.0, float(i)]) for i in range(3)] + [(7000, [5.0, 0.0]), (20, v[20].tolist())]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(found) == {*range(0, 6000, 20), 7000}
    # ids 20 and 7000 stand twice: each row asks, and finds the other one
    assert len(found[20]) == 40 and 20 in {i for _, i in found[20]} and len(found[7000]) == 6
    hits = 0
    for q in range(0, 6000, 60):
        s = v @ v[q]
        s[q] = -np.inf
        hits += len(set(np.argsort(-s, kind="stable")[:20]) & {i for _, i in found[q]})
    assert hits >= 0.9 * 20 * 100
