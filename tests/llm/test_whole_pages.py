"""Pages without a marked article, at any number of pages of a host, with copies and with marks that mark nothing."""

import random

import numpy as np

from sparcase.llm import html_text

KINDS = "page_id long, url string, html string"


def texts_of(spark, rows, **more):
    return sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.html_text(spark.createDataFrame(rows, KINDS), **more).collect())


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_passages_are_found_across_shards(spark):
    rng = random.Random(1)
    shared = [words(rng, 20) for _ in range(6)]
    own = [words(rng, 30) for _ in range(12)]
    rows = [(i, f"http://h.example/{i}", f"<p>{' '.join(shared[i % 6])}</p><p>{' '.join(w)}</p>") for i, w in enumerate(own)]
    rows.append((12, "http://other.example/", f"<p>{' '.join(shared[0])}</p>"))
    want = [(i, " ".join(w), 209) for i, w in enumerate(own)] + [(12, " ".join(shared[0]), 139)]
    assert texts_of(spark, rows, shard_pages=1) == texts_of(spark, rows) == want


def test_runs_like_the_suffix_array(spark):
    rng = random.Random(2)
    pages = sorted({" ".join(rng.choice("abcd") for _ in range(60)) for _ in range(8)})
    rows = [(i, "http://h/", f"<p>{t}</p>") for i, t in enumerate(pages)]
    masks = html_text.repeated([t.split() for t in pages], 5, 2)
    want = []
    for i, (t, m) in enumerate(zip(pages, masks)):
        if (~m).sum() >= 5:
            want.append((i, " ".join(w for w, c in zip(t.split(), m) if not c)))
    got = {i: t for i, t, _ in texts_of(spark, rows, depth=5, shard_pages=3)}
    assert len(want) > 5 and any(m.any() for m in masks) and all(got[i] == t for i, t in want)


def test_marks_that_mark_nothing(spark):
    rng = random.Random(3)
    shared, own = words(rng, 20), [words(rng, 30) for _ in range(4)]
    marks = ["<!-- <article> -->", '<script>var a = "<main>";</script>', '<script type="application/ld+json">{"articleBody": "x"}</script>', "<article></article>"]
    rows = [(i, "http://h/", f"{m}<p>{' '.join(shared)}</p><p>{' '.join(w)}</p>") for i, (m, w) in enumerate(zip(marks, own))]
    rows.append((4, "http://h/", f"<article><p>{' '.join(shared)}</p></article>"))
    assert texts_of(spark, rows) == [*((i, " ".join(w), 209) for i, w in enumerate(own)), (4, " ".join(shared), 139)]


def test_copies_stay(spark):
    rng = random.Random(4)
    menu, article = words(rng, 20), words(rng, 60)
    page = lambda *parts: "".join(f"<p>{' '.join(p)}</p>" for p in parts)
    others = [words(rng, 40) for _ in range(3)]
    rows = [(0, "http://h/0", page(menu, article)), (0, "http://h/0", page(menu, article)), (1, "http://h/1", page(menu, article)), (2, "http://h/2", page(menu, article, ["Page", "2"]))]
    rows += [(3 + i, f"http://h/{3 + i}", page(menu, o)) for i, o in enumerate(others)] + [(6, "http://x/", page(article)), (6, "http://x/", page(article))]
    got = [(i, t) for i, t, _ in texts_of(spark, rows)]
    whole = " ".join(article)
    assert got == [(0, whole), (0, whole), (1, whole), (2, whole + "\nPage 2"), *((3 + i, " ".join(o)) for i, o in enumerate(others)), (6, whole), (6, whole)]


def test_short_rests():
    on = np.array([50] * 5)
    assert html_text.boilerplate(10, np.arange(5), on, 4, 2).tolist() == [True] * 8 + [False] * 2
    assert not html_text.boilerplate(8, np.arange(5), on, 4, 2).any()


def test_planted_boilerplate(spark):
    """Of the passages planted on a host's pages, within the article, beside it and on pages without one, all are found;
    passages that a few articles share, teasers and copies of articles stay."""
    rng = random.Random(7)
    plug, promo, quote = words(rng, 30), words(rng, 24), words(rng, 40)
    p = lambda w: f"<p>{' '.join(w)}</p>"
    rows, want = [], {}
    for i in range(40):
        own = [words(rng, 50), words(rng, 50)]
        extra = [quote] if i in (3, 4, 5) else []
        if i % 4 == 3:  # no article marked
            rows.append((i, "http://h/", f"<div>{p(promo)}{p(own[0])}{p(own[1])}{p(plug)}</div>"))
            extra = []
        else:
            inside = p(promo) if i % 4 == 1 else ""
            beside = f'<div class="promo">{p(promo)}</div>' if i % 4 == 2 else ""
            teaser = f"<aside>{p(words_of[0])}</aside>" if i > 8 and (words_of := rows_own) else ""
            rows.append((i, "http://h/", f"{beside}{teaser}<article>{p(own[0])}{p(plug)}{''.join(map(p, extra))}{inside}{p(own[1])}</article>"))
        if i == 0:
            rows_own = own
        want[i] = "\n".join(" ".join(w) for w in [own[0], *extra, own[1]])
    rows += [(100 + k, "http://h/copy", rows[0][2] + "<!-- again -->" * k) for k in range(3)]
    want |= {100 + k: want[0] for k in range(3)}
    got = {i: t for i, t, _ in texts_of(spark, rows)}
    assert got == want


def test_markup():
    main = lambda page: html_text.page_blocks(page)[0]
    assert main("<article><p>Main</p></article><aside><article><p>Related card</p></article></aside>") == ["Main"]
    assert main('<article><p>Main</p></article><div id="comments"><article class="c"><p>Nice</p></article></div>') == ["Main"]
    assert main('<main><div class="post has-sidebar"><p>Body text</p></div></main>') == ["Body text"]
    assert main("<nav><ul><li>Menu<article><p>Main</p></article>") == ["Main"]
    assert main('<div class="page sidebar-left"><article><p>Main</p></article></div>') == ["Main"]
    for page in ('<form id="aspnetForm"><h1>Head</h1><p>Body</p></form>', '<form><article><h1>Head</h1><p>Body</p></article></form>'):
        inner, every, _ = html_text.page_blocks(page)
        assert (inner or every) == ["Head", "Body"]
    assert html_text.page_blocks('<form id="aspnetForm"><p>Body</p></form>')[1] == ["Body"]
    assert html_text.page_blocks("<p>x</p><form><p>Your mail</p></form>")[1:] == (["x"], ["Your mail"])


def test_awkward_pages(spark):
    kinds = KINDS + ", host string, content string, runs int, a long, place int, n int, _maybe boolean"
    more = ("h", "c", 1, 2, 3, 4, True)
    assert html_text.html_text(spark.createDataFrame([], kinds)).count() == 0
    long = "".join(f"<p>w{i} x{i} y{i}</p>" for i in range(40_000))
    rows = [(1, "http://h/", long), (1, "http://h/", long), (2, None, long), (3, "http://h/", None), (4, "http://h/", ""), (None, "u", "<p>z</p>"), (5, "HTTP://H/", "<p>" + "a " * 100_000 + "</p>"), (6, "http://h/", "<p>ties ties</p>")]
    out = html_text.html_text(spark.createDataFrame([(*r, *more) for r in rows], kinds))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(((r["page_id"] or 0), len(r["text"]), r["n_chars"]) for r in out.collect())
    n = sum(len(f"w{i} x{i} y{i}") for i in range(40_000)) + 39_999
    assert got == [(0, 1, 1), (1, n, n), (1, n, n), (2, n, n), (3, 0, 0), (4, 0, 0), (5, 199_999, 199_999), (6, 9, 9)]
