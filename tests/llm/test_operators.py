"""Each operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenark.llm import chat, components, decontamination, html_text, near_dedup, packing, quality, registry, substring_dedup, token_counts, token_files, tokens, toxicity
from lumenark.llm.common import Scratch
from tests.llm import brute
from tests.oracle import connect, rows_of, rows_of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, component_id string, shard string, bucket string, id string"


def make(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "b", "i") for i, t, s in rows], DOCS)


def corpus(seed=0, n=60):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(300)]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 120))) for _ in range(n)]
    out = []
    for i, t in enumerate(base):
        kind = i % 6
        if kind == 1:
            t = base[i - 1]
        elif kind == 2:
            w = base[i - 2].split()
            for _ in range(r.randint(1, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            t = " ".join(w)
        elif kind == 3:
            t = t + "\n" + " ".join(base[0].split()[:25]) + "\n" + t.upper()
        elif kind == 4:
            t = (" ".join(t.split()[:22]) + "\n") * 3
        out.append((i, t, f"s{i % 3}"))
    return out + [(1000, None, None), (1001, "", "s0"), (1002, " \t\n", "s0"), (1003, "One two", "s1"), (1004, "one TWO", "s1"), (1005, "word " * 3000, "s2"), (1006, "x" * 50_000, "s2"), (1007, "é\x0b中    ", "s0")]


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_near_duplicates(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute.near([(i, t) for i, t, _ in corpus()])
    assert near_dedup.near_duplicates(empty).count() == 0
    odd = near_dedup.near_duplicates(make(spark, [(None, "a b c d e f", "s"), (None, "a b c d e f", "s"), (7, "a b c d e f", "s"), (7, "a b c d e f", "s"), (9, "a b c d e f", "s")])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in odd) == [(-1, -1, True), (-1, -1, True), (7, 7, True), (7, 7, True), (9, 7, False)]
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, (_, c) in got.items() if c == i}


def test_near_duplicates_of_documents_with_several_texts(spark):
    """A document is linked by each of its texts; rows of other documents that share elements with them lose no link."""
    r = random.Random(8)
    texts = [[f"t{k}x{r.randrange(99999)}" for _ in range(80)] for k in range(3)]
    near = [" ".join(w[:-2] + ["q", f"z{i}"]) for i, w in enumerate(texts)]
    a, b, c = (" ".join(w) for w in texts)
    for rows, expected in (
        ([(7, a), (7, b), (8, near[0]), (9, near[0])], {7: 7, 8: 7, 9: 7}),
        ([(3, b), (7, near[1]), (7, c), (2, near[2]), (1, a), (7, ""), (7, None)], {3: 2, 7: 2, 2: 2, 1: 1}),
    ):
        got = near_dedup.near_duplicates(make(spark, [(i, t, "s") for i, t in rows])).collect()
        assert len(got) == len(rows) and {(x.doc_id, x.component_id) for x in got if x.n_shingles} == set(expected.items())


def test_buckets_of_many_components_go_on_with_pivots(spark, monkeypatch):
    """Documents of shared lines that are not alike enough, in one bucket; few pairs allowed a round."""
    monkeypatch.setattr(near_dedup, "PAIRS", 0)
    r = random.Random(9)
    shared = [f"s{i}" for i in range(300)]
    rows = []
    for i in range(60):
        at = r.randrange(40)
        rows.append((i, " ".join(shared[at : at + 100] + [f"own{i // 2}x{j}" for j in range(r.randint(10, 60))]), "s"))
    rows += [(100 + i, rows[i][1], "s") for i in range(40)] + [(200 + i, rows[0][1], "s") for i in range(50)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(make(spark, rows), bands=40, rows=2).collect()}
    assert got == brute.near([(i, t) for i, t, _ in rows])


def test_chains_and_large_groups_are_joined(spark):
    """A chain whose ends are unlike, and a group of copies that differ a little."""
    words = [f"w{i}" for i in range(400)]
    chain = [(i, " ".join(words[5 * i : 5 * i + 60]), "s") for i in range(20)]
    r = random.Random(4)
    base = [f"b{i}" for i in range(80)]
    group = []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(80)] = f"q{r.randrange(9999)}"
        group.append((100 + i, " ".join(w), "s"))
    rows = chain + group
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicates(make(spark, rows)).collect()}
    assert got == brute.near([(i, t) for i, t, _ in rows])


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(0)
    a = r.integers(0, 1 << 63, 900, dtype=np.uint64)
    b = np.r_[a[:700], r.integers(0, 1 << 63, 200, dtype=np.uint64)]
    s = near_dedup.sketches(np.r_[a, b, a[:1]], np.array([900, 900, 1]), 512)
    assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((s[0] == s[1]).mean() - 700 / 1100) < 0.1
    x, y = near_dedup.parities(a.view(np.int64)), near_dedup.parities(b.view(np.int64))
    assert sum(bin(int(v) & (1 << 64) - 1).count("1") for v in x ^ y) <= 400


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (10, 9), (9, 10), (5, 5), (None, 4), (3, 4), (20, 21), (21, 22), (22, 23), (23, 20)], "a long, b long")
    got = {r.node: r.component for r in components.components(links, Scratch(spark)).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 10: 9, 21: 20, 22: 20, 23: 20}
    assert components.components(links.limit(0), Scratch(spark)).count() == 0


def test_repeats(spark, docs, empty):
    expected = brute.repeats([(i, t) for i, t, _ in corpus()])
    for with_text in (True, False):
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.remove_repeats(docs, with_text=with_text).collect()}
        assert got == expected
    assert substring_dedup.remove_repeats(empty).count() == 0
    cut = {r.doc_id: r for r in substring_dedup.without_repeats(docs).collect()}
    assert all(hashlib.sha256(" ".join(brute.words(cut[i].text)).encode()).hexdigest() == e[2] for i, e in expected.items())
    assert all(cut[i].text == t for i, t, _ in corpus() if not expected[i][1]) and all(r.n_chars == len(r.text or "") for r in cut.values())
    text = " ".join(map(str, range(30)))
    odd = substring_dedup.remove_repeats(make(spark, [(None, text, "s"), (3, text, "s"), (3, text, "s"), (5, text, "s")])).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in odd) == [(-1, 0), (3, 0), (3, 0), (5, 30)]


def test_repeats_in_rows_that_share_an_id_but_not_their_text(spark):
    shared, long_ = " ".join(f"s{i}" for i in range(25)), " ".join(f"l{i}" for i in range(60))
    short, other = "a b c", " ".join(f"o{i}" for i in range(30))
    # id 5: a long text with a repeat at its end, a short one, a whole copy of an earlier document, and a text of its own
    rows = [(1, shared), (5, f"{long_} {shared}"), (5, short), (5, shared), (5, other), (6, f"x {other}"), (6, "x y")]
    kept = [(1, shared), (5, long_), (5, short), (5, ""), (5, other), (6, "x"), (6, "x y")]
    table = make(spark, [(i, t, "s") for i, t in rows])
    assert sorted((r.doc_id, r.kept_text) for r in substring_dedup.remove_repeats(table).collect()) == sorted(kept)
    sums = sorted((i, len(t.split()), len(t.split()) - len(k.split()), hashlib.sha256(k.encode()).hexdigest()) for (i, t), (_, k) in zip(rows, kept, strict=True))
    assert sorted(tuple(r) for r in substring_dedup.remove_repeats(table, with_text=False).collect()) == sums
    assert sorted((r.doc_id, r.text, r.n_chars) for r in substring_dedup.without_repeats(table).collect()) == sorted((i, k, len(k)) for i, k in kept)


def test_rabin_karp_and_anchors():
    w = np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64)
    p = (1 << 61) - 1
    base = 0x1B873593CC9E2D51 % p
    for window in (1, 2, 5, 20):
        got = substring_dedup.rabin_karp(w, window)
        assert [int(v) for v in got] == [sum((int(w[i + j]) >> 3) % p * pow(base, window - 1 - j, p) for j in range(window)) % p for i in range(50 - window + 1)]
    at, _ = substring_dedup.anchors(w, 20, 8)
    assert all(i <= a <= i + 12 for i, a in enumerate(at)) and len(at) == 31


def test_quality(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, None, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_verdicts(docs, labels).collect()}
    for i, t, _ in corpus():
        m = brute.quality(t)
        r = got[i]
        assert tuple(r[k] for k in quality.BASE) == m, i
        assert r.base_failed == (m[0] < 10 or 100 * m[4] > 20 * m[0]) and r.kept == (not r.base_failed)
    assert quality.quality_verdicts(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.keep_good(docs, labels.limit(0)).count() == len([r for r in got.values() if not r.base_failed])


def test_certified_cutoffs_catch_junk_and_spare_the_good(spark):
    r = random.Random(1)
    rows = [(i, " ".join(f"w{r.randrange(5000)}" + ("***" if i % 4 == 0 else "") for _ in range(30)), "s") for i in range(2400)]
    df = make(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(2400)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id for x in quality.quality_verdicts(df, labels, risk=0.04).where("kept").collect()}
    assert kept == {i for i in range(2400) if i % 4}


def test_binomial_bound_is_exact(spark):
    from math import comb

    rows = [(k, n) for n in (10, 200) for k in (0, 1, 2)]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality.binomial_cdf(F.col("k"), F.col("n"), 0.3))
    for r in df.collect():
        exact = sum(comb(r.n, j) * 0.3**j * 0.7 ** (r.n - j) for j in range(r.k + 1))
        assert r.p == pytest.approx(exact, rel=1e-9)


def test_chat(spark):
    conflict = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 1, "assistant", conflict), (1, 0, "user", "a <| b <\\|c"), (2, 0, None, None), (2, 1, "assistant", ""), (2, 1, "assistant", ""), (None, 0, "user", "x"), (3, 0, "ro\nle\\n<|im_end|>", "<|im_end|"), (4, 0, "assistant", "é" * 70_000)]
    turns = spark.createDataFrame([(*r, "w") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    for c in (1, 2, None, 3, 4):
        own = sorted((r for r in rows if r[0] == c), key=lambda r: r[1])
        body = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c].turns_sha256 == hashlib.sha256(body.encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars, got[c].loss_sha256) == (len(own), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|>\\\nim_startend a", max_size=40), st.text(alphabet="<|>\\\nim_startend a", max_size=60))
def test_chat_round_trip(role, text):
    one = chat.render(role, text)
    assert [t[:2] for t in chat.parse(chat.render("a<b", f"{text}<|im_end|>"))] == [("a<b", f"{text}<|im_end|>")]
    assert [t[:2] for t in chat.parse(one + one)] == [(role, text)] * 2
    assert chat.unescape(chat.escape(text)) == text
    with pytest.raises(ValueError):
        chat.parse(one[:-1])


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><div id="top-menu"><a href=a>Home</a> <a href=b>About</a></div>
<nav><ul><li><a href=c>C</a></ul></nav><div class="cookie-notice">We use cookies, and more.</div><div class=body><h2>Head &amp; line</h2><p>First  paragraph, with
text; and more.<p>Sec<b>on</b>d &#233;, a longer one, with commas, and so on.<br>Line.</div><aside>Side, bar, text, and more of it.</aside>
<div class="comments"><p>A reader's comment, long, and with many words, indeed.</div><form>Sign up, now, please.<input></form><footer>&copy; Foot, er.</footer></body></html>"""


def test_html(spark):
    assert html_text.article_text(PAGE) == "Head & line First paragraph, with text; and more. Second é, a longer one, with commas, and so on. Line."
    rows = [(1, "u", PAGE), (2, None, None), (None, "u", ""), (4, "u", "<p>unclosed <b>text, here"), (5, "u", "<" * 1000), (6, "u", "<article>" + "<p>word, word</p>" * 5000 + "</article>")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[2].text == "" and got[None].text == "" and got[4].text == "unclosed text, here" and got[6].n_chars == 5000 * 11 - 1
    assert html_text.extract(df.limit(0)).count() == 0


def sentences(word, n=6):
    return " ".join(f"{word} number {i}, with a comma, and an end." for i in range(n))


def test_html_tags_are_candidates_not_verdicts():
    one, two, teaser = sentences("one"), sentences("two"), "Teaser, short."
    # half of the content outside the tag
    assert html_text.article_text(f"<body><article><p>{one}</p></article><div><p>{two}</p></div></body>") == f"{one} {two}"
    # teasers of other articles beside the article, which is marked or not
    teasers = f"<div><article><h3>{teaser}</h3></article><article><h3>{teaser}</h3></article></div>"
    assert html_text.article_text(f"<body><article><h1>Head</h1><div><p>{one}</p><p>{two}</p></div></article>{teasers}</body>") == f"Head {one} {two}"
    assert html_text.article_text(f"<body><div><p>{one}</p><p>{two}</p></div>{teasers}</body>") == f"{one} {two}"
    assert html_text.article_text(f"<body><main><h1>Head</h1><article><h2>Title</h2><div><p>{one}</p></div></article></main></body>") == f"Title {one}"


def test_html_names_do_not_leave_out_the_article():
    one, two, short = sentences("one"), sentences("two"), sentences("reader", 2)
    for name in ("layout has-sidebar", "no-sidebar", "page-with-comments", "elementor-widget-container", "widget", "page-header"):
        page = f'<body><div class="{name}"><p>{one}</p><p>{two}</p></div><div class="sidebar"><p>{short}</p></div></body>'
        assert html_text.article_text(page) == f"{one} {two}", name
    # what is inside a wrapper that stays goes by its own name; comments longer than the article go too
    page = f'<body><div class="widget"><p>{one}</p><div class="promo"><p>{short}</p></div></div><div class="comments"><p>{two}</p><p>{two}</p></div></body>'
    assert html_text.article_text(page) == one
    # a short article that the page marks goes before an advert, several teasers do not go before the article
    assert html_text.article_text(f'<body><div class="ad">{one}</div><article><h1>Head</h1><p>Short.</p></article></body>') == "Head Short."
    teasers = "<article><h3>Teaser</h3></article>" * 2
    assert html_text.article_text(f'<body><main><h1>Head</h1><div class="widget"><p>{one}</p></div></main>{teasers}</body>') == f"Head {one}"
    page = f'<body><div class="text"><p>{one}</p><div class="promo"><p>{short}</p></div></div><div class="comments"><p>{two}</p><p>{two}</p></div></body>'
    assert html_text.article_text(page) == one


def test_html_paths_are_chosen_by_their_ratios():
    """Without an <article>: paths that read like the text are content whatever their class, short ones outside it are not."""
    one, two, three = sentences("one"), sentences("two"), sentences("three")
    for name in ("share", "related-work", "notice", "social"):
        page = f'<body><ul class="menu"><li>Home<li>About us</ul><div><h2>Head</h2><p>{one}</p><p class="{name}">{two}</p><p>{three}</p></div><div class="{name}">Share this</div><div class="ad">Buy now</div></body>'
        assert html_text.article_text(page) == f"Head {one} {two} {three}", name
        page = f'<body><div><h2>Head</h2><p>{one}</p><section id="{name}"><p>{two}</p></section><p class="{name}">Share this</p><p>{three}</p></div></body>'
        assert html_text.article_text(page) == f"Head {one} {two} {three}", name
    # a page inside a form, and a form inside a page
    assert html_text.article_text(f"<body><form><div><p>{one}</p><p>{two}</p></div></form></body>") == f"{one} {two}"
    assert html_text.article_text(f"<body><div><p>{one}</p><form><p>Sign up, now, please.</p></form><p>{two}</p></div></body>") == f"{one} {two}"
    # a list of links in the text, and a navigation without any name
    links = "".join(f"<li><a href=x>Link {i}, with words</a></li>" for i in range(9))
    assert html_text.article_text(f"<body><ul>{links}</ul><div><p>{one}</p><p>{two}</p></div></body>") == f"{one} {two}"
    # implied end tags are found however deep the line is
    assert html_text.article_text(f"<div><p>{one}" + "<b>" * 500 + f"<p>{two}</div>") == f"{one} {two}"


@pytest.mark.parametrize("page", ['<a "' * 20_000, '<a "' * 20_000 + ">", "<b>" * 100_000, "<div>a, b. " * 50_000, '<div class="ad">a, b. ' * 50_000, "<p>" + "<b>" * 30_000 + "<h1>x</h1>" * 30_000, "<b>" * 50_000 + "</x>" * 50_000, "<!" * 90_000, '<a b="' * 30_000 + '>"' * 30_000, "<ul>" + "<b>" * 20_000 + "<div>x</div>y" * 20_000])
def test_html_is_linear_in_the_page(page):
    import time

    began = time.process_time()
    html_text.article_text(page)
    assert time.process_time() - began < 30


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/!-pbadiv \"'=&;#x1\n", max_size=80))
def test_html_never_fails(page):
    html_text.article_text(page)


def test_leaks(spark):
    r = random.Random(3)
    items = [(i, " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(30))) for i in range(20)]
    filler = [" ".join("".join(r.choice("klmnop") for _ in range(5)) for _ in range(60)) for _ in range(30)]

    def edited(t, n):
        s = list(t)
        for _ in range(n):
            s[r.randrange(len(s))] = "z"
        return "".join(s)

    rows = [(i, filler[i] + " " + (items[i][1].upper() + "!" if i < 5 else edited(items[i][1], 5) if i < 10 else "") + "\n" + filler[i], "s") for i in range(20)]
    rows += [(60, "too Short, so", "s"), (61, "shorts are not", "s"), (50, None, "s"), (51, "", "s"), (None, items[7][1], "s"), (52, " ".join(filler) * 20 + items[3][1], "s"), (3, rows[3][1], "s")]
    bench = spark.createDataFrame([*((i, t, 1) for i, t in items), (90, None, 1), (91, "short", 1), (92, items[0][1], 1), (93, "--", 1)], "item_id long, text string, doc_id int")
    got = {(x.doc_id, x.item_id): x.edits for x in decontamination.find_leaks(make(spark, rows), bench).collect()}
    assert set(got) == {(i, i) for i in range(10)} | {(None, 7), (52, 3), (0, 92), (60, 91)}
    assert all(got[i, i] == 0 for i in range(5)) and all(0 < got[i, i] <= 5 for i in range(5, 10))
    left = {x.doc_id for x in decontamination.without_leaks(make(spark, rows), bench).collect()}
    assert left == {*range(10, 20), 50, 51, 61, None}
    assert decontamination.find_leaks(make(spark, rows).limit(0), bench).count() == 0
    assert decontamination.find_leaks(make(spark, rows), bench.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", min_size=8, max_size=30), st.integers(0, 3), st.randoms(use_true_random=False))
def test_banded_alignment_is_edit_distance(item, n, r):
    s = list(item)
    for _ in range(n):
        k = r.randrange(len(s) + 1)
        s[k : k + r.randint(0, 1)] = r.choice("abc") if r.random() < 0.7 else ""
    region = "ca" + "".join(s) + "bb"
    row = [0] * (len(region) + 1)
    for i, x in enumerate(item):
        new = [i + 1]
        for j, y in enumerate(region):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    hit = decontamination.aligned(decontamination._codes(item), decontamination._codes(region), 4)
    assert (hit[0] if hit else None) == (min(row) if min(row) <= 4 else None)


def test_token_ids_are_the_librarys(spark):
    e = tokens.Encoder(tokens.default_path())
    r = random.Random(2)
    alphabet = [*"ab'sTé 1,.\n\t  <|>", "  ", "\x1c", "\x85", "\xa0", "中", "😀", " \n", "'ll", "<|endoftext|>", "\r\n", "\x00", "a" * 60, "\n\n", "\n\n\n", "word", "über", "it's", "naïve,", "ʼn", "²", "ª", "א", "\u3000", "3.5"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    whole = e.tokenizer.encode_batch(texts, add_special_tokens=False)
    for _ in range(2):  # the second time from the memos
        assert e.encode([*texts, None]) == [*(np.array(x.ids, e.kind).tobytes() for x in whole), b""]
    assert e.by_words and e.encode([]) == []


def test_other_vocabularies_go_through_the_library(tmp_path):
    """A file with another pre-tokenizer is not read word by word."""
    import json

    with open(tokens.default_path()) as f:
        asked = json.load(f)
    asked["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(asked))
    e = tokens.Encoder(str(tmp_path / "other.json"))
    texts = ["a b", "some words, and more\nlines", "", "x  y"]
    assert not e.by_words and e.encode(texts) == [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_the_memo_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    e = tokens.Encoder(tokens.default_path())
    for i in range(20):
        texts = [f"again w{i}a{j} x{j}, {'y' * 99}" for j in range(40)]
        assert e.encode(texts) == [np.array(x.ids, e.kind).tobytes() for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(e.memo) + len(e.old) < 600


def ids_of(text, end):
    e = tokens.encoder(tokens.default_path())
    return np.array([*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files(spark, docs, empty):
    got = token_files.token_files(docs, shard_bytes=4096, segment=500, block=64).orderBy("start").collect()
    at = 0
    for r, (i, t, _) in zip(got, sorted(corpus())):
        w = ids_of(t, 0)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(w), zlib.crc32(w.tobytes()))
        at += len(w)
    assert token_files.token_files(empty).count() == 0
    odd = token_files.token_files(make(spark, [(None, "a", "s"), (5, "b", "s"), (5, "b", "s"), (-3, None, "s")])).orderBy("start").collect()
    assert [(r.doc_id, r.start) for r in odd] == [(None, 0), (-3, 2), (5, 3), (5, 5)]


def test_token_files_of_split_ranges(spark):
    # Batches with ends of their own, repeated ids that lie in different batches, null ids and the ends of a long.
    ids = [*range(2001, 2301), *range(2301, 3001, 7), *range(2100, 2200), *range(-40, 1000, 9), None, *range(2350, 2450), None, (1 << 63) - 1, -(1 << 63)]
    for some in (ids[:-4], [i for i in ids if i is not None]):
        table = spark.createDataFrame([(i, "a b") for i in some], "doc_id long, text string").repartition(7)
        for ranges in (1, 2, 3):
            got = token_files.token_files(table, shard_bytes=300, segment=20, block=64, ranges=ranges).orderBy("start").collect()
            assert [r.doc_id for r in got] == sorted(some, key=lambda i: (i is not None, i or 0))
            assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1]]


def test_shards_ascend_and_do_not_depend_on_the_batch():
    ids = np.array([-(1 << 63), -5, 0, 1000, 1001, 1500, 2000, 2001, 2150, 2301, 2500, 3000, (1 << 63) - 1], np.int64)
    for bounds, part, ends in (([1000, 2000], 2, (0, 13)), ([1000, 2000], 3, (1, 12)), ([], 5, (0, 13)), ([], 2, (2, 12)), ([0], 4, (2, 12))):
        these, bounds = ids[slice(*ends)], np.array(bounds, np.int64)
        args = bounds, part, int(these[0]), int(these[-1])
        whole = token_files.shards_of(these, np.ones(len(these), bool), *args)
        assert (np.diff(whole) >= 0).all() and whole[0] >= 0 and whole[-1] < part * (len(bounds) + 1)
        assert [int(token_files.shards_of(these[i : i + 1], np.array([True]), *args)[0]) for i in range(len(these))] == whole.tolist()
    assert token_files.shards_of(np.zeros(1, np.int64), np.zeros(1, bool), np.array([-9], np.int64), 2, -20, 20).tolist() == [0]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, (1 << 32) - 1), max_size=200), st.sampled_from([1, 7, 8, 64]))
def test_bit_planes_round_trip(ids, block):
    a = np.array(ids, "<u4")
    data = token_files.encode_planes(a, block)
    assert (token_files.decode_planes(data) == a).all()
    for bad in (data[:-1], b"", b"XXXX" + data[4:], data + b"\0"):
        with pytest.raises((ValueError, struct.error, IndexError)):
            token_files.decode_planes(bad)


def test_packing(spark, docs, empty):
    for options in ({}, {"bucket_tokens": 3000}, {"bucket_tokens": 3000, "weights": {"s0": 3.0, "s1": 1.0}, "min_piece": 16}):
        got = packing.pack(docs, window=256, with_ids=True, **options).collect()
        parts, sequences = {}, {}
        for r in got:
            assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            parts.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert {i: b"".join(x for _, x in sorted(p)) for i, p in parts.items()} == {i: ids_of(t, 1).tobytes() for i, t, _ in corpus()}
        for p in sequences.values():
            at = 0
            for offset, length in sorted(p):
                assert offset == at and length > 0
                at += length
            assert at == 256 or at & (at - 1) == 0
    assert packing.pack(empty).count() == 0
    odd = packing.pack(make(spark, [(None, "a", None), (5, "b", "s"), (5, "b", "s")])).collect()
    assert sum(r.length for r in odd) == 6


def test_deficits_keep_the_mixture():
    from collections import Counter, deque

    r = random.Random(0)
    queues = {s: deque([i, r.randint(50, 800), 0] for i in range(n)) for s, n in (("a", 600), ("b", 300), ("c", 100))}
    total = {s: sum(d[1] for d in q) for s, q in queues.items()}
    every = sum(total.values())
    pieces = packing.fill(queues, {s: t / every for s, t in total.items()}, {}, packing.window_sizes(every, 2048), 128)
    done, so_far = Counter(), 0
    for s, _, _, n, w, _ in pieces:
        done[s] += n
        so_far += n
        if w > 5 and so_far < 0.9 * every:
            assert all(abs(done[k] - so_far * total[k] / every) < 2 * 2048 for k in total)
    assert done == total


def test_token_counts(spark, docs, empty):
    from tokenizers import Tokenizer, models, normalizers

    pieces = token_counts.pieces_of(token_counts.default_path())
    model = Tokenizer(models.Unigram(pieces, 0, True))
    model.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs).collect()}
    assert got == {i: len(model.encode(t or "", add_special_tokens=False).ids) for i, t, _ in corpus()}
    r = random.Random(5)
    counter = token_counts.Counter(pieces)
    for _ in range(500):
        t = "".join(r.choice(["a", "b", " ", "é", "\n", "中", "😀", "the", "<0x41>", "▁", "  "]) for _ in range(r.randint(0, 30)))
        assert counter.count(t) == len(model.encode(t, add_special_tokens=False).ids), t
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁", -1.0), ("▁a", -2.0), ("abab", -4.0)]
    plain, counter = Tokenizer(models.Unigram(small, 0, False)), token_counts.Counter(small)
    for _ in range(300):
        t = "▁" + "".join(r.choice("abx▁") for _ in range(r.randint(1, 14)))
        assert counter.count(t[1:].replace("▁", " ")) == len(plain.encode(t).ids), t
    assert token_counts.token_counts(empty).count() == 0


def test_toxicity(spark, empty):
    r = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [r.choice(words) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(r.randint(1, 8)):
                w[r.randrange(40)] = r.choice(["vile", "rotten", "foul"])
        rows.append((i, " ".join(w), "s"))
        if i < 600:
            labels.append((i, 1, int(bad)))
    rows += [(2000, None, "s"), (2001, "", "s"), (None, "vile rotten foul", "s"), (2002, "vile rotten foul " * 5000, "s")]
    table = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.severity(make(spark, rows), table).collect()}
    held = range(600, 900)
    assert sum(got[i].toxic == (i % 5 == 0) for i in held) >= 0.98 * 300
    assert not got[2000].toxic and got[2002].toxic and got[None].toxic and got[2002].expected_severity > 1
    assert all(0 <= x.expected_severity <= toxicity.GRADES for x in got.values())
    assert toxicity.severity(empty, table).count() == 0
    assert not toxicity.severity(make(spark, rows), table.limit(0)).where("toxic").count()
    graded = spark.createDataFrame([(i, int(i % 5 == 0), min(3, rows[i][1].count("vile") + rows[i][1].count("foul"))) for i in range(600)], "doc_id long, toxic int, grade int")
    assert toxicity.severity(make(spark, rows), graded).count() == len(rows)
    # grades that are given stay, though one is missing
    some = graded.withColumn("grade", F.when(F.col("doc_id") != 1, F.when(F.col("toxic") > 0, 1).otherwise(0)))
    assert {x.severity for x in toxicity.severity(make(spark, rows), some).collect()} <= {0, 1}


def test_ordinal_fit_orders_its_cuts():
    r = np.random.default_rng(0)
    x = r.integers(0, 2, (600, 3))
    y = np.minimum(x @ [0, 1, 2], 3)
    rows, cols = np.nonzero(x)
    w, cuts = toxicity.fit_ordinal(rows, cols, y, 3, 3)
    assert (np.diff(cuts) > 0).all() and w[2] > w[1] > abs(w[0])


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_queries_against_sql(spark, data, name):
    assert rows_of(registry.queries()[name](spark, data)) == rows_of_sql(connect(data), registry.oracle_sql()[name])
