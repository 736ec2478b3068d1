import math
import re
import time

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import html_text, pii, quality

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav>
<div class="cookie-notice">We use cookies.</div><script>if (a<b) document.write("<p>no</p>")</script><aside>Side</aside><form><label>Name</label><input></form>
%s<div id="comments"><p>First!</p><p>A long reader comment, longer than anything else on the page, that says a great deal of nothing at all.</p></div><footer>&copy; me</footer></body></html>"""
BODY = '<h1>Head &amp; title</h1><p>One <b>bold</b>\n  word<br>next.<p>Two &lt;x&gt; <a href="/y">link</a><ul><li>a<li>b</ul><div class="ad-box">Buy</div><blockquote>Q</blockquote>'
TEXT = "Head & title\nOne bold word next.\nTwo <x> link\na\nb\nQ"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='post'>%s</div>", "<main><div><article>%s</article></div><aside>x</aside></main>"])
def test_article(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)) == TEXT


def test_article_in_sections():
    parts = [[f"{s}{p} " + "word " * n + "end." for p in "abcde"] for s, n in (("x", 40), ("y", 30), ("z", 38))]
    sections = "".join("<section>" + "".join(f"<p>{p}</p>" for p in part) + "</section>" for part in parts)
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Menu item {i}</a></li>' for i in range(12)) + "</ul>"
    assert html_text.main_text(PAGE % f"{menu}<div class='post'><h1>Title</h1>{sections}</div>") == "\n".join(["Title", *sum(parts, [])])


def test_links_beside_a_marked_article():
    menu = "<div><h3>More</h3><ul>" + "".join(f'<li><a href="/{i}">Another story {i}</a></li>' for i in range(12)) + "</ul></div>"
    parts = [f"{p} " + "word " * 40 + "end." for p in "abcde"]
    article = "<article>" + "".join(f"<p>{p}</p>" for p in parts) + '<ul><li><a href="/s">Source</a></li></ul></article>'
    assert html_text.main_text(PAGE % f"<main><h1>Title</h1>{article}{menu}<p>By <b>me</b></p></main>") == "\n".join(["Title", *parts, "Source", "By me"])


LINE = "Some words that make a paragraph of a fair length, so that it counts as text."
PARAGRAPHS = f"<p>One. {LINE}</p><p>Two. {LINE}</p>"
BOTH = f"One. {LINE}\nTwo. {LINE}"


@pytest.mark.parametrize("page, text", [
    (f'<article class="post has-sidebar">{PARAGRAPHS}</article>', BOTH), (f'<article class="tag-menu hentry">{PARAGRAPHS}</article>', BOTH), (f'<div id="page" class="with-sidebar"><main>{PARAGRAPHS}</main></div>', BOTH),
    (f'<div class="social-science">{PARAGRAPHS}</div>', BOTH), (f'<article><p>Zero.</p><section class="related-work">{PARAGRAPHS}</section></article>', f"Zero.\n{BOTH}"),
    ("<article><h2>T</h2><p>one</p></article><article><h2>U</h2><p>two</p></article>", "T\none\nU\ntwo"), (f"<form><div>{PARAGRAPHS}<input></div></form><div>(c) me</div>", BOTH), (f'<div class="widget"><div class="nav">x</div>{PARAGRAPHS}</div>', BOTH),
    (f'<p>Short news.</p><div id="comments"><article class="comment">{PARAGRAPHS * 9}</article></div>', "Short news."), (f'<aside><article class="teaser"><p>{LINE}</p></article></aside><article>{PARAGRAPHS}</article>', BOTH),
    ('<div class="nav">' * 3000 + LINE, LINE),
])
def test_hints(page, text):
    assert html_text.main_text(page) == text


def brute_choice(root):
    """The node of the largest density sum above the threshold, from the formula, by plain recursion."""

    def walk(n):
        return [n] + [x for c in n.children if not isinstance(c, str) for x in walk(c)]

    def text(n, links=False):
        return sum((len(" ".join(c.split())) if not links else 0) if isinstance(c, str) else text(c, links and c.tag != "a") for c in n.children)

    def density(n):
        c, t = text(n), len(walk(n))
        lc = text(n) if n.tag == "a" else text(n, True)
        lt = sum(x.tag == "a" for x in walk(n))
        if not c:
            return 0.0
        inner = math.log(c / max(c - lc, 1) * lc + text(root, True) / max(text(root), 1) * c + math.e)
        return c / t * max(math.log(c / max(lc, 1) * t / max(lt, 1)), 0) / (max(math.log(inner), 1e-9) if inner > 1.0001 else 1e-4)

    nodes = [n for n in walk(root) if text(n)]
    densest = max(nodes, key=density)
    path, n = [], densest
    while n is not None:
        path.append(density(n))
        n = n.parent
    total = lambda n: sum(density(c) for c in n.children if not isinstance(c, str)) or density(n)
    best = max((total(n) for n in nodes if density(n) >= min(path)), default=None)
    return min(path), best, total


@given(st.recursive(st.sampled_from(["word", "a longer piece of text, with some words", ""]), lambda kids: st.tuples(st.sampled_from(["div", "a", "span", "section"]), st.lists(kids, max_size=4)), max_leaves=25))
def test_density_against_brute_force(tree):
    def write(x):
        return x if isinstance(x, str) else f"<{x[0]}>{''.join(map(write, x[1]))}</{x[0]}>"

    root = html_text.parse(write(tree))
    order = [n for n in html_text.measure(root) if n.chars]
    if not order:
        assert html_text.article(root) == []
        return
    threshold, best, total = brute_choice(root)
    assert all(math.isclose(n.sum, total(n), abs_tol=1e-9) for n in order)
    above = [n for n in order if n.density >= threshold - 1e-12]
    assert math.isclose(max(n.sum for n in above), best, abs_tol=1e-9)
    chosen, = html_text.article(root)
    node = max(above, key=lambda n: n.sum)
    while node is not None and node is not chosen:  # what is taken is the choice or what holds it
        node = node.parent
    assert node is chosen


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<!-- b", "a"), ("<script>x", ""), ("<p>a</p", "a"), ("<div><p>x &eacute;&nbsp; y</p></div>", "x é y"), ("</p></div>", ""), ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE % f"<article>{BODY}</article>", "z"), (None, None, None, None), (1, "u", "", "z"), (2, "deep", "<div>" * 3000 + "x", "z")], "page_id long, url string, html string, text string")
    rows = html_text.extract(df).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in rows) == sorted([("1", len(TEXT)), ("None", 0), ("1", 0), ("2", 1)]) and html_text.extract(df.limit(0)).count() == 0


def brute_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[ -]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@given(st.text(alphabet="ab01.25@+- (%_é4", max_size=60))
def test_base_detectors(text):
    assert pii.detect(text) == brute_spans(text)


@given(st.lists(st.sampled_from(["a.b@c.de", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "+1 (415) 555-2671", "+", "@", ".", " ", "x", "1", "-", "b@c.d_e@f.g"]), max_size=12).map("".join))
def test_base_detectors_on_pieces(text):
    assert pii.detect(text) == brute_spans(text)
    found = pii.spans(text)
    assert {(s, k, e) for s, k, e, b in found if b} == set(brute_spans(text)) and all(0 <= s < e <= len(text) for s, _, e, _ in found)


@pytest.mark.parametrize("text, masked", [
    ("mail john.doe [at] example [dot] com now", "mail [EMAIL] now"), ("jane at corp dot example dot org", "[EMAIL]"), ("аdmin@exаmple.com", "[EMAIL]"), ("tel ＋1 (415) 555-2671", "tel [PHONE]"), ("x​@​mail.com", "[EMAIL]"),
    ("+one four one five, five five five one two one two", "[PHONE]"), ("+1 four one five 555 1212 ok", "[PHONE] ok"), ("we met at noon. dot the i's, one two three", "we met at noon. dot the i's, one two three"), ("", ""), ("İ at x", "İ at x"),
])
def test_disguises(text, masked):
    assert pii.masked_text(text) == masked


@pytest.mark.parametrize("text, masked", [
    ("tel +1 4 one 5 5 five 5 2 six 7 one ok", "tel [PHONE] ok"), ("tel +one 4 one 5 5 five 5 2 six 7 1 ok", "tel [PHONE] ok"), ("card 4 one 1 one 1111 1 one 1, one 111 one.", "card [CARD]."), ("host 192.168.one.7 up", "host [IP] up"), ("host 1.two.3.four", "host [IP]"),
    ("+1 (four 1 five) 555-26 seven 1", "[PHONE]"), ("call +1 415 555 2671, one more time", "call [PHONE], one more time"), ("in 2010 one of 3 men had 4, one 5", "in 2010 one of 3 men had 4, one 5"), ("chapter 1. one day", "chapter 1. one day"),
])
def test_words_between_figures(text, masked):
    assert pii.masked_text(text) == masked


@pytest.mark.parametrize("text, masked", [
    ("john at example.it", "[EMAIL]"), ("user at sub.example.co.jp now", "[EMAIL] now"), ("john @ example . com", "[EMAIL]"), ("bob @example.com", "[EMAIL]"), ("john@example dot com", "[EMAIL]"), ("a dot b at c dot de. then", "[EMAIL]. then"),
    ("192 dot 168 dot 1 dot 1", "[IP]"), ("host 192 . 168 . 1 . 1", "host [IP]"), ("host 10 [.] 0 [.] 0 [.] 7", "host [IP]"), ("find us at example.org", "find us at example.org"), ("look at home.It was", "look at home.It was"),
    ("price @ 3.50 us, at st. petersburg", "price @ 3.50 us, at st. petersburg"), ("at 5.30 pm, at fig. 3", "at 5.30 pm, at fig. 3"),
])
def test_plain_disguises(text, masked):
    assert pii.masked_text(text) == masked


@pytest.mark.parametrize("piece", ["a dot ", "a at ", "a at b dot ", "a at b.c", "@ ", "1 dot ", "one ", "one 1 ", "[at]", "1 one.", "+1 "])
def test_time_follows_length(piece):
    def seconds(n):
        text, began = piece * (n // len(piece)), time.perf_counter()
        pii.spans(text)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(1_000_000) < 60 * (seconds(50_000) + 0.02)


def test_long_digits_end():
    assert pii.spans("1" * 200_000 + "." * 1000 + "a" * 100_000) == []


def test_pii_rows(spark, hard):
    rows = pii.find(hard).collect()
    assert len(rows) == hard.count() and pii.find(hard.limit(0)).count() == 0
    out = pii.redact(hard)
    assert out.columns == hard.columns and out.where("text IS NULL").count() == hard.where("text IS NULL").count()


def test_quality(spark, hard):
    rng = np.random.default_rng(0)
    words = [f"{a}{b}" for a in ("ab", "cd", "ef", "gh") for b in ("in", "ou", "er", "st")]
    rows = []
    for i in range(400):
        w = list(rng.choice(words, 40))
        rows.append((i, " ".join(w) if i % 2 else " ".join(x + "!!!" for x in w), i % 2))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None), (900, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    held = [(r.predicted, i % 2) for i, r in got.items() if r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    assert (quality.train(docs, flipped)[0] == model[0]).all()  # held-out labels are not learnt from
    scores = quality.score(hard, model).collect()
    assert len(scores) == hard.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scores)
    none = quality.train(docs, labels.limit(0))
    assert {r.score for r in quality.score(hard, none).collect()} == {0.5} and quality.score(hard.limit(0), none).count() == 0
    assert quality.keep_good(hard, none).count() == hard.count()
