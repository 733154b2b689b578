"""Language identification, toxicity and HTML extraction."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import html, langid, toxicity
from scorelake.llm.common import remainder
from tests.llm.conftest import prose, table

SYLLABLES = {"en": "the and ing tion er of with wh", "de": "der und ung sch ein ver ich tz", "fr": "les que eau oi ment aux re en", "es": "los que ción ado mente as ñ ll"}


def spoken(rng, lang, n):
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(1)
    rows = [(i, spoken(rng, lang, rng.randrange(5, 60)), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = remainder(F.col("doc_id"), 3) == 1
    got = {r.doc_id: r for r in langid.identify(docs, ~held).collect()}
    out = [got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(out) > 100 and np.mean(out) > 0.95 and all(0 <= r.score <= 1 for r in got.values())


def test_languages_of_odd_rows(odd, odd_texts, empty):
    rows = langid.identify(odd, F.lit(True)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r.doc_id is not None:
            letters = any(c.isalpha() for c in odd_texts[r.doc_id] or "")
            assert (r.lang_pred == "en") == letters and (r.lang_pred == "und") == (not letters) and 0 <= r.score <= 1
    assert all(r.lang_pred == "und" for r in langid.identify(odd, F.lit(False)).collect())
    assert langid.identify(empty, F.lit(True)).collect() == []


def test_gram_counts_of_blocks_add_up(monkeypatch):
    text = spoken(random.Random(2), "fr", 3000)
    whole = langid.gram_counts(text)
    monkeypatch.setattr(langid, "BLOCK", 1000)
    assert (langid.gram_counts(text) == whole).all()


def test_factorization_machine_learns_meetings():
    """Two words that are harmless alone and toxic together: no additive weights can do that."""
    rng = random.Random(3)
    texts, label = [], []
    for _ in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([prose(rng, 10, 60)] + ["insult"] * a + ["group"] * b))
        label.append(float(a and b))
    terms = list(toxicity.hashed_terms(texts, toxicity.BITS))
    cut = 2400
    m = toxicity.Machine()
    join = lambda x: (np.concatenate(x), np.array([len(t) for t in x]))
    m.fit(*join(terms[:cut]), np.array(label[:cut]), float(np.mean(label[:cut])))
    right = (m.score(*join(terms[cut:])) >= 0) == np.array(label[cut:], bool)
    assert right.mean() > 0.97


@pytest.mark.parametrize("toxic", [lambda a, b: a != b, lambda a, b: a == b])
def test_factorization_machine_learns_words_that_tell_nothing_alone(toxic):
    """Toxic iff exactly one of two words is there, or iff both or none: neither word's own share is off."""
    rng = random.Random(3)
    texts, label = [], []
    for _ in range(4000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join([prose(rng, 10, 60)] + ["insult"] * a + ["group"] * b))
        label.append(float(toxic(a, b)))
    terms = list(toxicity.hashed_terms(texts, toxicity.BITS))
    m = toxicity.Machine()
    join = lambda x: (np.concatenate(x), np.array([len(t) for t in x]))
    m.fit(*join(terms[:3200]), np.array(label[:3200]), float(np.mean(label[:3200])))
    assert ((m.score(*join(terms[3200:])) >= 0) == np.array(label[3200:], bool)).mean() > 0.97


def test_samples_keep_their_bounds(spark):
    """Ids that repeat very often, with equal and with different texts, and very many languages."""
    rng = random.Random(8)
    rows = [(i % 3, f"same id {i % 40}", "en") for i in range(600)] + [(None, "no id", "en")] * 200 + [(1000 + i, spoken(rng, "de", 9), f"l{i % 90}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    x, lang = langid._sample(docs, F.lit(True), 100)
    assert 0 < len(lang) <= 100 and len(x) == len(lang)
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 2)] * 50 + [(1000 + i, i % 2) for i in range(900)], "doc_id long, toxic int")
    _, sizes, label, share = toxicity._sample(docs, labels, F.lit(True), 20, 30)
    assert label.sum() <= 20 and len(label) - label.sum() <= 30 and len(sizes) > 40 and abs(share - 0.5) < 0.01


def test_toxicity(spark):
    rng = random.Random(4)
    bad = ["idiot", "moron", "scum"]
    rows = [(i, " ".join([prose(rng, 40)] + [rng.choice(bad) for _ in range(3)] * t), int(t)) for i in range(1200) for t in [rng.random() < 0.2]]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t, 1) for i, _, t in rows[:800]], "doc_id long, toxic int, quality int")
    held = remainder(F.col("doc_id"), 5) == 0
    got = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels, ~held).collect()}
    assert np.mean([(got[i] >= 0.5) == t for i, _, t in rows]) > 0.95


def test_toxicity_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(7, 1), (8, 0), (3, None), (None, 1), (7, 1)], "doc_id long, toxic int")
    rows = toxicity.toxicity(odd, labels, F.lit(True)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = toxicity.toxicity(odd, labels.limit(0), F.lit(True)).collect()
    assert len(nothing) == odd.count()
    assert toxicity.toxicity(empty, labels, F.lit(True)).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>No</title><script>var x = "</p><p>no";</script><style>p{}</style></head><body>
<div class="cookie-notice">We use cookies</div><header><h1>Site</h1></header><nav><ul><li><a href="/a">menu</a></li></ul></nav>
<aside>side <b>bar</b></aside><article><header><h1>A &amp; B</h1></header><p>One   two<br>three <i>four</i>&nbsp;five</p><!-- no --><p class="lead">a &lt; b &copy
<div class="comments"><p>first!</p></div><form><input value=no><label>no</label></form><ul><li>x<li>y</ul><footer>tags</footer></article>
<div id="sidebar">more</div><footer>&copy; site</footer></body></html>"""


def test_article_text():
    assert html.main_text(PAGE, None) == "A & B\nOne two three four five\na < b ©\nx\ny"


@pytest.mark.parametrize("attrs", ['style="overflow:hidden"', 'class="side-by-side"', 'data-class="ad"', 'id="search-methods"', "title='class=ad'", 'class="header-text main"'])
def test_parts_that_only_look_like_notices_stay(attrs):
    assert html.main_text(f"<body><article><p>one</p><div {attrs}><p>two</p></div></article></body>", None) == "one\ntwo"


@pytest.mark.parametrize("attrs", ["hidden", 'class="ad"', "class=ad-banner", 'class="x comment-list"', 'id="cookie_notice"', 'aria-hidden="true"', "role=complementary", 'class="a&#100;"'])
def test_parts_that_are_not_the_article_go(attrs):
    assert html.main_text(f"<body><article><p>one</p><div {attrs}><p>two</p></div><p>three</p></article></body>", None) == "one\nthree"


def test_comments_that_are_articles_and_headers_in_articles():
    page = "<body><article><header><h1>T</h1><p>By me</p></header><p>one two three</p></article><article class='comment'><p>first! a b c d e f g</p></article></body>"
    assert html.main_text(page, None) == "T\none two three"


def test_broken_pages():
    for page, want in (("", ""), ("plain text", "plain text"), ("<article><p>a<p>b", "a\nb"), ("<article><p>a</p><scr", "a"), ("<p>a < b</p>", "a < b"), ("<script>x", ""), ("</div></p>a", "a"), ("<article><p>x<!-- y", "x"), ("<article><p>a</p><script>b", "a")):
        assert html.main_text(page, None) == want


def host_pages(n, host, article):
    rng = random.Random(n)
    out = []
    for i in range(n):
        body = "".join(f"<p>{prose(rng, 12)}</p>" for _ in range(3))
        main = f"<article>{body}</article>" if article else f'<div class="box">Welcome to the site</div><div class="text">{body}</div><div class="box">Read more here</div>'
        out.append((f"http://{host}/p/{i}", f"<html><body><div class='top'>Top words</div>{main}</body></html>", "\n".join(b for b in body.replace("</p>", "").split("<p>") if b)))
    return out


def test_templates_find_the_main_slots(spark):
    pages = host_pages(9, "a.example", True) + host_pages(8, "b.example", False) + host_pages(1, "c.example", True)
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert [got[i] for i in range(len(pages))] == [t for _, _, t in pages]
    found = {r.host: r for r in html.templates(df).collect()}
    assert set(found) == {"a.example", "b.example"} and len(found["b.example"].known) == 3
    assert html.path_hash("/html/body/div.text") in {n.token for n in found["b.example"].nodes}


def plain_templates(pages, least=3):
    """(host: known texts, mean slot text of each container) from the occurrence vectors themselves."""
    by_host, small = defaultdict(list), []
    for url, page in pages:
        by_host[html.host_of(url)].append(page)
    for host in [h for h, p in by_host.items() if len(p) < least]:
        small += by_host.pop(host)
    out = {}
    for host, own in [*by_host.items(), *([(None, small)] if len(small) >= least else [])]:
        vectors, chars, kinds, around = defaultdict(lambda: [0] * len(own)), Counter(), {}, {}
        for i, page in enumerate(own):
            vectors["", None][i] = 1
            kinds["", None] = True
            for b in html.blocks(page):
                key = (b.path, b.text or None)
                if b.text and b.off:
                    continue
                vectors[key][i] += 1
                if b.text and not b.header:
                    chars[key] += b.free
                kinds[key] = not b.off and not b.header
                around[key] = (b.path, None)
        on = {k: sum(x > 0 for x in v) for k, v in vectors.items()}
        tags = {tuple(v) for k, v in vectors.items() if k[1] is None}
        known = {k for k, v in vectors.items() if k[1] and host is not None and on[k] >= least and 2 * on[k] >= len(own) and tuple(v) in tags}
        slots = Counter()
        for k, n in chars.items():
            if k not in known:
                for i in range(k[0].count("/") + 1):
                    slots["/".join(k[0].split("/")[: i + 1])] += n
        nodes = {k[0]: slots[k[0]] / on[k] for k in vectors if k[1] is None and kinds[k] and on[k] >= least and 10 * on[k] >= len(own)}
        out[host] = ({html.text_hash(*k) for k in known}, {html.path_hash(p): v for p, v in nodes.items()})
    return out


def test_templates_against_brute_force(spark):
    rng = random.Random(13)
    pages = []
    for i in range(60):
        items = "".join(f"<li><a href='/{k}'>{prose(rng, 1)}</a> {prose(rng, 1)}</li>" for k in range(rng.choice([2, 2, 5])))
        fixed = "<div class='box'>Welcome to us</div>" * (i % 4 > 0)
        text = "".join(f"<p>{prose(rng, rng.randrange(1, 30))}</p>" for _ in range(rng.randrange(4)))
        where = rng.choice(["div class='text'", "article", f"section id='post-{i}'"])
        pages.append((f"http://h{rng.choice([0, 0, 1, 2, 2, 2, 10 + i])}.example/{i}", f"<html><body><nav>{prose(rng, 2)}</nav><ul>{items}</ul>{fixed}<{where}>{text}</{where.split()[0]}><p>Bye</p></body></html>"))
    rows = [(i, u, h) for i, (u, h) in enumerate(pages)]
    got = {r.host: (set(r.known or ()), {n.token: n.within for n in r.nodes}) for r in html.templates(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    want = plain_templates(pages)
    assert set(got) == set(want) and None in got and len(got) > 3
    for host, (known, nodes) in want.items():
        assert got[host][0] == known and set(got[host][1]) == set(nodes)
        assert all(abs(got[host][1][k] - v) < 1e-9 for k, v in nodes.items())


def test_pages_without_a_body_tag_have_templates(spark):
    rng = random.Random(14)
    text = [prose(rng, 30) for _ in range(6)]
    rows = [(i, f"http://n.example/{i}", f"<div class='top'>Menu of the site</div><div class='story'><p>{t}</p></div><div class='end'>{prose(rng, 2)}</div>") for i, t in enumerate(text)]
    assert [r.text for r in sorted(html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())] == text


def test_templates_decide_on_pages_with_articles(spark):
    """A notice inside every article, teaser cards that are articles beside the text, and a long text that all pages have."""
    rng = random.Random(12)
    fixed, rows, want = prose(rng, 90), [], []
    for i in range(24):
        text = [prose(rng, 25) for _ in range(3)]
        body = "".join(f"<p>{b}</p>" for b in text)
        page = (
            f"<article><div class='box'>Rate this story now</div>{body}<p>All rights held</p></article>",
            f"<div class='text'>{body}</div><article><p>{prose(rng, 4)}</p></article>",
            f"<div class='about'>{fixed}</div><div class='text'>{body}</div>",
        )[i % 3]
        rows.append((i, f"http://h{i % 3}.example/{i}", f"<html><body><div class='top'>Top words</div>{page}</body></html>"))
        want.append("\n".join(text))
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert [got[i] for i in range(24)] == want


def test_odd_pages(spark, monkeypatch):
    rows = [(1, None, None), (2, "http://[bad", "<p>x</p>"), (3, "http://h/", ""), (3, "http://h/", "<p>" + "long " * 100_000), (None, "http://h/", "<p>y</p>")]
    df = spark.createDataFrame([(*r, "h", [1], "m") for r in rows], "page_id long, url string, html string, host string, known array<int>, main string")
    want = sorted([(1, ""), (2, "x"), (3, ""), (3, " ".join(["long"] * 100_000))])
    for limit in (html.MOST_SENT, -1):  # broadcast, then joined by host
        monkeypatch.setattr(html, "MOST_SENT", limit)
        got = [(r.page_id, r.text) for r in html.extract(df).collect()]
        assert sorted(x for x in got if x[0]) == want and [t for i, t in got if i is None] == ["y"]
    assert html.extract(df.limit(0)).collect() == []
