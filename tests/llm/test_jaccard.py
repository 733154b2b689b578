import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scorelake.llm import jaccard
from scorelake.llm.components import components
from scorelake.llm.jaccard import jaccard_components
from scorelake.llm.shingles import shingle_sets
from tests.llm.conftest import prose, table


def sets_of(texts):
    out = []
    for t in texts:
        w = (t or "").encode().lower().split()
        out.append(frozenset([tuple(w)] if 0 < len(w) < 5 else (tuple(w[i : i + 5]) for i in range(len(w) - 4))))
    return out


def brute(texts):
    """The least position reachable from each text by links."""
    s = sets_of(texts)
    group = list(range(len(s)))
    for i in range(len(s)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= 75 * (len(s[i]) + len(s[j]) - both):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    return [(len(x), g) for x, g in zip(s, group, strict=True)]


def near(rng, text, edits):
    w = text.split(" ")
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def found(spark, texts):
    rows = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(table(spark, texts)).collect()}
    return [rows[i] for i in range(len(texts))]


def test_against_brute_force(spark):
    rng = random.Random(1)
    texts = []
    for size in (3, 5, 6, 12, 60, 200):
        for _ in range(6):
            base = prose(rng, size)
            texts += [base, base.upper(), *(near(rng, base, k) for k in (1, 1, 2, 3, 5))]
    rng.shuffle(texts)
    assert found(spark, texts) == brute(texts)


def test_chains_and_a_large_group_of_near_copies(spark):
    rng = random.Random(2)
    base = prose(rng, 120)
    texts = [near(rng, base, rng.randrange(7)) for _ in range(150)]
    link = prose(rng, 100)
    for _ in range(12):  # each near the one before, the ends far apart
        link = near(rng, link, 1)
        texts.append(link)
    common = prose(rng, 25)
    texts += [f"{common} {prose(rng, 25)}" for _ in range(60)]
    assert found(spark, texts) == brute(texts)


def test_heavy_shingles_change_nothing(spark, monkeypatch):
    """Passages that most texts share, in texts that are no copies of each other but made of the same parts."""
    rng = random.Random(4)
    parts = [prose(rng, 30, 5000) for _ in range(9)]
    texts = [" ".join(rng.sample(parts, 4)) for _ in range(90)] + [f"{parts[0]} {prose(rng, 12)}" for _ in range(120)]
    want = brute(texts)
    calls = []
    real = jaccard.heavy_shingles
    monkeypatch.setattr(jaccard, "heavy_shingles", lambda *a: calls.append(real(*a)) or calls[-1])
    monkeypatch.setattr(jaccard, "ENOUGH", 5)
    monkeypatch.setattr(jaccard, "IN_PART", 1000)
    assert found(spark, texts) == want
    assert len(calls[0][0]) > 20 and calls[0][2] > 5000


def test_threshold_is_exact(spark):
    words = [f"a{i}" for i in range(400)]
    texts = []
    for n, cut in ((11, 2), (12, 2), (20, 3), (32, 7), (32, 8), (60, 14), (60, 15)):
        texts += [" ".join(words[:n]), " ".join([*words[: n - cut], *(f"z{n}{cut}{i}" for i in range(cut))])]
    assert found(spark, texts) == brute(texts)


def test_odd_rows(spark, odd, odd_texts, empty):
    rows = jaccard_components(odd).collect()
    assert len(rows) == odd.count()
    want = brute(odd_texts)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in rows if r.doc_id is not None)
    assert [r.component_id for r in rows if r.doc_id is None] == [7]
    assert jaccard_components(empty).collect() == []


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB éÉ\n\t\x0b\x1c ", max_size=40)), max_size=6))
def test_shingle_sets_have_the_sizes_of_word_tuples(texts):
    got = list(shingle_sets(texts))
    want = sets_of(texts)
    assert [len(s) for s in got] == [len(s) for s in want]
    for a, x in zip(got, want, strict=True):
        for b, y in zip(got, want, strict=True):
            assert len(set(a) & set(b)) == len(x & y)


def test_a_word_longer_than_a_block():
    long = "y" * (3 << 20)
    a, b = shingle_sets([f"a b c d {long} e f", f"a b c d {long} e g"])
    assert len(a) == len(b) == 3 and len(set(a) & set(b)) == 2


def test_too_many_words_are_refused():
    with pytest.raises(ValueError):
        list(shingle_sets(["a"], 99))


def test_grouping_is_by_content_alone():
    by = defaultdict(set)
    for s, t in zip(shingle_sets(["a b c d e f"] * 3 + ["a  b c\nd e F"]), "0123", strict=True):
        by[s.tobytes()].add(t)
    assert len(by) == 1
