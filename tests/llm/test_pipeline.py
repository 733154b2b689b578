import random
from collections import Counter

import corpus_pipeline
import pyspark.sql.types as T
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql, queries
from scorelake.llm import mixing
from tests.llm.conftest import prose, table
from tests.llm.test_bpe import REF
from tests.llm.test_jaccard import brute
from tests.llm.test_native import WORD, base, plain_dedup


def test_stages_keep_columns_and_rules(spark, odd, empty):
    rng = random.Random(1)
    texts = [prose(rng, 120) for _ in range(40)]
    texts += [t + " more words here" for t in texts[:6]] + ["short", None, "w " * 50]
    docs = table(spark, texts).unionByName(odd)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, "")
        if k < 4:
            assert out.columns == docs.columns
            kept = spark.createDataFrame(out.collect(), docs.schema)
    ids = {r.doc_id for r in kept.collect()}
    assert ids <= set(range(len(texts))) | {None} and not ids & {46, 47, 48}
    assert not ids & set(range(40, 46))  # near copies of the first six
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_every_stage_against_plain_python(spark):
    """Quality, dedup, duplicates and BPE exactly; the mix against its own plan, which is held against SQL elsewhere."""
    rng = random.Random(5)
    shared = "\n".join(prose(rng, 14) for _ in range(6))
    texts = [f"{prose(rng, rng.randrange(10, 90))}\n{prose(rng, 9)}" for _ in range(25)]
    texts += [f"{t}\n{shared}" for t in texts[:8]] + [" ".join(["loop"] * 60), texts[9] + " and more", texts[10]]
    docs = table(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    (_, rules), (_, dedup), (_, near), (_, mix), (_, encode) = corpus_pipeline.STAGES
    rows = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    kept = [(i, t) for i, t in enumerate(texts) for b in [base(t)] if b[0] >= 20 and 100 * b[4] <= 30 * b[0]]
    one = rules(spark, docs, "").cache()
    assert rows(one) == kept
    left = [(i, new) for (i, old), (new, gone) in zip(kept, plain_dedup([t for _, t in kept]), strict=True) if not gone or WORD.search(new)]
    two = dedup(spark, one, "").cache()
    assert rows(two) == left and all(r.n_chars == len(r.text) for r in two.collect())
    first = [x for x, (_, g) in zip(left, brute([t for _, t in left]), strict=True) if left[g] == x]
    three = near(spark, two, "").cache()
    assert rows(three) == first
    times = Counter(r.doc_id for r in mixing.plan(three).collect())
    four = mix(spark, three, "").cache()
    assert Counter(r.doc_id for r in four.collect()) == times and set(rows(four)) <= set(first)
    five = encode(spark, four, "").collect()
    known = dict(first)
    assert sorted((r.doc_id, r.n_tokens) for r in five) == sorted((i, len(REF.encode(known[i], add_special_tokens=False).ids)) for i in times.elements())


def test_no_scrap_of_an_exact_copy_is_left(spark):
    """Copies of texts of many lines and of single short lines, which have no chunk."""
    rng = random.Random(6)
    texts = ["\n".join(prose(rng, rng.randrange(8, 20)) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    assert any("\n" not in t for t in texts[:30])
    docs = table(spark, texts + texts[:30] + texts[:3]).unionByName(table(spark, texts[:2], 5000))
    again = docs.unionByName(docs.where("doc_id in (7, 47)"))
    got = sorted((r.doc_id, r.text) for r in corpus_pipeline.line_dedup(spark, again, "").collect())
    assert got == sorted([*enumerate(texts), (7, texts[7])])


def test_near_copies_without_an_id_go(spark):
    rng = random.Random(7)
    a, b = prose(rng, 60), prose(rng, 60)
    docs = table(spark, [a, b]).selectExpr("*", "1 as `a.b`")
    nulls = docs.where("doc_id = 0").selectExpr("cast(null as long) as doc_id", *[f"`{c}`" for c in docs.columns if c != "doc_id"])
    lone = nulls.withColumn("text", F.lit(prose(rng, 60)))
    near = lone.withColumn("text", F.concat("text", F.lit(" and more")))
    got = corpus_pipeline.near_duplicates(spark, docs.unionByName(nulls).unionByName(lone).unionByName(near), "")
    rows = got.collect()
    assert got.columns == docs.columns and len(rows) == 3 and sorted(r.doc_id for r in rows if r.doc_id is not None) == [0, 1]


def test_run_over_a_folder(spark, tmp_path):
    rng = random.Random(2)
    docs = table(spark, [prose(rng, 60) for _ in range(30)]).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.count() > 20 and isinstance(got.schema["n_tokens"].dataType, T.LongType)


def test_registered_names():
    names = set(queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names if x.startswith("op")} and "pipeline" in names
    assert set(oracle_sql()) <= names
