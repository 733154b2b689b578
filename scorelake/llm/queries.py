"""The registered queries of this subpackage; each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import bpe, html, imatch, jaccard, langid, linedup, mixing, quality, secrets, toxicity
from scorelake.llm.common import documents, remainder


def vocabulary() -> str:
    """The tokenizer file of the registered queries; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def dictionary() -> list[str]:
    """The words of the registered secret scan; the operator takes any list."""
    import public_tokenizers

    return secrets.dictionary_at(public_tokenizers.path("word_bpe_49k.json"))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = dictionary()
    return secrets.scan(documents(spark, sf_dir).select("doc_id", "text"), secrets.labelled_findings(spark, words), words)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(documents(spark, sf_dir).select("doc_id", "text"), words=5, percent=75)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.judged(documents(spark, sf_dir).select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 3) == 1
    found = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"), ~held, rows=2000)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"), vocabulary())


def op7_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(documents(spark, sf_dir).select("doc_id", "text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = remainder(F.col("doc_id"), 5) == 0
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    found = toxicity.toxicity(documents(spark, sf_dir).select("doc_id", "text"), labels, ~held)
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("_th")


LINE_DEDUP_SQL = r"""
WITH line AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents WHERE text IS NOT NULL),
own AS (
  SELECT doc_id, i, line, row_number() OVER d AS k, lead(line) OVER d AS after
  FROM line WHERE regexp_matches(line, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
piece AS (
  SELECT doc_id, k, 2 AS n, line || chr(10) || after AS chunk FROM own WHERE after IS NOT NULL
  UNION ALL SELECT doc_id, k, 1, line FROM own WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 50),
later AS (SELECT doc_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY n, chunk ORDER BY doc_id, k) AS r FROM piece) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM later, range(0, 2) r(j) WHERE j < n),
runs AS (SELECT doc_id, count(*) AS n FROM (SELECT *, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM gone) WHERE before IS NULL OR before < k - 1 GROUP BY doc_id),
owned AS (SELECT l.*, max(o.k) OVER (PARTITION BY l.doc_id ORDER BY l.i) AS k FROM line l LEFT JOIN own o USING (doc_id, i)),
marked AS (SELECT o.*, g.k IS NOT NULL AS gone FROM owned o LEFT JOIN gone g ON g.doc_id = o.doc_id AND g.k = o.k),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_gone_lines FROM marked GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0)::BIGINT AS n_lines,
  coalesce(n_gone_lines, 0)::BIGINT AS n_gone_lines, coalesce(r.n, 0)::BIGINT AS n_gone_chunks
FROM documents d LEFT JOIN kept k USING (doc_id) LEFT JOIN runs r USING (doc_id)
"""

SUBSETS_SQL = ", ".join(f"{{'a': {at}, 'b': '{bound}'}}" for at, bound in imatch.SUBSETS)
IMATCH_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(text) OVER o, CASE WHEN lead(doc_id) OVER o IS NULL THEN first_value(text) OVER o END, '') AS following,
    coalesce(lead(doc_id) OVER o, first_value(doc_id) OVER o) AS next_id FROM documents WINDOW o AS (ORDER BY doc_id)),
texts AS (
  SELECT doc_id, 0 AS v, t FROM d UNION ALL SELECT doc_id, 1, substr(t, 1, length(t) - length(t) // 4) || substr(following, 1, length(t) // 4) FROM d),
term AS (SELECT doc_id, v, UNNEST(list_distinct(regexp_extract_all(lower(t), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS term FROM texts),
lex AS (
  SELECT term FROM term WHERE v = 0 GROUP BY term
  HAVING count(*) >= 2 AND count(*) >= 0.001::DOUBLE * (SELECT count(*) FROM documents) AND count(*) <= 0.05::DOUBLE * (SELECT count(*) FROM documents)),
sorted AS (
  SELECT doc_id, v, list(md5(term) ORDER BY md5(term)) AS every, list(md5(term) ORDER BY md5(term)) FILTER (WHERE l.term IS NOT NULL) AS inside
  FROM term LEFT JOIN lex l USING (term) GROUP BY doc_id, v),
kept AS (SELECT b.doc_id, b.v, b.t, coalesce(inside, every, [md5(b.t)]) AS kept FROM texts b LEFT JOIN sorted USING (doc_id, v)),
subset AS (SELECT *, list_prepend(kept, list_transform([{SUBSETS_SQL}], lambda s: list_filter(kept, lambda m: substr(m, s.a, 3) < s.b))) AS parts FROM kept),
print AS (SELECT doc_id, v, t, list_transform(parts, lambda p: substr(md5(array_to_string(p, '')), 1, 8)) AS p FROM subset),
pair AS (
  SELECT d.doc_id, a.t, b.t AS edited, a.p AS pa, b.p AS pb, n.p AS pn
  FROM d JOIN print a ON a.doc_id = d.doc_id AND a.v = 0 JOIN print b ON b.doc_id = d.doc_id AND b.v = 1 JOIN print n ON n.doc_id = d.next_id AND n.v = 0),
seen AS (
  SELECT *, list_transform([pb, pn], lambda q: list_filter(list_transform(range(1, len(pa) + 1), lambda i: CASE WHEN pa[i] = 'd41d8cd9' AND q[i] = 'd41d8cd9' THEN NULL ELSE (pa[i] = q[i])::INTEGER END), lambda x: x IS NOT NULL)) AS z FROM pair)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, array_to_string(pa, ',') AS fingerprint, array_to_string(pb, ',') AS edited_fingerprint,
  CASE WHEN pa = pb THEN 1.0::DOUBLE ELSE list_sum(z[1])::DOUBLE / len(z[1]) END AS near_edited, CASE WHEN pa = pn THEN 1.0::DOUBLE ELSE list_sum(z[2])::DOUBLE / len(z[2]) END AS near_next
FROM seen
"""

MIXING_SQL = r"""
WITH RECURSIVE row_ AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS th, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents),
src AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens, count(*) AS texts FROM row_ GROUP BY source),
p AS (SELECT source, tokens / (SELECT sum(tokens) FROM src) AS p FROM src WHERE tokens > 0),
target AS (SELECT sum(-p * ln(p)) + 0.5 * (ln(count(*)) - sum(-p * ln(p))) AS h FROM p),
bisect AS (
  SELECT 0 AS k, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT k + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END
  FROM (SELECT b.*, (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) <= (SELECT h FROM target)
    AND max(pow(p, (lo + hi) / 2) / p) / sum(pow(p, (lo + hi) / 2)) <= 4.0 FROM p) AS good FROM bisect b WHERE k < 45)),
alpha AS (SELECT hi AS a FROM bisect ORDER BY k DESC LIMIT 1),
wanted AS (
  SELECT source, CASE WHEN tokens > 0 THEN pow(tokens / (SELECT sum(tokens) FROM src), (SELECT a FROM alpha) - 1) / (SELECT sum(pow(p, (SELECT a FROM alpha))) FROM p) ELSE 1.0 END AS times,
    ceil(texts / 128)::BIGINT AS blocks FROM src),
placed AS (
  SELECT r.*, times, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || th || ':1:block'), 1, 8))::BIGINT % blocks AS block,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || th || ':1:order'), 1, 8))::BIGINT AS ord
  FROM row_ r JOIN wanted w ON r.source IS NOT DISTINCT FROM w.source),
run AS (
  SELECT *, sum(n_tokens) OVER o AS upto, sum(n_tokens) OVER (PARTITION BY source, block) AS total, rank() OVER o AS place
  FROM placed WINDOW o AS (PARTITION BY source, block ORDER BY ord, doc_id, th)),
used AS (
  SELECT *, floor(times + 1e-6) AS full_, greatest(times - floor(times + 1e-6), 0) AS rest FROM run),
counted AS (SELECT *, (full_ + CASE WHEN rest > 1e-6 AND upto - n_tokens / 2 <= rest * total THEN 1 ELSE 0 END)::INT AS copies FROM used)
SELECT doc_id, source, n_tokens::BIGINT AS n_tokens, UNNEST(range(1, copies + 1))::BIGINT AS epoch, block::BIGINT AS block, place::BIGINT AS place FROM counted WHERE copies > 0
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_id": op4_language_id,
    "op5_html": op5_html,
    "op6_bpe": op6_bpe,
    "op7_imatch": op7_imatch,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_line_dedup": op10_line_dedup,
}

NGRAM_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS g
  FROM w, UNNEST(range(1, greatest(len(ws) - 3, 2))) r(i) WHERE len(ws) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sizes sx ON sx.doc_id = x JOIN sizes sy ON sy.doc_id = y WHERE 100 * o >= 75 * (sx.n + sy.n - o)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.y FROM reach r JOIN edges e ON e.x = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id
"""

QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS x FROM w, UNNEST(range(1, greatest(len(ws) - 6, 1))) r(i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) r(j) GROUP BY doc_id),
base AS (
  SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
  FROM w LEFT JOIN cover c USING (doc_id)),
rates AS (
  SELECT *, n_symbols * 10000 // greatest(word_chars, 1) AS r0, n_dup_lines * 10000 // (n_lines + 6) AS r1, word_chars * 10000 // greatest(n_words, 1) AS r2 FROM base),
cells AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS cell
  FROM (SELECT lang, source, UNNEST([0, 1, 2]) AS rate, UNNEST([r0, r1, r2]) AS v FROM rates WHERE n_words >= 20)),
leveled AS (
  SELECT 2 AS lv, lang, source, rate, cell FROM cells UNION ALL SELECT 1, lang, NULL, rate, cell FROM cells UNION ALL SELECT 0, NULL, NULL, rate, cell FROM cells),
hist AS (SELECT lv, lang, source, rate, cell, count(*) AS n FROM leveled GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, rate ORDER BY cell) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, rate) AS total FROM hist),
quart AS (
  SELECT lv, lang, source, rate, max(total) AS texts, min(cell) FILTER (WHERE upto * 4 >= total) AS q1, min(cell) FILTER (WHERE upto * 4 >= total * 3) AS q3 FROM run GROUP BY ALL),
fence AS (
  SELECT *, CASE WHEN rate = 2 THEN q1 - room ELSE -1 END AS lo, q3 + room AS hi
  FROM (SELECT *, greatest((q3 - q1) * 6, ([300, 2500, 5000])[rate + 1]) AS room FROM quart)),
groups AS (SELECT DISTINCT lang, source FROM cells),
chosen AS (
  SELECT g.lang, g.source, r.rate, arg_max(f.lo, f.lv) AS lo, arg_max(f.hi, f.lv) AS hi
  FROM groups g CROSS JOIN (SELECT UNNEST([0, 1, 2]) AS rate) r
  JOIN fence f ON f.rate = r.rate AND (f.lv = 0 OR f.lang IS NOT DISTINCT FROM g.lang AND f.texts >= 25 AND (f.lv = 1 OR f.source IS NOT DISTINCT FROM g.source))
  GROUP BY ALL),
verdict AS (
  SELECT b.doc_id, bool_and(coalesce(([r0, r1, r2])[c.rate + 1] BETWEEN c.lo AND c.hi, true)) AS inside
  FROM rates b LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM b.lang AND c.source IS NOT DISTINCT FROM b.source GROUP BY b.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND inside AS kept
FROM rates JOIN verdict USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_jaccard": NGRAM_JACCARD_SQL,
    "op3_quality_rules": QUALITY_SQL,
    "op7_imatch": IMATCH_SQL,
    "op9_mixing": MIXING_SQL,
    "op10_line_dedup": LINE_DEDUP_SQL,
}
