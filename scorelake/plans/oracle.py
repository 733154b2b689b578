"""The same queries as SQL, for a second engine to compare with."""

from __future__ import annotations

from dataclasses import asdict

from scorelake.config import Normalization
from scorelake.plans.tables import CENTROIDS, DIMS, EVERY, PARAMS, RISK


def l2(a: str, b: str, kind: str = "FLOAT") -> str:
    return f"list_reduce(list_prepend(0::{kind}, list_transform(range(1, {DIMS} + 1), lambda i: (({a}[i]::{kind} - {b}[i]::{kind}) * ({a}[i]::{kind} - {b}[i]::{kind}))::{kind})), lambda s, v: (s + v)::{kind})"


def quantized(v: str) -> str:
    return f"list_transform({v}, lambda x: greatest(-127, least(127, round(x * 127::FLOAT)))::INTEGER)"


CORPUS = f"corpus AS MATERIALIZED (SELECT vec_id, embedding[1:{DIMS}] AS vector, label < 3 AS is_fraud FROM embeddings WHERE len(embedding) >= {DIMS} AND vec_id % 50 <> 37)"
CORPUS_Q = f"{CORPUS}, quant AS (SELECT *, {quantized('vector')} AS qvec FROM corpus)"
CENTS = f"cents AS (SELECT vec_id::INTEGER AS cluster_id, vector AS centroid FROM corpus WHERE vec_id < {CENTROIDS})"


def queries(every: int = EVERY) -> str:
    return f"q AS (SELECT vec_id AS query_id, vector AS qvector, {quantized('vector')} AS qq FROM corpus WHERE vec_id % {every} = 0)"


def assigned(cents: str = "cents", out: str = "assigned") -> str:
    return f"{out} AS MATERIALIZED (SELECT vec_id, vector, is_fraud, arg_min(cluster_id, (d, cluster_id)) AS cluster_id FROM (SELECT c.*, k.cluster_id, {l2('vector', 'centroid')} AS d FROM corpus c, {cents} k) GROUP BY ALL)"


def moved(assigned_: str, before: str, out: str) -> str:
    return f"""{out}_m AS (SELECT cluster_id, dim, avg(vector[dim]::DOUBLE)::FLOAT AS m FROM {assigned_}, range(1, {DIMS} + 1) r(dim) GROUP BY ALL),
{out}_v AS (SELECT cluster_id, list(m ORDER BY dim) AS centroid FROM {out}_m GROUP BY cluster_id),
{out} AS MATERIALIZED (SELECT b.cluster_id, coalesce(v.centroid, b.centroid) AS centroid FROM {before} b LEFT JOIN {out}_v v USING (cluster_id))"""


FORGY = f"c0 AS MATERIALIZED (SELECT cluster_id, vector AS centroid FROM (SELECT (row_number() OVER (ORDER BY md5('{PARAMS.seed}:' || vec_id), vec_id) - 1)::INTEGER AS cluster_id, vector FROM corpus) WHERE cluster_id < {CENTROIDS})"


def trained(rounds: int) -> str:
    """k-means unrolled: the centroids after so many rounds."""
    return ", ".join([FORGY, *(f"{assigned(f'c{i}', f'a{i}')}, {moved(f'a{i}', f'c{i}', f'c{i + 1}')}" for i in range(rounds)), f"cents AS (SELECT * FROM c{rounds})"])


TRAINED = trained(PARAMS.iters)
RANKS = f"ranks AS (SELECT query_id, cluster_id, d AS cent_dist, row_number() OVER (PARTITION BY query_id ORDER BY d, cluster_id) AS probe_rank FROM (SELECT query_id, cluster_id, {l2('qvector', 'centroid')} AS d FROM q, cents))"


def exact(k: int = 5) -> str:
    return f"exact AS (SELECT * FROM (SELECT query_id, vec_id, is_fraud, d AS dist, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT query_id, vec_id, is_fraud, {l2('qvector', 'vector')} AS d FROM q, corpus)) WHERE rank <= {k})"


def scanned(probes: int) -> str:
    return f"bytes AS MATERIALIZED (SELECT *, {quantized('vector')} AS qvec FROM assigned), scanned AS (SELECT query_id, vec_id, vector, qvector, is_fraud, probe_rank, {l2('qq', 'qvec', 'INTEGER')} AS dist FROM ranks JOIN q USING (query_id) JOIN bytes USING (cluster_id) WHERE probe_rank <= {probes})"


def found(probes: int, k: int = 5) -> str:
    return f"found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM scanned WHERE probe_rank <= {probes}) WHERE rank <= {k})"


def search(every: int, probes: int, k: int = 5) -> str:
    return ", ".join([CORPUS, queries(every), TRAINED, assigned(), RANKS, scanned(probes), found(probes, k)])


DECIDED = """decided AS (SELECT query_id, fraud_count, fraud_count / 5.0::DOUBLE AS fraud_score, fraud_count < 3 AS approved
  FROM (SELECT q.query_id, count(*) FILTER (WHERE f.is_fraud) AS fraud_count FROM q LEFT JOIN found f USING (query_id) GROUP BY q.query_id))"""
OUTCOMES = f"""WITH {search(1, 1)}, {DECIDED},
outcomes AS (SELECT d.query_id, NOT c.is_fraud AS expected_approved, d.approved, CASE WHEN d.query_id % 25 = 24 THEN 400 ELSE 200 END AS status, (d.query_id % 40) / 8.0 AS duration_ms
  FROM decided d JOIN corpus c ON c.vec_id = d.query_id),
counts AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 200 AND NOT approved AND NOT expected_approved) AS tp, count(*) FILTER (WHERE status = 200 AND approved AND expected_approved) AS tn,
  count(*) FILTER (WHERE status = 200 AND NOT approved AND expected_approved) AS fp, count(*) FILTER (WHERE status = 200 AND approved AND NOT expected_approved) AS fn, count(*) FILTER (WHERE status <> 200) AS err FROM outcomes),
rates AS (SELECT *, fp + 3 * fn + 5 * err AS weighted_error, (fp + 3 * fn + 5 * err) / n::DOUBLE AS error_rate, (fp + fn + err) / n::DOUBLE AS failure_rate FROM counts)"""
P99 = "CASE WHEN {0} <= 0 THEN 0.0 WHEN {0} > 2000 THEN -3000.0 ELSE 1000 * log10(1000 / greatest({0}, 1.0)) END"
DETECTION = "CASE WHEN {2} > 0.15 THEN -3000.0 ELSE 1000 * log10(1 / greatest({1}, 0.001)) - 300 * log10(1 + {0}) END"

CLASSIFIED = f"""WITH {search(1, 2)}, {exact()}, {DECIDED.replace("decided AS", "unused AS")},
want AS (SELECT query_id, CASE WHEN query_id % 4 = 0 THEN NOT ok ELSE ok END AS expected_approved FROM (SELECT q.query_id, count(*) FILTER (WHERE e.is_fraud) < 3 AS ok FROM q LEFT JOIN exact e USING (query_id) GROUP BY q.query_id)),
truth AS (SELECT query_id, count(*) FILTER (WHERE is_fraud) AS fraud_count_true, bool_and(probe_rank <= 2) AS all_scanned, min(probe_rank) FILTER (WHERE probe_rank > 2) AS missed
  FROM (SELECT e.*, r.probe_rank FROM exact e JOIN assigned a USING (vec_id) JOIN ranks r ON r.query_id = e.query_id AND r.cluster_id = a.cluster_id) GROUP BY query_id),
ivf AS (SELECT query_id, count(*) FILTER (WHERE is_fraud) AS fraud_count_ivf, max(dist) AS kth FROM found GROUP BY query_id),
flat AS (SELECT e.query_id, {l2('qq', 'qvec', 'INTEGER')} AS kth FROM exact e JOIN q USING (query_id) JOIN bytes USING (vec_id) WHERE rank = 5),
parts AS (SELECT w.query_id, w.expected_approved, coalesce(fraud_count_true, 0) AS fraud_count_true, coalesce(fraud_count_ivf, 0) AS fraud_count_ivf, coalesce(all_scanned, true) AS all_scanned, missed, coalesce(abs(i.kth - f.kth), 0) AS gap
  FROM want w LEFT JOIN truth USING (query_id) LEFT JOIN ivf i USING (query_id) LEFT JOIN flat f USING (query_id)),
classified AS (SELECT *, fraud_count_ivf < 3 AS actual_approved_ivf, CASE WHEN (fraud_count_true < 3) <> expected_approved THEN 'vectorize' WHEN NOT all_scanned THEN 'probe_miss' WHEN fraud_count_true <> fraud_count_ivf THEN 'tie_flip' ELSE 'other' END AS classification FROM parts)"""

EVENTS = """ev AS (SELECT *, coalesce((props ->> '$.k')::INTEGER, 0) AS k, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, floor(epoch(ts))::BIGINT AS s FROM events)"""
HISTORY = f"""{EVENTS},
hist AS (SELECT *, coalesce(avg(value) OVER b, 0)::FLOAT AS average, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS n_day,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 AS is_new, lag(s) OVER o AS last_s, lag(k) OVER o AS last_k, (avg(value) OVER (PARTITION BY event_type))::FLOAT AS kind_average
  FROM ev WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), b AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def clamp(x: str) -> str:
    return f"least(1::FLOAT, greatest(0::FLOAT, ({x})::FLOAT))"


RISK_SQL = "(CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}::FLOAT" for k, v in RISK.items()) + " ELSE 0.5::FLOAT END)"
FEATURES = [
    clamp("value::FLOAT / 10000::FLOAT"), clamp("(k % 12 + 1)::FLOAT / 12::FLOAT"), f"CASE WHEN average > 0 THEN {clamp('(value::FLOAT / average)::FLOAT / 10::FLOAT')} ELSE 0::FLOAT END",
    "(s // 3600 % 24)::FLOAT / 23::FLOAT", "(isodow(ts) - 1)::FLOAT / 6::FLOAT", f"CASE WHEN last_s IS NULL THEN -1::FLOAT ELSE {clamp('((s - last_s)::FLOAT / 60::FLOAT)::FLOAT / 1440::FLOAT')} END",
    f"CASE WHEN last_s IS NULL THEN -1::FLOAT ELSE {clamp('last_k::FLOAT / 1000::FLOAT')} END", clamp("k::FLOAT / 1000::FLOAT"), clamp("n_day::FLOAT / 20::FLOAT"),
    "(k % 2 = 0)::INTEGER::FLOAT", "(k % 3 = 0)::INTEGER::FLOAT", "is_new::INTEGER::FLOAT", RISK_SQL, clamp("kind_average / 10000::FLOAT"),
]
BUCKET = "CASE " + " ".join(f"WHEN us < {b} THEN {i}" for i, b in enumerate((10, 50, 100, 250, 500, 1000, 5000))) + " ELSE 7 END"
BUCKETS = f"""timings AS (SELECT event_type AS phase, floor(value * 10)::BIGINT AS us FROM events),
buckets AS (SELECT phase, bucket, count(*) FILTER (WHERE b = bucket) AS n FROM (SELECT phase, {BUCKET} AS b FROM timings), range(0, 8) r(bucket) GROUP BY ALL)"""
LOG = """log AS (SELECT CASE WHEN event_id % 50 = 0 THEN -1 ELSE event_id % 7 END AS tw, event_id % 11 AS tr, event_id % 97 AS tt FROM events WHERE event_id % 7 <> 6)"""
NEAR = "SELECT query_id, rank::INTEGER AS rank, vec_id, dist, is_fraud FROM"
LLOYD = f"WITH {CORPUS}, {CENTS}, {assigned()}, {moved('assigned', 'cents', 'one')}"
POSITIONS = f"WITH {CORPUS}, {TRAINED}, {assigned()}"

ORACLE: dict[str, str] = {
    "scan_valid_vectors": f"SELECT vec_id, {DIMS}::BIGINT AS n, label < 3 AS is_fraud FROM embeddings WHERE len(embedding) >= {DIMS} AND vec_id % 50 <> 37",
    "quantize_vectors": f"WITH {CORPUS_Q} SELECT vec_id, (dim - 1)::INTEGER AS dim, qvec[dim] AS value FROM quant, range(1, {DIMS} + 1) r(dim)",
    "sq_l2_f32": f"WITH {CORPUS}, {queries()} SELECT query_id, vec_id, {l2('qvector', 'vector')} AS dist FROM q, corpus",
    "sq_l2_int8": f"WITH {CORPUS_Q}, {queries()} SELECT query_id, vec_id, {l2('qq', 'qvec', 'INTEGER')} AS dist FROM q, quant",
    "knn_exact_f32": f"WITH {CORPUS}, {queries()}, {exact()} {NEAR} exact",
    "knn_exact_int8": f"WITH {CORPUS_Q}, {queries()} {NEAR} (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, vec_id) AS rank FROM (SELECT query_id, vec_id, is_fraud, {l2('qq', 'qvec', 'INTEGER')} AS dist FROM q, quant)) WHERE rank <= 5",
    "nearest_centroid_assign": f"WITH {CORPUS}, {CENTS}, {assigned()} SELECT vec_id, cluster_id FROM assigned",
    "lloyd_one_round": f"{LLOYD} SELECT cluster_id, (dim - 1)::INTEGER AS dim, round(centroid[dim]::DOUBLE, 5) + 0.0 AS value FROM one, range(1, {DIMS} + 1) r(dim)",
    "lloyd_two_rounds": f"{LLOYD}, {assigned('one', 'again')}, {moved('again', 'one', 'two')} SELECT cluster_id, (dim - 1)::INTEGER AS dim, round(centroid[dim]::DOUBLE, 5) + 0.0 AS value FROM two, range(1, {DIMS} + 1) r(dim)",
    "forgy_init": f"WITH {CORPUS}, f AS (SELECT (row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1)::INTEGER AS cluster_id, vector FROM corpus) SELECT cluster_id, (dim - 1)::INTEGER AS dim, vector[dim] AS value FROM f, range(1, {DIMS} + 1) r(dim) WHERE cluster_id < {CENTROIDS}",
    "sample_hash": f"WITH {CORPUS} SELECT vec_id, is_fraud FROM corpus WHERE ('0x' || substr(md5('42:' || vec_id), 1, 8))::BIGINT < {int(0.3 * 2**32)}",
    "cluster_offsets": f"{POSITIONS}, every AS (SELECT cluster_id FROM cents UNION ALL SELECT cluster_id + {CENTROIDS} FROM cents), sizes AS (SELECT e.cluster_id, count(a.vec_id) AS size FROM every e LEFT JOIN assigned a USING (cluster_id) GROUP BY e.cluster_id) SELECT cluster_id, size, (sum(size) OVER (ORDER BY cluster_id) - size)::BIGINT AS lo, (sum(size) OVER (ORDER BY cluster_id))::BIGINT AS hi FROM sizes",
    "offset_range_join": f"{POSITIONS} SELECT vec_id, row_number() OVER (ORDER BY cluster_id, vec_id) - 1 AS pos, cluster_id FROM assigned",
    "probe_select": f"WITH {CORPUS}, {queries()}, {TRAINED}, {RANKS} SELECT query_id, cluster_id, round(cent_dist::DOUBLE, 4) AS cent_dist, probe_rank::INTEGER AS probe_rank FROM ranks WHERE probe_rank <= 4",
    "cluster_rank": f"WITH {CORPUS}, {queries()}, {TRAINED}, {RANKS} SELECT query_id, cluster_id, probe_rank::INTEGER AS probe_rank FROM ranks",
    "ivf_search_int8": f"WITH {search(EVERY, PARAMS.default_probes)} {NEAR} found",
    "ivf_search_rerank": f"WITH {search(EVERY, PARAMS.default_probes, 12)} {NEAR} (SELECT query_id, vec_id, is_fraud, d AS dist, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM (SELECT *, {l2('qvector', 'vector')} AS d FROM found)) WHERE rank <= 5",
    "fraud_decision": f"WITH {search(EVERY, PARAMS.default_probes)}, {DECIDED} SELECT *, '{{\"approved\":' || approved || ',\"fraud_score\":' || printf('%.1f', fraud_score) || '}}' AS response FROM decided",
    "featurize_events": f"WITH {HISTORY} SELECT event_id::VARCHAR AS event_id, {', '.join(f'round(({x})::DOUBLE, 5) AS f{i:02d}' for i, x in enumerate(FEATURES))} FROM hist",
    "mcc_risk_lookup": f"SELECT event_id::VARCHAR AS event_id, {RISK_SQL}::DOUBLE AS risk FROM events",
    "unknown_merchant_flag": f"WITH {HISTORY} SELECT event_id::VARCHAR AS event_id, is_new::INTEGER AS unknown FROM hist",
    "request_validation": "SELECT event_id::VARCHAR AS event_id, event_id % 10 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 AS valid, CASE WHEN event_id % 10 <> 0 AND event_id % 11 <> 0 AND event_id % 13 <> 0 THEN event_type END AS mcc FROM events",
    "confusion_matrix": f"{OUTCOMES} SELECT n, tp, tn, fp, fn, err, weighted_error, round(error_rate, 6) AS error_rate, round(failure_rate, 6) AS failure_rate FROM rates",
    "evaluation_scores": f"{OUTCOMES}, p AS (SELECT quantile_cont(duration_ms::DOUBLE, 0.99) AS p99 FROM outcomes), s AS (SELECT p99, {P99.format('p99')} AS ps, {DETECTION.format('weighted_error', 'error_rate', 'failure_rate')} AS ds FROM rates, p) SELECT round(p99, 6) AS p99, round(ps, 6) AS p99_score, round(ds, 6) AS detection_score, round(ps + ds, 6) AS final_score FROM s",
    "detection_score_grid": f"SELECT id, round({DETECTION.format('id * 3', '(id / 400.0::DOUBLE)', '(id / 200.0::DOUBLE)')}, 6) AS score FROM range(40) r(id)",
    "p99_score_grid": f"SELECT id, round({P99.format('(id * id * 0.75::DOUBLE - 1)')}, 6) AS score FROM range(60) r(id)",
    "dataset_stats": f"WITH {CORPUS} SELECT count(*) AS total, count(*) FILTER (WHERE is_fraud) AS fraud_count, count(*) FILTER (WHERE NOT is_fraud) AS legit_count, round(avg(is_fraud::INTEGER), 6) AS fraud_rate, round(avg((NOT is_fraud)::INTEGER), 6) AS legit_rate FROM corpus",
    "probe_calibration": f"""WITH {', '.join([CORPUS, queries(1), TRAINED, assigned(), RANKS, scanned(16)])}, p AS (SELECT UNNEST([1, 2, 4, 8, 16])::INTEGER AS probes),
near AS (SELECT probes, query_id, count(*) FILTER (WHERE is_fraud) AS c FROM (SELECT probes, query_id, is_fraud, row_number() OVER (PARTITION BY probes, query_id ORDER BY dist, vec_id) AS r FROM p JOIN scanned ON probe_rank <= probes) WHERE r <= 5 GROUP BY ALL),
rows_ AS (SELECT p.probes, coalesce(c, 0) < 3 AS ok, NOT k.is_fraud AS want FROM p CROSS JOIN q JOIN corpus k ON k.vec_id = q.query_id LEFT JOIN near USING (probes, query_id))
SELECT probes, count(*) AS n, count(*) FILTER (WHERE NOT ok AND want) AS fp, count(*) FILTER (WHERE ok AND NOT want) AS fn, count(*) FILTER (WHERE ok <> want) AS errors, round(100.0::DOUBLE * count(*) FILTER (WHERE ok <> want) / count(*), 6) AS error_pct FROM rows_ GROUP BY probes""",
    "mismatch_filter": f"WITH {search(1, 1)}, {DECIDED} SELECT query_id, approved, NOT c.is_fraud AS expected_approved, fraud_count FROM decided JOIN corpus c ON c.vec_id = query_id WHERE approved <> NOT c.is_fraud",
    "classify_mismatches": f"{CLASSIFIED} SELECT query_id, classification, expected_approved, actual_approved_ivf, fraud_count_true, fraud_count_ivf, CASE WHEN classification = 'probe_miss' THEN coalesce(missed, 999)::INTEGER END AS probe_miss_rank, CASE WHEN classification = 'tie_flip' THEN gap END AS tie_flip_gap FROM classified",
    "class_histogram": f"{CLASSIFIED} SELECT c AS classification, count(classification) AS n, round(100.0::DOUBLE * count(classification) / (SELECT count(*) FROM classified), 6) AS pct FROM (SELECT UNNEST(['vectorize', 'probe_miss', 'tie_flip', 'other']) AS c) LEFT JOIN classified ON c = classification GROUP BY c",
    "probe_miss_rank_hist": f"{CLASSIFIED} SELECT coalesce(missed, 999)::INTEGER AS value, count(*) AS n FROM classified WHERE classification = 'probe_miss' GROUP BY ALL",
    "tie_flip_gap_hist": f"{CLASSIFIED} SELECT gap AS value, count(*) AS n FROM classified WHERE classification = 'tie_flip' GROUP BY ALL",
    "error_verdict": f"{CLASSIFIED} SELECT *, CASE WHEN probe_miss > tie_flip THEN 'more probes' ELSE 'rerank by exact distance' END AS advice FROM (SELECT count(*) FILTER (WHERE classification = 'probe_miss') AS probe_miss, count(*) FILTER (WHERE classification = 'tie_flip') AS tie_flip FROM classified)",
    "semi_scanned": f"WITH {', '.join([CORPUS, queries(), TRAINED, assigned(), RANKS, exact()])} SELECT e.query_id, vec_id, probe_rank::INTEGER AS cluster_rank FROM exact e JOIN assigned a USING (vec_id) JOIN ranks r ON r.query_id = e.query_id AND r.cluster_id = a.cluster_id WHERE probe_rank <= 2",
    "anti_unscanned": f"WITH {', '.join([CORPUS, queries(), TRAINED, assigned(), RANKS, exact()])} SELECT e.query_id, vec_id, probe_rank::INTEGER AS cluster_rank FROM exact e JOIN assigned a USING (vec_id) JOIN ranks r ON r.query_id = e.query_id AND r.cluster_id = a.cluster_id WHERE probe_rank > 2",
    "phase_histogram": f"WITH {BUCKETS} SELECT phase, bucket::INTEGER AS bucket, n FROM buckets",
    "phase_summary": f"WITH {BUCKETS} SELECT phase, count(*) AS n, sum(us)::BIGINT AS total_us, (sum(us) // count(*))::BIGINT AS mean_us FROM timings GROUP BY phase",
    "bucket_percentile": f"WITH {BUCKETS}, r AS (SELECT phase, bucket, sum(n) OVER (PARTITION BY phase ORDER BY bucket) AS upto, greatest(floor(sum(n) OVER (PARTITION BY phase) * 0.99::DOUBLE), 1) AS target FROM buckets) SELECT phase, bucket::INTEGER AS bucket, ([10, 50, 100, 250, 500, 1000, 5000])[bucket + 1]::INTEGER AS bound FROM (SELECT phase, min(bucket) AS bucket FROM r WHERE upto >= target GROUP BY phase)",
    "log_field_buckets": f"WITH {LOG} SELECT field, CASE WHEN v < 0 THEN 'aborted' WHEN v <= 1 THEN v::VARCHAR WHEN v < 5 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS n FROM (SELECT 'Tw' AS field, tw AS v FROM log UNION ALL SELECT 'Tr', tr FROM log) GROUP BY ALL",
    "log_summary": f"WITH {LOG} SELECT count(*) AS total, max(tt)::INTEGER AS max_total_ms FROM log",
}
ORACLE["index_roundtrip"] = ORACLE["ivf_search_int8"]
ORACLE["stream_score"] = ORACLE["fraud_decision"]

FEATURIZED = ORACLE["featurize_events"]
VALUES = ", ".join(f"('{k}', {float(v)}::DOUBLE)" for k, v in [*asdict(Normalization(max_km=250.0)).items(), *RISK.items()])
BOTH = f"WITH {search(EVERY, 2)}, {exact()}"
RERANKED = f"{search(EVERY, PARAMS.default_probes, 12)}, near AS (SELECT * FROM (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS r FROM (SELECT *, {l2('qvector', 'vector')} AS d FROM found)) WHERE r <= 5)"
ORACLE |= {
    "kmeans_full": f"WITH {CORPUS}, {trained(20)} SELECT cluster_id, (dim - 1)::INTEGER AS dim, round(centroid[dim]::DOUBLE, 4) + 0.0 AS value FROM cents, range(1, {DIMS} + 1) r(dim)",
    "semi_found": f"{BOTH} SELECT e.query_id, e.vec_id FROM exact e SEMI JOIN found f ON f.query_id = e.query_id AND f.vec_id = e.vec_id",
    "anti_lost": f"{BOTH} SELECT e.query_id, e.vec_id FROM exact e ANTI JOIN found f ON f.query_id = e.query_id AND f.vec_id = e.vec_id",
    "ivf_recall": f"WITH {RERANKED}, {exact()} SELECT count(*) AS n, count(f.vec_id) AS found, round(count(f.vec_id) / count(*)::DOUBLE, 6) AS recall FROM exact e LEFT JOIN near f ON f.query_id = e.query_id AND f.vec_id = e.vec_id",
    "corpus_array": f"SELECT i AS vec_id, {DIMS}::BIGINT AS n, is_fraud FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS i, vec_id, len(embedding) AS n, label < 3 AS is_fraud FROM embeddings) WHERE n >= {DIMS} AND vec_id % 50 <> 37",
    "configuration_files": f"SELECT * FROM (VALUES {VALUES}) v(name, value)",
    "labelled_set": "SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, event_id % 3 <> 0 AS expected_approved, event_id::VARCHAR AS event_id FROM events",
    "mismatch_lines": "SELECT event_id AS idx, event_id::VARCHAR AS id, event_id % 3 <> 0 AS expected_approved, event_type AS mcc FROM events UNION ALL SELECT -1, '{broken', false, NULL",
    "access_log": ORACLE["log_summary"],
    "cpu_counters": "SELECT name, value::BIGINT AS value, noted FROM (VALUES ('usage_usec', 12, false), ('nr_periods', 5, true), ('nr_throttled', 2, true), ('throttled_usec', 70, true), ('nr_bursts', 1, true), ('burst_usec', 3, true), ('user_usec', NULL, false)) v(name, value, noted)",
    "classified_lines": f"{CLASSIFIED} SELECT query_id, classification, fraud_count_true, fraud_count_ivf FROM classified",
    "summary_file": ORACLE["error_verdict"],
    "phase_stream": "SELECT phase, bucket, sum(n)::BIGINT AS n FROM (" + ORACLE["phase_histogram"] + ") GROUP BY ALL",
    "request_lines": FEATURIZED,
}
