"""DuckDB SQL with the same results as the queries of plans.queries."""

from __future__ import annotations


def _clamp(x: str) -> str:
    return f"least(greatest({x}, 0::FLOAT), 1::FLOAT)"


def _ratio(x: str, top: float) -> str:
    return _clamp(f"(({x})::FLOAT / ({top})::FLOAT)")


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


_D = "CAST(list_sum(list_transform(list_zip({0}, {1}), lambda z: (z[1] - z[2])::BIGINT * (z[1] - z[2])::BIGINT)) AS BIGINT)"
V = "v AS (SELECT vec_id AS ref_id, CASE WHEN label < 3 THEN 'fraud' ELSE 'legit' END AS label, list_transform(embedding, lambda x: CAST(greatest(-32768, least(32767, round(x * 10000::FLOAT))) AS INTEGER)) AS q FROM embeddings)"
R = "r AS (SELECT * FROM v)"
A = "a AS (SELECT ref_id AS query_id, q FROM v WHERE ref_id % 100 = 0)"
C = "c AS (SELECT CAST(ref_id AS INTEGER) AS cluster_id, q AS c FROM v WHERE ref_id < 16)"
KNN = f"n AS (SELECT * FROM (SELECT query_id, ref_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM (SELECT query_id, ref_id, label, {_D.format('a.q', 'r.q')} AS d FROM a, r WHERE r.ref_id <> a.query_id)) WHERE rank <= 5)"


def _assigned(source: str, centroids: str = "c", name: str = "s") -> str:
    """ref_id, q, label, cluster_id and d of the nearest centroid."""
    c = centroids
    return f"{name} AS MATERIALIZED (SELECT * FROM (SELECT ref_id, {source}.q, label, cluster_id, {_D.format(f'{source}.q', f'{c}.c')} AS d, row_number() OVER (PARTITION BY ref_id ORDER BY {_D.format(f'{source}.q', f'{c}.c')}, cluster_id) AS k FROM {source}, {c}) WHERE k = 1)"


def _round(before: str, after: str) -> tuple[str, str]:
    """A round of k-means over r: the next centroids, in whole numbers; a cluster without rows keeps its own."""
    s = f"s_{after}"
    means = f"SELECT cluster_id, list(CAST(round(CAST(t AS DOUBLE) / n) AS INTEGER) ORDER BY i) AS c FROM (SELECT cluster_id, i, sum(q[i]) AS t, count(*) AS n FROM {s}, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster_id, i) GROUP BY cluster_id"
    return _assigned("r", before, s), f"{after} AS MATERIALIZED (SELECT b.cluster_id, coalesce(m.c, b.c) AS c FROM {before} b LEFT JOIN ({means}) m ON b.cluster_id = m.cluster_id)"


SIZES = "z AS (SELECT c.cluster_id, count(s.ref_id) AS n FROM c LEFT JOIN s ON c.cluster_id = s.cluster_id GROUP BY c.cluster_id)"
OFFSETS = "o AS (SELECT cluster_id, n, CAST(sum(n) OVER w - n AS BIGINT) AS list_start, CAST(ceil(n / 8) AS BIGINT) AS blocks, CAST(sum(CAST(ceil(n / 8) AS BIGINT)) OVER w - CAST(ceil(n / 8) AS BIGINT) AS BIGINT) AS block_start FROM z WINDOW w AS (ORDER BY cluster_id))"
PLACED = "l AS (SELECT ref_id, label, s.q, cluster_id, slot, block_start + slot // 8 AS block, slot % 8 AS lane FROM (SELECT s.*, row_number() OVER (PARTITION BY cluster_id ORDER BY ref_id) - 1 AS slot FROM s) s JOIN o USING (cluster_id))"
TRAINED = (C.replace("c AS", "c0 AS", 1), *_round("c0", "c1"), *_round("c1", "c2"), *_round("c2", "c"))
INDEX = (V, R, A, *TRAINED, _assigned("r"))
PROBES = f"p AS (SELECT query_id, a.q, cluster_id, {_D.format('a.q', 'c.c')} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {_D.format('a.q', 'c.c')}, cluster_id) AS rank FROM a, c)"


def _found(name: str, probes: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, ref_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM (SELECT query_id, ref_id, label, {_D.format('p.q', 's.q')} AS d FROM p JOIN s USING (cluster_id) WHERE {probes})) WHERE rank <= 6)"


def _others(source: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, ref_id, label, d, row_number() OVER (PARTITION BY query_id ORDER BY d, ref_id) AS rank FROM {source} WHERE ref_id <> query_id) WHERE rank <= 5)"


FIRST = _found("f", "p.rank <= 12")
UNDECIDED = "u AS (SELECT query_id FROM f GROUP BY query_id HAVING count(*) FILTER (label = 'fraud') IN (3, 4))"
ADAPTIVE = _found("n6", "p.rank <= 12 OR (p.rank <= 14 AND query_id IN (SELECT query_id FROM u))") + ", " + _others("n6", "n")
_VOTES = "SELECT a.query_id, count(n.ref_id) AS found, count(*) FILTER (n.label = 'fraud') AS votes, count(*) FILTER (n.label = 'fraud') / count(n.ref_id) AS fraud_score, count(*) FILTER (n.label = 'fraud') / count(n.ref_id) < 0.6 AS approved FROM a LEFT JOIN n ON a.query_id = n.query_id GROUP BY a.query_id"
_NEIGHBOURS = "SELECT query_id, CAST(rank AS INTEGER) AS rank, ref_id, d, label FROM "
LLOYD = "m AS (SELECT cluster_id, list(CAST(s AS DOUBLE) / n ORDER BY i) AS c FROM (SELECT cluster_id, i, sum(q[i]) AS s, count(*) AS n FROM s, (SELECT unnest(range(1, 65)) AS i) GROUP BY cluster_id, i) GROUP BY cluster_id), c1 AS (SELECT c.cluster_id, coalesce(m.c, list_transform(c.c, lambda x: x::DOUBLE)) AS c FROM c LEFT JOIN m USING (cluster_id))"

E = "e AS (SELECT *, epoch_us(ts) AS micros, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"
D = "d AS (SELECT *, lag(micros) OVER (PARTITION BY user_id ORDER BY micros) AS last_micros, count(*) OVER (PARTITION BY user_id ORDER BY micros RANGE BETWEEN 86400000000 PRECEDING AND 1 PRECEDING) AS tx_24h, coalesce(CAST(sum(cents) OVER b AS DOUBLE) / CAST(count(cents) OVER b AS DOUBLE) / 100, 0) AS avg_before, count(*) OVER (PARTITION BY user_id, event_type ORDER BY micros ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0 AS known, CASE event_type WHEN 'click' THEN '5411' WHEN 'purchase' THEN '7801' WHEN 'refund' THEN '7802' WHEN 'view' THEN '5912' ELSE 'none' END AS mcc FROM e WINDOW b AS (PARTITION BY user_id ORDER BY micros ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
T = "t AS (SELECT event_type, CAST(sum(cents) AS DOUBLE) / CAST(count(cents) AS DOUBLE) / 100 AS type_avg FROM e GROUP BY event_type)"
_MINUTES = f"CASE WHEN last_micros IS NULL THEN -1::FLOAT ELSE {_ratio('greatest((micros - last_micros) // 1000000, 0)::FLOAT / 60::FLOAT', 1440)} END"
_RISK = "CASE mcc WHEN '5411' THEN 0.15 WHEN '5912' THEN 0.2 WHEN '7801' THEN 0.8 ELSE 0.5 END::FLOAT"
_AVG = f"CASE WHEN avg_before::FLOAT <= 0 THEN CASE WHEN abs(value)::FLOAT <= 0 THEN 0::FLOAT ELSE 1::FLOAT END ELSE {_clamp('(abs(value)::FLOAT / avg_before::FLOAT) / 10::FLOAT')} END"
X = "x AS (SELECT event_id, [" + ", ".join([
    _ratio("abs(value)", 500), _ratio("event_id % 12 + 1", 12), _AVG, "hour(ts)::FLOAT / 23::FLOAT", "(isodow(ts) - 1)::FLOAT / 6::FLOAT", _MINUTES,
    f"CASE WHEN last_micros IS NULL THEN -1::FLOAT ELSE {_ratio('event_id * 3 % 900', 1000)} END", _ratio("event_id * 7 % 1200", 1000), _ratio("tx_24h", 20), "(event_id % 2 = 0)::INTEGER::FLOAT",
    "(event_id % 3 = 0)::INTEGER::FLOAT", "CASE WHEN known THEN 0::FLOAT ELSE 1::FLOAT END", _RISK, _ratio("coalesce(type_avg, 0)", 100),
]) + "] AS vector FROM d LEFT JOIN t USING (event_type))"
XQ = "v AS (SELECT event_id AS ref_id, CASE WHEN event_id % 3 = 0 THEN 'fraud' ELSE 'legit' END AS label, list_transform(vector, lambda y: CAST(greatest(-32768, least(32767, round(y * 10000::FLOAT))) AS INTEGER)) AS q FROM x), r AS (SELECT * FROM v), a AS (SELECT ref_id AS query_id, q FROM v WHERE ref_id % 100 = 0)"
_M64 = "18446744073709551616::UHUGEINT"
RESERVOIR = f"""WITH i AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS place FROM events),
z0 AS (SELECT event_id, place, ((42::UHUGEINT + (place - 199)::UHUGEINT * 11400714819323198485::UHUGEINT) % {_M64})::UBIGINT AS z FROM i WHERE place >= 200),
z1 AS (SELECT event_id, place, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % {_M64})::UBIGINT AS z FROM z0),
z2 AS (SELECT event_id, place, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % {_M64})::UBIGINT AS z FROM z1),
w AS (SELECT event_id, place, (xor(z, z >> 31) % (place + 1)::UBIGINT)::BIGINT AS slot FROM z2 UNION ALL SELECT event_id, place, place FROM i WHERE place < 200)
SELECT slot, arg_max(event_id, place) AS event_id FROM w WHERE slot < 200 GROUP BY slot"""

ORACLE = {
    "quantize_embeddings": _with(V) + "SELECT ref_id AS vec_id, CAST(i - 1 AS INTEGER) AS dim, q[i] AS q FROM (SELECT ref_id, q, unnest(range(1, len(q) + 1)) AS i FROM v)",
    "l2_pairs": _with(V) + f"SELECT x.ref_id AS query_id, y.ref_id, {_D.format('x.q', 'y.q')} AS d FROM v x, v y WHERE x.ref_id % 100 = 0",
    "l2_threshold": _with(V) + f"SELECT query_id, ref_id, CASE WHEN d <= 170000000 THEN d END AS d FROM (SELECT x.ref_id AS query_id, y.ref_id, {_D.format('x.q', 'y.q')} AS d FROM v x, v y WHERE x.ref_id % 100 = 0)",
    "l2_neighbours": _with(V) + f"SELECT x.ref_id AS vec_id, round(list_sum(list_transform(list_zip(e.embedding, g.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS l2, CASE WHEN {_D.format('x.q', 'y.q')} <= 200000000 THEN {_D.format('x.q', 'y.q')} END AS within FROM v x JOIN v y ON y.ref_id = x.ref_id + 1 JOIN embeddings e ON e.vec_id = x.ref_id JOIN embeddings g ON g.vec_id = y.ref_id",
    "knn_exact": _with(V, R, A, KNN) + _NEIGHBOURS + "n",
    "knn_classify": _with(V, R, A, KNN) + _VOTES,
    "kth_distance": _with(V, R, A, KNN) + "SELECT query_id, CASE WHEN count(*) >= 5 THEN max(d) END AS worst FROM n GROUP BY query_id",
    "nearest_centroid": _with(V, C, _assigned("v")) + "SELECT ref_id AS vec_id, cluster_id, d FROM s",
    "cluster_sizes": _with(V, C, _assigned("v"), SIZES) + "SELECT * FROM z",
    "cluster_sums": _with(V, C, _assigned("v")) + "SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, count(*) AS n, CAST(sum(q[i]) AS BIGINT) AS s FROM (SELECT cluster_id, q, unnest(range(1, len(q) + 1)) AS i FROM s) GROUP BY cluster_id, i",
    "lloyd_step": _with(V, C, _assigned("v"), LLOYD) + "SELECT cluster_id, CAST(i - 1 AS INTEGER) AS dim, round(c[i], 6) AS value FROM (SELECT cluster_id, c, unnest(range(1, len(c) + 1)) AS i FROM c1)",
    "assignment_changes": _with(V, C, _assigned("v"), LLOYD) + "SELECT count(*) FILTER (b.cluster_id <> s.cluster_id) AS changed, count(*) AS n FROM s JOIN (SELECT ref_id, arg_min(cluster_id, list_sum(list_transform(list_zip(v.q, c1.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS cluster_id FROM v, c1 GROUP BY ref_id) b USING (ref_id)",
    "cluster_radii": _with(V, C, _assigned("v")) + "SELECT cluster_id, round(sqrt(max(d)), 6) AS radius FROM s GROUP BY cluster_id",
    "list_offsets": _with(*INDEX, SIZES, OFFSETS) + "SELECT cluster_id, n, list_start FROM o",
    "block_offsets": _with(*INDEX, SIZES, OFFSETS) + "SELECT cluster_id, blocks, block_start FROM o",
    "lane_placement": _with(*INDEX, SIZES, OFFSETS, PLACED) + "SELECT ref_id, cluster_id, slot, block, lane FROM l",
    "padded_blocks": _with(*INDEX, SIZES, OFFSETS, PLACED) + "SELECT g.block, g.lane, l.ref_id FROM (SELECT block, unnest(range(0, 8)) AS lane FROM (SELECT unnest(range(0, CAST((SELECT sum(blocks) FROM o) AS BIGINT))) AS block)) g LEFT JOIN l ON g.block = l.block AND g.lane = l.lane",
    "centroids_transposed": _with(*INDEX) + "SELECT CAST(i - 1 AS INTEGER) AS dim, cluster_id, c[i] AS value FROM (SELECT cluster_id, c, unnest(range(1, len(c) + 1)) AS i FROM c)",
    "probe_lists": _with(*INDEX, PROBES) + "SELECT query_id, CAST(rank AS INTEGER) AS rank, cluster_id, d FROM p WHERE rank <= 14",
    "ivf_fast": _with(*INDEX, PROBES, FIRST, _others("f", "n")) + _NEIGHBOURS + "n",
    "ivf_adaptive": _with(*INDEX, PROBES, FIRST, UNDECIDED, ADAPTIVE) + _NEIGHBOURS + "n",
    "bound_pruned_knn": _with(V, R, A, KNN) + _NEIGHBOURS + "n",
    "ivf_recall": _with(*INDEX, PROBES, FIRST, UNDECIDED, ADAPTIVE, KNN.replace("n AS", "exact AS", 1)) + "SELECT count(n.ref_id) AS hits, count(*) AS wanted FROM exact LEFT JOIN n ON exact.query_id = n.query_id AND exact.ref_id = n.ref_id",
    "classify_ivf": _with(*INDEX, PROBES, FIRST, UNDECIDED, ADAPTIVE) + _VOTES,
    "feature_clamp": f"SELECT o_orderkey, round({_ratio('o_totalprice', 250000)}::DOUBLE, 6) AS amount FROM orders",
    "amount_vs_avg": "WITH m AS (SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) / 100 AS mean FROM orders GROUP BY o_custkey) "
    + f"SELECT o_orderkey, round((CASE WHEN mean::FLOAT <= 0 THEN CASE WHEN o_totalprice::FLOAT <= 0 THEN 0::FLOAT ELSE 1::FLOAT END ELSE {_clamp('(o_totalprice::FLOAT / mean::FLOAT) / 10::FLOAT')} END)::DOUBLE, 6) AS ratio FROM orders JOIN m USING (o_custkey)",
    "time_features": "SELECT event_id, round((hour(ts)::FLOAT / 23::FLOAT)::DOUBLE, 6) AS hour_of_day, round(((isodow(ts) - 1)::FLOAT / 6::FLOAT)::DOUBLE, 6) AS day_of_week FROM events",
    "minutes_since_last": _with(E, D) + f"SELECT event_id, round(({_MINUTES})::DOUBLE, 6) AS minutes FROM d",
    "known_merchant": _with(E, D) + "SELECT event_id, CASE WHEN known THEN 0 ELSE 1 END AS unknown_merchant FROM d",
    "mcc_risk_lookup": _with(E, D) + f"SELECT event_id, mcc, round(({_RISK})::DOUBLE, 6) AS mcc_risk FROM d",
    "vectorize_events": _with(E, D, T, X) + "SELECT event_id, CAST(i - 1 AS INTEGER) AS dim, round(vector[i]::DOUBLE, 6) AS value FROM (SELECT event_id, vector, unnest(range(1, 15)) AS i FROM x)",
    "request_json_roundtrip": _with(E, D) + "SELECT event_id, abs(value) AS amount, event_id % 12 + 1 AS installments, tx_24h, known::INTEGER AS n_known, mcc, event_id % 2 = 0 AS is_online, CASE WHEN last_micros IS NOT NULL THEN (event_id * 3 % 900)::DOUBLE END AS km, TRUE AS valid FROM d",
    "timestamp_validation": "WITH k AS (SELECT event_id, ts, CASE event_id % 5 WHEN 1 THEN 'not-a-timestamp' WHEN 2 THEN strftime(ts, '%Y-%m-%d') WHEN 3 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS bad FROM events) SELECT event_id, CASE WHEN bad IS NULL THEN 200 ELSE 400 END AS status, 'invalid timestamp: ' || bad AS error, CAST(CASE WHEN bad IS NULL THEN (hour(ts) + CASE WHEN event_id % 5 = 4 THEN 22 ELSE 0 END) % 24 END AS INTEGER) AS utc_hour FROM k",
    "response_encode": _with(V, R, A, KNN) + f"SELECT query_id, '{{\"approved\":' || approved || ',\"fraud_score\":' || CAST(fraud_score AS FLOAT) || '}}' AS body FROM ({_VOTES})",
    "score_events": _with(E, D, T, X, XQ, KNN) + _VOTES,
    "stream_score": _with(E, D, T, X, XQ, KNN.replace(" WHERE r.ref_id <> a.query_id", "")) + f"SELECT query_id AS event_id, approved, round(fraud_score::FLOAT::DOUBLE, 6) AS fraud_score, 200 AS status FROM ({_VOTES})",
    "reservoir_sample": RESERVOIR,
    "index_roundtrip": _with(*INDEX, SIZES, OFFSETS, PLACED) + "SELECT row_number() OVER (ORDER BY cluster_id, slot) - 1 AS ref_id, cluster_id, label, list_reduce(list_prepend(0::BIGINT, list_transform(q, lambda y: y::BIGINT)), lambda m, y: m * 3 % 1000003 + y) AS digest FROM l",
    "empty_index": _with(V, A) + "SELECT query_id, 0 AS found, 0 AS votes, NULL::BOOLEAN AS approved, 503 AS status FROM a",
}
