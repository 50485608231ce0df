"""The SQL each registered query is held against. Training loops are unrolled into common table expressions."""

from __future__ import annotations

from .queries import BASE_ROWS, CODES, COSINE_STOP, DIMS, K, LABEL, M, NEEDLE, NLIST, NPROBE, PQ_ROUNDS, ROUNDS, SAMPLES, SEED, TOY_EDGES

_UNIT = "list_transform(embedding, lambda x: (x::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])))::FLOAT)"
_E = f"e AS MATERIALIZED (SELECT vec_id AS id, label, {_UNIT} AS v FROM embeddings)"
_Q = "q AS MATERIALIZED (SELECT id AS query_id, v FROM e WHERE id % 50 = 0)"
_W = DIMS // M


def _dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i]::DOUBLE - {b}[i]::DOUBLE) * ({a}[i]::DOUBLE - {b}[i]::DOUBLE)))"


def _ranked(scored: str, order: str = "DESC", k: int = K) -> str:
    return f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s {order}, id)::INTEGER AS rank, id, round(s, 6) + 0.0 AS score
FROM ({scored}) QUALIFY rank <= {k}"""


def _kmeans() -> list[str]:
    """Spherical training: c0..cN are the centroids after each round."""
    out = [f"c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY md5('{SEED}:' || id), id) - 1)::INTEGER AS cid, v FROM e QUALIFY cid < {NLIST})"]
    for i in range(ROUNDS):
        out += [
            f"a{i} AS MATERIALIZED (SELECT e.id, arg_max(cid, {{'d': {_dot('e.v', 'c.v')}, 'n': -cid}}) AS cid FROM e, c{i} c GROUP BY e.id)",
            f"m{i} AS (SELECT cid, pos, sum(x) / count(*) AS m FROM (SELECT cid, unnest(e.v::DOUBLE[]) AS x, generate_subscripts(e.v, 1) AS pos FROM a{i} JOIN e USING (id)) GROUP BY cid, pos)",
            f"""c{i + 1} AS MATERIALIZED (SELECT c.cid, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN
                (SELECT cid, list((m / norm)::FLOAT ORDER BY pos) AS v FROM (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY cid)) AS norm FROM m{i}) GROUP BY cid) n USING (cid))""",
        ]
    out.append(f"a AS MATERIALIZED (SELECT e.id, arg_max(cid, {{'d': {_dot('e.v', 'c.v')}, 'n': -cid}}) AS cid FROM e, c{ROUNDS} c GROUP BY e.id)")
    return out


_C = f"c{ROUNDS}"


def _codebooks(source: str) -> list[str]:
    """Training in every sub-space of ``source`` (id, v): b0..bN are the books, codes the final codes."""
    out = [
        f"s AS MATERIALIZED (SELECT id, j::INTEGER AS m, v[j * {_W} + 1 : (j + 1) * {_W}] AS w FROM {source}, range({M}) t(j))",
        f"b0 AS MATERIALIZED (SELECT m, (row_number() OVER (PARTITION BY m ORDER BY md5('{SEED}:' || m || ':' || id), id) - 1)::INTEGER AS k, w FROM s QUALIFY k < {CODES})",
    ]
    for i in range(PQ_ROUNDS + 1):
        name = "codes" if i == PQ_ROUNDS else f"p{i}"
        out.append(f"{name} AS MATERIALIZED (SELECT id, m, arg_min(k, {{'d': d, 'k': k}}) AS k FROM (SELECT s.id, s.m, b.k, {_l2('s.w', 'b.w')} AS d FROM s JOIN b{i} b USING (m)) GROUP BY id, m)")
        if i < PQ_ROUNDS:
            out.append(
                f"""b{i + 1} AS MATERIALIZED (SELECT b.m, b.k, coalesce(n.w, b.w) AS w FROM b{i} b LEFT JOIN
                (SELECT m, k, list(x::FLOAT ORDER BY pos) AS w FROM (SELECT m, k, pos, sum(x) / count(*) AS x FROM
                 (SELECT p.m, p.k, unnest(s.w::DOUBLE[]) AS x, generate_subscripts(s.w, 1) AS pos FROM p{i} p JOIN s USING (id, m)) GROUP BY m, k, pos) GROUP BY m, k) n USING (m, k))"""
            )
    return out


_B = f"b{PQ_ROUNDS}"


def _with(*parts: str | list[str]) -> str:
    flat: list[str] = []
    for p in parts:
        flat += [p] if isinstance(p, str) else p
    return "WITH RECURSIVE " + ",\n".join(flat) + "\n" if any("RECURSIVE" in p for p in flat) else "WITH " + ",\n".join(flat) + "\n"


def statements() -> dict[str, str]:
    exact = f"SELECT query_id, e.id, {_dot('q.v', 'e.v')} AS s FROM q, e"
    probes = f"pr AS MATERIALIZED (SELECT query_id, q.v, cid, {_dot('q.v', 'c.v')} AS coarse FROM q, {_C} c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, cid) <= {NPROBE})"
    ivf2 = f"SELECT query_id, e.id, {_dot('pr.v', 'e.v')} AS s FROM pr JOIN a USING (cid) JOIN e ON e.id = a.id"
    km, books = _kmeans(), _codebooks("e")
    rest = f"r AS MATERIALIZED (SELECT e.id, list_transform(range(1, {DIMS + 1}), lambda i: (e.v[i]::DOUBLE - c.v[i]::DOUBLE)::FLOAT) AS v FROM e JOIN a USING (id) JOIN {_C} c USING (cid))"
    rest_books = _codebooks("r")
    stats = f"""SELECT min(n) AS min_size, max(n) AS max_size, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS stddev_size, count(*) FILTER (n = 0) AS empty_clusters
FROM (SELECT c.cid, count(a.id) AS n FROM {_C} c LEFT JOIN a USING (cid) GROUP BY c.cid)"""
    pair = "FROM e a JOIN e b ON b.id = a.id + 1"
    sub = f"(SELECT query_id, j::INTEGER AS m, v[j * {_W} + 1 : (j + 1) * {_W}] AS w FROM q, range({M}) t(j))"
    samples = ", ".join(f"('{m}', {x}::DOUBLE)" for m, xs in SAMPLES for x in xs)
    edges = ", ".join(f"({a}, {b})" for a, b in TOY_EDGES)
    log = "SELECT (row_number() OVER (ORDER BY item_id) - 1)::BIGINT AS rec_id, text"
    moves = " UNION ALL ".join(f"SELECT {i} AS r, avg(1 - {_dot('a.v', 'b.v')}) AS step FROM c{i} a JOIN c{i + 1} b USING (cid)" for i in range(ROUNDS))
    after = " UNION ALL ".join(f"SELECT {i} AS r, cid, v FROM c{i + 1}" for i in range(ROUNDS))
    n_all = "(SELECT count(*) FROM embeddings)"
    return {
        "exact_topk_batch": _with(_E, _Q) + _ranked(exact),
        "exact_topk_expression": _with(_E, _Q) + _ranked(exact),
        "exact_topk_single": _with(_E, "q AS (SELECT id AS query_id, v FROM e WHERE id = 0)") + _ranked(exact),
        "exact_topk_filtered": _with(_E, _Q) + _ranked(exact + f" WHERE e.label = {LABEL}"),
        "normalize_vectors": _with(_E) + "SELECT id, v::DOUBLE[] AS vector FROM e",
        "pairwise_dot": _with(_E) + f"SELECT a.id, round({_dot('a.v', 'b.v')}, 6) + 0.0 AS value {pair}",
        "pairwise_sq_l2": _with(_E) + f"SELECT a.id, round({_l2('a.v', 'b.v')}, 6) + 0.0 AS value {pair}",
        "pairwise_cosine_distance": _with(_E) + f"SELECT id, round(x, 6) + 0.0 AS distance, round(1 - x, 6) + 0.0 AS score FROM (SELECT a.id, 1.0::DOUBLE - {_dot('a.v', 'b.v')} AS x {pair})",
        "vector_validation_report": """SELECT CASE WHEN vector IS NULL THEN 'null_vector' WHEN len(vector) <> 50 THEN 'wrong_length'
            WHEN len(list_filter(vector, lambda x: x IS NULL)) > 0 THEN 'null_component'
            WHEN len(list_filter(vector, lambda x: isnan(x) OR isinf(x))) > 0 THEN 'not_finite'
            WHEN len(list_filter(vector, lambda x: x <> 0)) = 0 THEN 'zero_norm' ELSE 'valid' END AS flaw, count(*) AS n FROM glove_embeddings GROUP BY flaw""",
        "subvector_slice": _with(_E) + f"SELECT id, j::INTEGER AS m, v[j * {_W} + 1 : (j + 1) * {_W}]::DOUBLE[] AS part FROM e, range({M}) t(j)",
        "kmeans_centroids": _with(_E, km) + f"SELECT cid, v::DOUBLE[] AS centroid FROM {_C}",
        "kmeans_cosine_stop_rule": _with(_E, km, f"st AS MATERIALIZED ({moves})", f"stop AS (SELECT coalesce(min(r) FILTER (step < {COSINE_STOP}), {ROUNDS - 1}) AS r FROM st)") + f"SELECT cid, v::DOUBLE[] AS centroid FROM ({after}) JOIN stop USING (r)",
        "nearest_centroid_assignment": _with(_E, km) + "SELECT id, cid FROM a",
        "residual_vectors": _with(_E, km, rest) + "SELECT id, v::DOUBLE[] AS residual FROM r",
        "heldout_split_sample": f"SELECT vec_id AS id FROM embeddings WHERE vec_id >= {BASE_ROWS} ORDER BY md5('{SEED}:' || vec_id), vec_id LIMIT 20",
        "ivf_routing": _with(_E, _Q, km, probes) + "SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY coarse DESC, cid)::INTEGER AS rank, cid, round(coarse, 6) + 0.0 AS score FROM pr",
        "ivf_topk_full_probe": _with(_E, _Q) + _ranked(exact),
        "ivf_topk_nprobe2": _with(_E, _Q, km, probes) + _ranked(ivf2),
        "ivf_cluster_stats": _with(_E, km) + stats,
        "pq_codes": _with(_E, books) + "SELECT id, list(k ORDER BY m) AS codes FROM codes GROUP BY id",
        "pq_decode": _with(_E, books) + f"SELECT id, flatten(list(b.w ORDER BY codes.m))::DOUBLE[] AS vector FROM codes JOIN {_B} b USING (m, k) GROUP BY id",
        "pq_distance_table": _with(_E, _Q, books) + f"SELECT query_id, m, k, round({_l2('q.w', 'b.w')}, 6) + 0.0 AS value FROM {sub} q JOIN {_B} b USING (m)",
        "pq_dot_table": _with(_E, _Q, books) + f"SELECT query_id, m, k, round({_dot('q.w', 'b.w')}, 6) + 0.0 AS value FROM {sub} q JOIN {_B} b USING (m)",
        "pq_adc_topk": _with(_E, _Q, books, f"t AS MATERIALIZED (SELECT query_id, m, k, {_l2('q.w', 'b.w')} AS d FROM {sub} q JOIN {_B} b USING (m))")
        + _ranked("SELECT query_id, id, list_sum(list(d ORDER BY m)) AS s FROM t JOIN codes USING (m, k) GROUP BY query_id, id", "ASC"),
        "ivfpq_topk": _with(_E, _Q, km, probes, rest, rest_books, f"t AS MATERIALIZED (SELECT query_id, m, k, {_dot('q.w', 'b.w')} AS d FROM {sub} q JOIN {_B} b USING (m))")
        + _ranked("SELECT query_id, id, any_value(coarse) + list_sum(list(d ORDER BY m)) AS s FROM pr JOIN a USING (cid) JOIN codes USING (id) JOIN t USING (query_id, m, k) GROUP BY query_id, id"),
        "ivfpq_cluster_stats": _with(_E, km) + stats,
        "memory_report": f"""SELECT 'exact' AS method, {4 * DIMS}::BIGINT AS bytes_per_vector, {n_all} * {4 * DIMS} AS total_bytes, 1.0::DOUBLE AS compression
            UNION ALL SELECT m, {M}::BIGINT, {n_all} * {M}, {4 * DIMS / M}::DOUBLE FROM (VALUES ('pq'), ('ivfpq')) t(m)""",
        "recall_at_k_ivf": _with(_E, _Q, km, probes, f"x AS ({_ranked(exact)})", f"y AS ({_ranked(ivf2)})")
        + "SELECT x.query_id, round(count(y.id) / count(*), 6) AS recall FROM x LEFT JOIN y USING (query_id, id) GROUP BY x.query_id",
        "qps_summary": f"""SELECT method, median(qps) AS median_mid, list(qps ORDER BY qps)[(len(list(qps)) // 2) + 1] AS median_upper, min(qps) AS qps_min, max(qps) AS qps_max
            FROM (VALUES {samples}) t(method, qps) GROUP BY method""",
        "score_checksum": _with(_E, _Q) + f"SELECT round(sum(s), 4) AS checksum FROM (SELECT query_id, max(s) AS s FROM ({exact}) GROUP BY query_id)",
        "hnsw_topk_grown": _with(_E, _Q) + _ranked(exact),
        "hnsw_topk_full_beam": _with(_E, _Q) + _ranked(exact),
        "hnsw_unreachable": f"""WITH RECURSIVE g(src, dst) AS (VALUES {edges}), r(id) AS (SELECT 0 UNION SELECT dst FROM r JOIN g ON g.src = r.id)
            SELECT count(*)::BIGINT AS unreachable FROM (SELECT src AS id FROM g UNION SELECT dst FROM g) WHERE id NOT IN (SELECT id FROM r)""",
        "glove_text_scan": "SELECT (row_number() OVER (ORDER BY vec_id) - 1)::BIGINT AS id, 'w' || vec_id AS term, embedding::DOUBLE[] AS vector FROM embeddings",
        "substring_search": f"SELECT doc_id FROM documents WHERE contains(text, '{NEEDLE}')",
        "log_roundtrip": log + ", true AS sound FROM eval_items",
        "log_torn_tail": f"{log}, true AS sound FROM eval_items UNION ALL SELECT count(*), 'after the crash', true FROM eval_items",
        "log_stream_replay": log + " FROM eval_items",
    }
