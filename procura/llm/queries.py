"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_kmeans, bpe, collocations, exact_dedup, gif_media, html_text, packing, quality, secrets, simhash, suffix_dedup, toxicity
from .common import crc_bucket


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif_media.text_media(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = crc_bucket(F.col("doc_id"), 4)
    scored = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket != 2)
    return scored.select("doc_id", (bucket == 2).alias("held_out"), "score", "predicted", "offending")


def op4_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def owner_and_repository() -> tuple[Column, Column]:
    """The owner of a document is its source; each language of a source is a repository."""
    return F.col("source"), F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")))


def op5_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"), *owner_and_repository())


def op6_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_consensus_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op8_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op10_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bucket = crc_bucket(F.col("doc_id"), 5)
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bucket != 0)
    return scored.select("doc_id", (bucket == 0).alias("held_out"), "score", "predicted")


def op11_streaming_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet")


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(table(spark, sf_dir, "embeddings"))


def op13_apriori_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_gif_media, op2_simhash, op3_toxicity, op4_block_matrix_neighbours, op5_secret_ownership, op6_hierarchical_packing, op7_consensus_html, op8_suffix_runs, op9_bpe_round_trip, op10_positive_unlabelled_quality, op11_streaming_exact_dedup, op12_ball_kmeans, op13_apriori_collocations)}


OP4_SQL = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           sqrt(list_reduce(list_transform(range(1, len(c.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i])), lambda a, b: a + b)) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


OP8_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, b[s + 1:s + 100] AS k, s FROM (SELECT doc_id, b, unnest(range(n - 99)) AS s FROM d WHERE n >= 100)),
late AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM w) WHERE r > 1),
marked AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 100 THEN 0 ELSE 1 END AS fresh FROM late),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS z FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked) GROUP BY doc_id, run),
gaps AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs UNION ALL SELECT d.doc_id, coalesce(max(z), 0), any_value(n) FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, sha256(from_hex(string_agg(CASE WHEN y > x THEN hex(b[x + 1:y]) ELSE '' END, '' ORDER BY x))) AS kept_sha256 FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, CAST(coalesce(sum(z - a), 0) AS BIGINT) AS n_removed, count(z) AS n_spans, any_value(kept_sha256) AS kept_sha256 FROM d LEFT JOIN runs USING (doc_id) JOIN kept USING (doc_id) GROUP BY doc_id, n
"""


def secrets_sql() -> str:
    def matches(kind: int, pattern: str, group: int) -> str:
        e = "'" + pattern.replace("'", "''") + "'"
        return f"""
    SELECT rid, owner, repository, {kind} AS kind, i, length(gaps[i]) AS gap, length(raws[i]) AS n, vals[i] AS value
    FROM (SELECT *, regexp_split_to_array(t, {e}) AS gaps, regexp_extract_all(t, {e}, 0) AS raws, regexp_extract_all(t, {e}, {group}) AS vals
          FROM d WHERE regexp_matches(t, {e})), unnest(range(1, len(raws) + 1)) AS u(i)"""

    found = " UNION ALL ".join(matches(k, *secrets.PATTERNS[name]) for k, name in enumerate(secrets.KINDS))
    text = "concat(CASE kind " + " ".join(f"WHEN {k} THEN '{name}'" for k, name in enumerate(secrets.KINDS)) + " END, ':', \"start\", ':', \"end\")"
    return f"""
WITH d AS (
    SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
           concat(coalesce(source, ''), '/', coalesce(lang, '')) AS repository
    FROM documents),
f AS ({found}),
p AS (
    SELECT *, CAST(sum(gap + n) OVER (PARTITION BY rid, kind ORDER BY i) AS BIGINT) AS "end", md5(value) AS h FROM f),
g AS (
    SELECT *, "end" - n AS "start" FROM p
    WHERE (kind = 0 AND length(value) >= {secrets.ASSIGNED}) OR kind IN (1, 2)
       OR (kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]'))),
o AS (SELECT h, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM g GROUP BY h),
s AS (
    SELECT *, concat(owners, ':', repositories) AS held FROM (
        SELECT rid, kind, "start", owners < {secrets.SHARED_FROM} AND repositories < {secrets.SPREAD_FROM} AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AS live, owners, repositories, {text} AS span
        FROM g JOIN o USING (h)) WHERE kind < 3 OR live),
a AS (
    SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           string_agg(span, ',' ORDER BY "start", kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY "start", kind) AS spans,
           string_agg(span, ',' ORDER BY "start", kind) FILTER (live) AS live_spans, string_agg(span, ',' ORDER BY "start", kind) FILTER (NOT live) AS example_spans,
           string_agg(held, ',' ORDER BY "start", kind) AS held_by
    FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live_spans, '') AS live_spans, coalesce(example_spans, '') AS example_spans, coalesce(held_by, '') AS held_by
FROM d LEFT JOIN a USING (rid)
"""


OP11_SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""


def kmeans_sql(k: int = ball_kmeans.CLUSTERS, rounds: int = ball_kmeans.ROUNDS) -> str:
    """All rounds one after another; a centroid is a list of integers, and sums are exact."""
    assign = """
SELECT i, vec_id, q, unnest(arg_min({{c: c, d: d}}, (d, c))) FROM (
    SELECT i, vec_id, q, c, CAST(list_sum(list_transform(list_zip(q, m), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM v, c{r}) GROUP BY i, vec_id, q"""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED ({assign.format(r=r)})")
        if r < rounds:
            steps.append(f"""
u{r} AS MATERIALIZED (SELECT c, list(s ORDER BY j) AS m FROM (
    SELECT c, j, CAST((sum(x) - (CASE WHEN sum(x) % count(*) < 0 THEN sum(x) % count(*) + count(*) ELSE sum(x) % count(*) END)) // count(*) AS BIGINT) AS s
    FROM (SELECT c, unnest(q) AS x, unnest(range(1, len(q) + 1)) AS j FROM a{r}) GROUP BY c, j) GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(u.m, o.m) AS m FROM c{r} o LEFT JOIN u{r} u USING (c))""")
    return f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
    WHERE len(embedding) = {ball_kmeans.COMPONENTS} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
c0 AS MATERIALIZED (
    SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS c, q AS m FROM (SELECT q, sha256(concat('{ball_kmeans.SEED}:', CAST(vec_id AS VARCHAR))) AS h FROM v ORDER BY h, q LIMIT {k})),
{", ".join(steps)},
i AS (SELECT c, CAST(sum(d) AS BIGINT) AS t FROM a{rounds} GROUP BY c)
SELECT vec_id, a.c AS cluster, d AS distance, t AS cluster_inertia, CAST((SELECT sum(d) FROM a{rounds}) AS BIGINT) AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} a JOIN i ON i.c = a.c JOIN c{rounds} o ON o.c = a.c
"""


def collocations_sql(longest: int = collocations.WORDS, least: int = collocations.LEAST, inside: int = collocations.INSIDE, top: int = collocations.TOP) -> str:
    upper = "".join(map(chr, range(65, 91)))
    grams = " UNION ALL ".join(f"SELECT lang, w[i:i + {k - 1}] AS p FROM t, unnest(range(1, len(w) - {k - 2})) AS u(i)" for k in range(1, longest + 1))
    return rf"""
WITH s AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
        SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
t AS MATERIALIZED (SELECT * FROM s WHERE len(w) > 0),
f AS MATERIALIZED (SELECT lang, p, count(*) AS f FROM ({grams}) GROUP BY lang, p HAVING count(*) >= {least}),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM t GROUP BY lang),
c AS (SELECT lang, p, f AS a, k FROM f, unnest(range(1, len(p))) AS u(k)),
x AS (SELECT c.lang, c.p, c.a, k, l.f AS l, r.f AS r, CAST(CAST(2000000 AS HUGEINT) * a // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
      FROM c JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
b AS (SELECT lang, p, a, unnest(arg_min({{l: l, r: r, score: score}}, (score, k))) FROM x GROUP BY lang, p, a),
held AS (SELECT lang, q, max(f) AS f FROM (SELECT lang, f, p[i:i + size - 1] AS q FROM f, unnest(range(2, len(p))) AS z(size), unnest(range(1, len(p) - size + 2)) AS u(i)) GROUP BY lang, q),
g AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN held h ON h.lang = b.lang AND h.q = b.p WHERE h.f IS NULL OR CAST(100 AS HUGEINT) * h.f < CAST({inside} AS HUGEINT) * a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM g)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= {top}
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_streaming_exact_dedup": OP11_SQL, "op12_ball_kmeans": kmeans_sql(), "op13_apriori_collocations": collocations_sql(), "op4_block_matrix_neighbours": OP4_SQL, "op5_secret_ownership": secrets_sql(), "op8_suffix_runs": OP8_SQL}
