"""Registered queries of the corpus operators and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.align import align_tokenizers
from tidemark.llm.centroids import cluster_vectors
from tidemark.llm.exact_dedup import exact_duplicates
from tidemark.llm.lm import score_texts
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_dedup import near_duplicates
from tidemark.llm.packing import pack_sequences
from tidemark.llm.repeats import remove_repeats
from tidemark.llm.secrets import BASE_RULES, scan_secrets
from tidemark.llm.topk import top_k
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.warc import read_warc, write_warc
from tidemark.llm.windows import remove_repeated_windows
from tidemark.sources.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SQL_PAYLOADS = """
WITH paid AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
hashed AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS hex FROM paid),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS top FROM hashed)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform([15, 10, 5, 0],
    lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + CAST((CAST('0x' || substr(hex, CAST(5 * g + 1 AS BIGINT), 5) AS BIGINT) >> b) & 31 AS BIGINT), 1)),
    'string_agg', '')), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM grouped
"""


@_register("op1_warc", _SQL_PAYLOADS)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages into archives and reads the records back."""
    manifest = write_warc(_table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long")
    return read_warc(spark, manifest, payloads=False).select(
        number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        number(F.col("refers_to")).alias("refers_to"),
    )


_SQL_SECRETS = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
rules(kind, no, pat, least) AS (VALUES
  ('assign', 0, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 6),
  ('access', 1, '(AKIA[A-Z0-9]+)', 20), ('hex', 2, '([0-9a-f]+)', 24)),
cut AS (SELECT doc_id, kind, no, least,
  CASE no WHEN 0 THEN regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
          WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS hits,
  CASE no WHEN 0 THEN regexp_extract_all(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1)
          WHEN 1 THEN regexp_extract_all(t, 'AKIA[A-Z0-9]+') ELSE regexp_extract_all(t, '[0-9a-f]+') END AS held,
  CASE no WHEN 0 THEN string_split_regex(t, '(?:(?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+')
          WHEN 1 THEN string_split_regex(t, 'AKIA[A-Z0-9]+') ELSE string_split_regex(t, '[0-9a-f]+') END AS gaps
  FROM texts, rules),
flat AS (SELECT doc_id, kind, no, least, unnest(hits) AS hit, unnest(held) AS held,
  unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM cut WHERE len(hits) > 0),
placed AS (SELECT doc_id, kind, no, least, held, length(hit) AS n,
  sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop FROM flat),
good AS (SELECT doc_id, kind, no, CAST(stop - n AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
  FROM placed WHERE length(held) >= least),
listed AS (SELECT doc_id, count(*) FILTER (no = 0) AS a, count(*) FILTER (no = 1) AS b, count(*) FILTER (no = 2) AS c,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, no) AS s FROM good GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(s, '')) AS base_sha256, coalesce(s, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""


@_register("op2_secrets", _SQL_SECRETS)
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents against a new ledger. The method adds no spans of its own."""
    found = scan_secrets(_table(spark, sf_dir, "documents"), new_folder(spark, "secret-ledger"))
    names = F.array(*(F.lit(r.kind) for r in BASE_RULES))
    told = F.array_join(
        F.transform("spans", lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{r.kind}") for k, r in enumerate(BASE_RULES)),
        F.sha2(told, 256).alias("base_sha256"),
        told.alias("spans"),
    )


@_register(
    "op4_exact_dedup",
    r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  sha256(t) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
""",
)
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"), digest_all=True)


_SQL_MIX = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5('mix:' || doc_id) AS o FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM totals),
r AS (SELECT *, source_size * 3.0::DOUBLE AS cap, source_size * 3.0::DOUBLE / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
open AS (SELECT ratio AS r0, level AS l0 FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN l0 IS NULL OR ratio < r0 THEN cap ELSE least(cap, weight * l0) END AS target
  FROM l LEFT JOIN open ON true),
q AS (SELECT doc_id, s.source, size, o, source_size, target,
  sum(size) OVER (PARTITION BY s.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e
  FROM sized s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(e + again * source_size AS DOUBLE) / target AS f FROM q, (VALUES (0), (1), (2)) AS p(again) WHERE size > 0),
run AS (SELECT doc_id, sum(size) OVER (ORDER BY f, source NULLS FIRST, o, doc_id, again
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM c),
k AS (SELECT doc_id, count(*) AS n FROM run WHERE upto <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(n, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (doc_id)
"""


@_register("op7_mix", _SQL_MIX)
def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@_register("op9_minhash")
def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


@_register("op10_pack")
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_sequences(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def fold(id_column, folds: int = 5):
    """crc32 of the id as text modulo ``folds``."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))


@_register("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the rows whose fold is 0 are never learned."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, learns=lambda key: fold(key) != 0)
    scored = score_toxicity(docs, model)
    return scored.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted"
    )


@_register("op8_lm_score")
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from all rows but those of fold 1."""
    scored = score_texts(_table(spark, sf_dir, "documents"), learns=lambda key: fold(key) != 1)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@_register("op5_repeats")
def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeats(_table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register(
    "op3_topk",
    """
WITH good AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
  FROM good q JOIN good p ON q.vec_id <> p.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
)
def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def _sql_clusters(rounds: int = 10, clusters: int = 8) -> str:
    """The rounds one after another; ``g`` is a round's assignment, ``c`` its centroids."""
    near = """g{0} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
  SELECT vec_id, k, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS d FROM v JOIN c{0} c USING (i) GROUP BY vec_id, k) GROUP BY vec_id)"""
    moved = """c{1} AS MATERIALIZED (SELECT c.k, c.i, coalesce(m.x, c.x) AS x FROM c{0} c LEFT JOIN (
  SELECT k, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM v JOIN g{0} USING (vec_id) GROUP BY k, i) m USING (k, i))"""
    steps = [near.format(0)]
    for r in range(rounds):
        steps += [moved.format(r, r + 1), near.format(r + 1)]
    return f"""
WITH kept AS (SELECT vec_id, embedding AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT vec_id, unnest(range(1, 65)) AS i, CAST(floor(1024 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM kept),
f AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS k FROM kept QUALIFY k < {clusters}),
c0 AS (SELECT k, i, x FROM v JOIN f USING (vec_id)),
{", ".join(steps)},
h AS (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS hash FROM c{rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, hash AS centroid_sha256 FROM g{rounds} JOIN h USING (k)
"""


@_register("op13_centroids", _sql_clusters())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds with eight centroids over all vectors of 64 components."""
    clustered = cluster_vectors(_table(spark, sf_dir, "embeddings"))
    told = F.array_join(F.transform("centroid", lambda x: x.cast("string")), ",")
    return clustered.select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(told, 256).alias("centroid_sha256")
    )


@_register(
    "op12_substrings",
    r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM w),
starts AS (SELECT doc_id, i, concat_ws(' ', word, """
    + ", ".join(f"lead(word, {k}) OVER o" for k in range(1, 12))
    + r""") AS t, lead(word, 12) OVER o AS last FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t, last) AS least FROM starts WHERE last IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM g WHERE least < doc_id),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
""",
)
def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents."""
    removed = remove_repeated_windows(_table(spark, sf_dir, "documents"))
    return removed.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"]).alias("n_removed"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@_register("op11_align")
def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between two public vocabularies over all documents."""
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    aligned = align_tokenizers(_table(spark, sf_dir, "documents"), *paths)
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256"),
    )
