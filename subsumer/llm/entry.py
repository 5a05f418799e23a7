"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, cover_tree, fit, licenses, line_quality, mixing, near_dups, pieces, repeats, resampling, token_blocks, toxicity, warc, yinyang
from .common import scratch_path


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back: size, digest and kind of each."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    path = scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    return warc.resolve_revisits(warc.read_archives(spark, path, payloads=False))


def op2_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors found, by cosine, of every vector whose id is divisible by 50."""
    rows = _read(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1, ... and share 150 % of all words; bad documents are drawn less."""
    labels = _read(spark, sf_dir, "labels")
    quality = labels.select("doc_id", F.when(F.col("quality") == 0, 0.25).otherwise(1.0).alias("quality"))
    return mixing.mix_rows(_read(spark, sf_dir, "documents"), quality).select("doc_id", "size", "source_size", "target", "taken")


def op4_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written in patched frame-of-reference blocks and read back."""
    path = scratch_path(spark, "ids")
    token_blocks.write_ids(_read(spark, sf_dir, "documents"), path, tokenizer=public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    read = token_blocks.with_starts(token_blocks.read_ids(spark, path, digest_only=True))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return licenses.license_labels(licenses.license_spans(_read(spark, sf_dir, "documents")))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates on 4-word shingles."""
    return near_dups.near_duplicates(_read(spark, sf_dir, "documents"), near_dups.Near(words=4))


def op7_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids with merge-dropout, and whether decoding them gives its text back."""
    settings = pieces.Dropout(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.round_trips(settings, _read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, by a classifier fitted on labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", fit.held_out().alias("held_out"), toxicity.toxicity_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op9_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality, by a field of lines fitted on labels that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    model = line_quality.fit_quality(docs, _read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", fit.held_out().alias("held_out"), line_quality.quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op10_dual_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every vector whose id is divisible by 50."""
    rows = _read(spark, sf_dir, "embeddings")
    return cover_tree.largest_products(rows, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's words, and the rank of those that are drawn."""
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of strings of 100 that start earlier, too."""
    return repeats.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept")


def op13_yinyang_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after five rounds, and what the cluster is like."""
    return yinyang.cluster(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_segments": op1_warc_segments,
    "op2_posting_lists": op2_posting_lists,
    "op3_source_mix": op3_source_mix,
    "op4_token_blocks": op4_token_blocks,
    "op5_license_scan": op5_license_scan,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_merge_dropout": op7_merge_dropout,
    "op8_toxicity": op8_toxicity,
    "op9_line_quality": op9_line_quality,
    "op10_dual_tree": op10_dual_tree,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_repeats": op12_suffix_repeats,
    "op13_yinyang_clusters": op13_yinyang_clusters,
}

#: The words of a text, A-Z lower-cased.
_WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def _clusters_sql(k: int, rounds: int) -> str:
    """Rounds of assignments and floored means, written one after the other."""
    nearest = """(
            SELECT vec_id, x, arg_min(struct_pack(j := j, c := c, d := d), (d, j)) AS n FROM (
                SELECT v.vec_id, v.x, m.j, m.c, list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - m.c[i]) * (v.x[i] - m.c[i])))::BIGINT AS d
                FROM v, {means} m) GROUP BY vec_id, x)"""
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED {nearest.format(means=f'm{i}')}")
        steps.append(f"""m{i + 1} AS MATERIALIZED (
            SELECT m.j, coalesce(s.c, m.c) AS c FROM m{i} m LEFT JOIN (
                SELECT j, list(f ORDER BY i) AS c FROM (
                    SELECT n.j AS j, i, floor(sum(x[i]) / count(*))::BIGINT AS f FROM a{i}, range(1, 65) AS r(i) GROUP BY n.j, i) GROUP BY j) s USING (j))""")
    return f"""
        WITH v AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, x AS c FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),
        {", ".join(steps)},
        a AS MATERIALIZED {nearest.format(means=f'm{rounds}')}
        SELECT vec_id, n.j::INTEGER AS cluster, n.d AS distance, (sum(n.d) OVER (PARTITION BY n.j))::BIGINT AS cluster_inertia,
               (sum(n.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(n.c, ',')) AS centroid_sha256 FROM a"""


SQL: dict[str, str] = {
    "op1_warc_segments": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
        h AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS hex FROM p),
        d AS (
            SELECT page_id, n, list_aggregate(list_transform(range(0, 32), lambda i:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                       1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INTEGER), 1)),
                'string_agg', '') AS digest
            FROM h),
        m AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first FROM d)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
        FROM m""",
    "op10_dual_tree": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
              AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
        WHERE rank <= 5""",
    "op11_importance_resampling": f"""
        WITH t AS (
            SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
                   lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
        d AS (SELECT row_number() OVER () AS i, doc_id, {_WORDS_SQL} AS w FROM documents),
        b AS (SELECT unnest({_WORDS_SQL}) AS w FROM benchmark),
        dw AS (SELECT i, unnest(w) AS w FROM d),
        v AS (
            SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * octet_length(encode(w)), 2),
                       lambda k: ('0x' || substr(hex(encode(w)), k, 2))::BIGINT)),
                       lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 10000 AS bucket
            FROM (SELECT w FROM dw UNION SELECT w FROM b), t),
        raw AS (SELECT bucket, count(*) AS s FROM dw JOIN v USING (w) GROUP BY bucket),
        aim AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY bucket),
        g AS (
            SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM raw) + 10000)::DOUBLE
                   / ((s + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM aim), 0) + 10000)::DOUBLE))) AS gain
            FROM raw LEFT JOIN aim USING (bucket)),
        sums AS (SELECT i, floor(sum(gain) / count(*)) AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY i),
        scored AS (
            SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
                   (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score
            FROM d LEFT JOIN sums USING (i)),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS r,
                   10 * count(*) OVER (PARTITION BY n_features >= 20) // 100 AS most FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND r <= most THEN r END AS rank FROM ranked""",
    "op13_yinyang_clusters": _clusters_sql(40, 5),
}
