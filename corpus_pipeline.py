"""A corpus from raw documents: toxic and bad ones go, one of each group of near duplicates stays, sources are mixed, texts become pieces.

Of every stage: whole texts are read, however long; null and empty texts are empty; an empty table stays empty; rows that
repeat stay as often as they are, except where near duplicates go; further columns, whatever their names, pass through
all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subsumer.llm import line_quality, mixing, near_dups, pieces, toxicity
from subsumer.llm.common import small_join, table

#: The column in which the mix numbers a document's copies; one of that name in documents is replaced.
COPY = "_copy"
#: Scores from which a document is rejected as toxic, and from which one is kept as good.
TOXIC, GOOD = 0.5, 0.3


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose toxicity is below TOXIC; null and empty texts are scored as empty. Equal texts go or stay together."""
    model = toxicity.fit_toxicity(docs, _labels(spark, sf_dir))
    return docs.where(toxicity.toxicity_score(model, docs) < TOXIC)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose quality is GOOD at least; null and empty texts are scored as one blank line. Equal texts go or stay together."""
    model = line_quality.fit_quality(docs, _labels(spark, sf_dir))
    return docs.where(line_quality.quality_score(model, docs) >= GOOD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (5-word shingles, 0.8) the document with the smallest doc_id.

    Rows with a null doc_id, and texts without words, stay. Rows that repeat a doc_id become one: that with the smallest text
    (null first), of equal texts that whose other columns have the smallest hash.
    """
    found = table(near_dups.near_duplicates(docs), "near-duplicates")
    gone = found.where("not kept and doc_id is not null").select("doc_id").distinct()
    kept = small_join(docs, gone, ["doc_id"], "left_anti", near_dups.BROADCAST_IDS)
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if not repeated.head(1):
        return kept
    whole = F.struct(*docs.columns)
    order = F.struct("text", F.xxhash64(F.to_json(whole)))
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, order).alias("r"))
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select("r.*"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its complete epochs, and once more if at least half of it is taken besides. COPY counts them from 0.

    Documents that are labelled bad are drawn less, as in op3. Null sources are a source; texts without words are in no mix.
    """
    known = _labels(spark, sf_dir).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 0, 0.25).otherwise(1.0)).alias("_quality")).where("_quality < 1")
    # the mix's own columns stand beside those of documents
    own = [c for c in docs.columns if c != COPY]
    held = docs.select("doc_id", "source", "text", F.struct(*own).alias("_document"))
    mixed = mixing.mix_sources(small_join(held, known, ["doc_id"], "left", near_dups.BROADCAST_IDS), quality=F.col("_quality"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return mixed.select("_document", F.posexplode(F.array_repeat(F.lit(1), times)).alias(COPY, "_one")).select("_document.*", COPY)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids): the pieces of each document, with merge-dropout that differs from copy to copy; null and empty texts have none."""
    settings = pieces.Dropout(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.encoded_rows(settings, docs, F.col(COPY))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mix", mix),
    ("pieces", to_pieces),
]

#: SQL can express neither the classifiers nor the dropout: tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
