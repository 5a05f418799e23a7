"""The pipeline's stages on a small folder, against plain versions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from subsumer.llm import mixing, pieces
from test_text import docs_of, labelled


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    docs, labels = labelled(spark)
    docs.drop("size", "_x").write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_one_of_each_group_stays(spark, folder):
    words = [f"w{k}" for k in range(60)]
    near, text = " ".join([*words[:-1], "x"]), " ".join(words)
    rows = [(5, text, "s"), (3, near, "s"), (None, text, "s"), (None, text, "s"), (8, "quite another", "s"), (8, "and one more", "s"), (9, None, "s")]
    got = corpus_pipeline.drop_near_duplicates(spark, docs_of(spark, rows).drop("size", "_x"), folder).select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(3, near), (None, text), (None, text), (8, "and one more"), (9, None)])


def test_mix_weighs_and_numbers_copies(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 240").withColumn("source", F.concat(F.lit("s"), F.floor(F.col("doc_id") / 80)))
    bad = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("quality = 0").collect()}
    weighed = mixing.mix_sources(docs, quality=F.when(F.col("doc_id").isin(sorted(bad)), 0.25).otherwise(1.0))
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in weighed.collect()}
    got = corpus_pipeline.mix(spark, docs, folder).collect()
    assert sorted((r["doc_id"], r[corpus_pipeline.COPY]) for r in got) == sorted((i, c) for i, n in times.items() for c in range(n))
    plain = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_sources(docs).collect()}
    assert times != plain and max(times.values()) == 2


def odd(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, size string, taken array<int>, target map<string,int>, _copy int, copy string"
    row = lambda i, t, s, x: (i, t, None, s, None, x, [1], {"a": 1}, 7, x)
    words = " ".join(f"w{k}" for k in range(30))
    rows = [row(1, words, "a", "p"), row(1, words, "a", "q"), row(1, "other words", "a", "r"), row(2, words, None, "s"), row(None, words, "b", "t"), row(3, None, "a", "u"), row(4, "", None, "v"), row(5, "one " * 50_000, "b", "w")]
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES[:-1]])
def test_odd_rows_and_columns_pass_through(spark, folder, stage):
    docs = odd(spark)
    got = stage(spark, docs, folder)
    known = {(r["doc_id"], r["text"], r["size"], r["copy"]) for r in docs.collect()}
    found = got.collect()
    assert {(r["doc_id"], r["text"], r["size"], r["copy"]) for r in found} <= known and [c for c in got.columns if c != corpus_pipeline.COPY] == [c for c in docs.columns if c != corpus_pipeline.COPY]
    assert all(r["taken"] == [1] and r["target"] == {"a": 1} for r in found)
    assert stage(spark, docs.limit(0), folder).count() == 0
    if stage is corpus_pipeline.drop_near_duplicates:
        assert sorted(str(r["doc_id"]) for r in found) == ["1", "3", "4", "5", "None"]
        assert next(r["text"] for r in found if r["doc_id"] == 1) == "other words"
    last = corpus_pipeline.to_pieces(spark, docs, folder)
    assert {r["doc_id"]: len(r["ids"]) for r in last.where("doc_id in (3, 4)").collect()} == {3: 0, 4: 0}


def test_run_is_its_stages(spark, folder):
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    safe = corpus_pipeline.drop_toxic(spark, docs, folder)
    good = corpus_pipeline.keep_good(spark, safe, folder)
    assert 0 < good.count() < safe.count() < docs.count()
    mixed = corpus_pipeline.mix(spark, corpus_pipeline.drop_near_duplicates(spark, good, folder), folder)
    codec = pieces.Codec(pieces.Dropout(public_tokenizers.path("piece_bpe_32k.model")))
    wanted = Counter((r["doc_id"], codec.encode([r["text"] or ""], [r["doc_id"] or 0], [r[corpus_pipeline.COPY]])[0]) for r in mixed.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert wanted and Counter((r["doc_id"], b"".join(i.to_bytes(4, "little") for i in r["ids"])) for r in got) == wanted
