"""Mixing sources to target weights: weighted sampling by exponential keys, up to a budget of words for each source."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum, small_join, table, text_of

#: The sources' weights in the order of their names, repeating.
WEIGHTS = (5, 2, 1)
#: A key's place among all keys has two digits of so many bits.
DIGIT_BITS = 12


@dataclass(frozen=True)
class Mix:
    """total: words of the mix as a share of all words; most: epochs of a source at most."""

    weights: tuple[float, ...] = WEIGHTS
    total: float = 1.5
    most: float = 2.0
    seed: int = 17


def n_words(text: Column | str) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in the text; null: 0."""
    return F.regexp_count(text_of(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _keyed(docs: DataFrame, quality: Column, mix: Mix) -> DataFrame:
    """docs with the source's key (null last), the row's hash, its size, exponential key and the key's place."""
    source = F.col("source").cast("string")
    row_hash = F.xxhash64(F.lit(mix.seed), F.col("doc_id"), text_of("text"))
    keyed = (
        docs.withColumn("_source", F.when(source.isNull(), "1").otherwise(F.concat(F.lit("0"), source)))
        .withColumn("_row", row_hash)
        .withColumn("size", n_words("text"))
    )
    return _placed(keyed, quality, mix)


def _placed(rows: DataFrame, quality: Column, mix: Mix) -> DataFrame:
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(mix.seed + 1), "_row"), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    weight = F.coalesce(F.nanvl(quality.cast("double"), F.lit(1.0)), F.lit(1.0))
    key = -F.log(uniform) / F.when(weight > 0, weight).otherwise(1.0)
    half = 1 << 2 * DIGIT_BITS - 1  # documents of no weight are in the upper half of the places
    place = F.least(F.floor((1 - F.exp(-F.col("_key"))) * half), F.lit(half - 1)) + F.when(weight > 0, 0).otherwise(half)
    return rows.withColumn("_key", key).withColumn("_place", place.cast("long"))


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(_source, source_size) with `target`: shares by weight, cut at `most` times the size, the rest shared again.

    In the end every target is min(most * size, level * weight); the level rises from one row of sums a round
    until no further source is cut.
    """
    ranked = running_sum(sizes.withColumn("_one", F.lit(1)), ["_source"], "_one", "_rank").drop("_one")
    weight = F.element_at(F.array(*map(F.lit, map(float, mix.weights))), (F.col("_rank") % len(mix.weights) + 1).cast("int"))
    ranked = table(ranked.withColumn("_weight", weight).withColumn("_most", F.col("source_size") * mix.most), "sources")
    level, cut = 0.0, -1
    words = ranked.agg(F.sum("source_size")).first()[0] or 0
    while True:
        above = F.col("_most") < F.lit(level) * F.col("_weight")
        row = ranked.agg(F.count_if(above).alias("cut"), F.sum(F.when(above, F.col("_most"))).alias("fixed"), F.sum(F.when(~above, F.col("_weight"))).alias("open")).first()
        if row["cut"] == cut or not row["open"]:
            break
        cut, level = row["cut"], (mix.total * words - (row["fixed"] or 0.0)) / row["open"]
    return ranked.select("_source", "source_size", F.least("_most", F.lit(level) * F.col("_weight")).alias("target"))


@dataclass(frozen=True)
class Decisions:
    """A mix of a table: one row for each source, and one for each document at the end of a source's selection."""

    budgets: DataFrame
    last: DataFrame

    def taken(self, keyed: DataFrame) -> DataFrame:
        """keyed with source_size, target and taken; the helping columns go."""
        out = small_join(keyed.drop("source_size", "target", "taken", "_epochs", "_left", "_digits"), self.budgets, ["_source"])
        out = small_join(out, self.last, ["_source", "_row"], "left")
        part = F.when(F.col("_place") < F.col("_digits"), F.col("size")).otherwise(F.coalesce("_got", F.lit(0)))
        out = out.withColumn("taken", (F.col("_epochs") * F.col("size") + part).cast("long"))
        return out.drop("_source", "_row", "_key", "_place", "_epochs", "_left", "_digits", "_got")


def decide(small: DataFrame, mix: Mix) -> Decisions:
    """The decisions for a written table of (doc_id, _source, _row, size, _key, _place)."""
    sizes = small.groupBy("_source").agg(F.sum("size").alias("source_size"))
    left = F.round("target").cast("long") - F.col("_epochs") * F.col("source_size")
    budgets = (
        source_targets(sizes, mix)
        .withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("_left", left)
        .withColumn("_digits", F.lit(0).cast("long"))
    )
    for shift in (DIGIT_BITS, 0):
        budgets = _descend(small, budgets, shift)
    last = small_join(small, budgets, ["_source"]).where(F.col("_place") == F.col("_digits"))
    last = last.groupBy("_source", "doc_id", "_row").agg(F.count("*").alias("_copies"), F.sum("size").alias("_sum"), F.min("_key").alias("_key"), F.first("_left").alias("_left"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_source").orderBy("_key", F.col("doc_id").asc_nulls_first(), "_row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    got = F.greatest(F.lit(0), F.least(F.col("_sum"), F.col("_left") - before))
    last = last.select("_source", "_row", F.floor(got / F.col("_copies")).cast("long").alias("_got"))
    return Decisions(budgets, table(last, "mix-last"))


SMALL = ("doc_id", "_source", "_row", "size", "_key", "_place")


def mix_sources(docs: DataFrame, *, quality: Column | None = None, mix: Mix = Mix()) -> DataFrame:
    """docs (doc_id, source, text, ...) with size, source_size, target and taken (words that the mix takes, repeats counted).

    Each source's target is met by complete epochs first; what is left goes to the documents with the smallest
    keys -ln(u) / quality, u by a hash of seed, doc_id and text (so reruns agree), as far as their summed sizes
    reach; the document at the end is taken in part. quality: an expression on docs; null or NaN is 1, and documents
    of 0 or less come last, by the key that quality 1 would give them. Null sources are a source; null texts have size 0. Rows repeated in doc_id, source and
    text share what they get evenly, rounded down. Texts of any length are counted whole; equal keys go by doc_id. Columns of docs that are named like the results are replaced; an
    empty table stays empty.

    Texts are never shuffled, only keys and sums: the prefix sums descend over two digits of the key's place, then
    order the few documents of one place in each source.
    """
    keyed = _keyed(docs, F.lit(1.0) if quality is None else quality, mix)
    return decide(table(keyed.select(*SMALL), "mix-keys"), mix).taken(keyed)


def mix_rows(docs: DataFrame, quality: DataFrame, *, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source_size, target, taken) as mix_sources() gives them, with quality from a table (doc_id, quality).

    Documents without a row there have quality 1; of several rows for a document the largest counts (NaN, so 1, if there is one).
    Nulls, ties, repeated rows, long texts, other columns and empty tables are as in mix_sources().
    """
    sized = _keyed(docs, F.lit(1.0), mix).select("doc_id", "_source", "_row", "size")
    known = quality.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    joined = table(sized, "mix-sizes").join(known, "doc_id", "left")
    small = table(_placed(joined, F.col("_quality"), mix).select(*SMALL), "mix-keys")
    return decide(small, mix).taken(small)


def _descend(small: DataFrame, budgets: DataFrame, shift: int) -> DataFrame:
    """budgets with the next digit of the place where a source's prefix sum passes `_left`, and `_left` less what is before it.

    Where the prefix sum never passes it, the digit is one more than the largest: all documents are before.
    """
    digit = F.shiftrightunsigned(F.col("_place"), shift).cast("long")
    at = small_join(small, budgets, ["_source"]).where(F.shiftrightunsigned(digit, DIGIT_BITS) == F.col("_digits"))
    sums = at.groupBy("_source", digit.alias("_digit")).agg(F.sum("size").alias("_sum"), F.first("_left").alias("_limit"))
    sums = sums.withColumn("_upto", F.sum("_sum").over(Window.partitionBy("_source").orderBy("_digit")))
    reached = sums.groupBy("_source").agg(
        F.min(F.when(F.col("_upto") > F.col("_limit"), F.col("_digit"))).alias("_next"),
        F.max(F.when(F.col("_upto") <= F.col("_limit"), F.col("_upto"))).alias("_used"),
    )
    beyond = (F.col("_digits") + 1) * (1 << DIGIT_BITS) - 1
    out = budgets.join(reached, "_source", "left")
    out = out.withColumn("_digits", F.coalesce("_next", beyond)).withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0)))
    return table(out.drop("_next", "_used"), "mix-budgets")
