"""A mixture of sources in which each has its target share of the tokens.

Efraimidis-Spirakis sampling without replacement: each document draws an
exponential key scaled by its quality, ``-ln(u) / weight``, and a source takes
documents in the order of their keys until its token budget is met.  Whole
epochs of a small source come first; only the fraction that remains is
selected.  The draw is a hash of the document id and a seed, so it can be
repeated exactly, by a restarted task too.

The order within a source is never made by one task.  Keys are counted in fine
bins of their logarithm, as fine as the number of documents asks for, and
neighbouring bins make buckets of an even counted size; token sums before each
bucket give its offset, and only within a bucket are documents sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.measure import TOKENIZER, measure
from chronoweave.sources.scratch import materialize

#: A bin of the logarithm of the keys holds at most this share of a source, for
#: any mixture of qualities: the greatest density of log2 of an exponential, ln(2)/e.
BIN_SHARE = math.log(2) / math.e


def sampling_keys(measured: DataFrame, seed: int = 17) -> DataFrame:
    """Adds ``key``: exponential, scaled by quality.

    The draw is a hash of the document id; documents without one draw by what
    was measured of them, so that they do not share a draw.
    """
    own = F.xxhash64("doc_id", F.lit(seed))
    if "x" in measured.columns:
        own = F.when(F.col("doc_id").isNotNull(), own).otherwise(F.xxhash64("source", "tokens", "x", "y", "z", "quality", F.lit(seed)))
    bits = F.shiftrightunsigned(own, 12)
    u = (bits.cast("double") + 0.5) / F.lit(float(1 << 52))
    return measured.withColumn("key", -F.log(u) / F.greatest("quality", F.lit(1e-3)))


def key_buckets(keyed: DataFrame, bucket_rows: int) -> DataFrame:
    """(source, bin, bucket, offset): the bins of the keys, gathered in buckets of about ``bucket_rows`` documents.

    ``keyed`` has ``bin``.  ``offset`` is the number of tokens of the source in
    the buckets before.  The windows run over bins, whose number depends on how
    fine they are and not on the documents in them.
    """
    bins = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = bins.select("source", "bin", F.floor(upto("rows") / bucket_rows).alias("bucket"), upto("tokens").alias("upto"))
    return placed.select("source", "bin", "bucket", F.min("upto").over(Window.partitionBy("source", "bucket")).alias("offset"))


def binned(keyed: DataFrame, documents: int, bucket_rows: int) -> DataFrame:
    """Adds ``bin``, monotone in the key and so fine that no bin of a source exceeds ``bucket_rows`` documents."""
    fine = max(1.0, BIN_SHARE * documents / bucket_rows)
    return keyed.withColumn("bin", F.floor(F.log2("key") * F.lit(fine)).cast("bigint"))


def budgets(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, available, target_share, max_repeats, budget, epochs, remainder).

    One row per source with a positive share.  Without ``total_tokens`` the
    mixture is the largest in which every source can still give its share
    within its repeats; a source of the targets that has no tokens cannot limit
    it.  A budget beyond the repeats is cut to them.
    """
    clean = (
        targets.where("source is not null and target_share > 0")
        .groupBy("source")
        .agg(F.max("target_share").alias("target_share"), F.greatest(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))
    )
    joined = clean.join(sizes, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    if total_tokens is None:
        limit = joined.where("available > 0 and max_repeats > 0").agg(F.min(F.col("available") * F.col("max_repeats") / F.col("target_share")).alias("t")).first()["t"]
        total_tokens = int(math.floor(limit)) if limit else 0
    budget = F.least(F.floor(F.col("target_share") * F.lit(total_tokens)), F.col("available") * F.col("max_repeats"))
    epochs = F.coalesce(F.try_divide(F.col("budget"), F.col("available")).cast("bigint"), F.lit(0).cast("bigint"))
    return (
        joined.withColumn("budget", budget.cast("bigint"))
        .withColumn("epochs", epochs)
        .withColumn("remainder", F.col("budget") - F.col("epochs") * F.col("available"))
    )


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, **how) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan) of texts; see ``mix_measured``."""
    return mix_measured(measure(documents, tokenizer), targets, **how)


def mix_measured(measured: DataFrame, targets: DataFrame, seed: int = 17, total_tokens: int | None = None, bucket_rows: int = 50_000) -> tuple[DataFrame, DataFrame]:
    """(mixture, plan) of measured documents: the documents used, with how often, and the budget per source.

    Mixture: doc_id, source, tokens, uses.  A document is used once per epoch,
    and once more if the fractional selection takes it; never more than
    max_repeats times.  Selection goes by key until the budget is met; the
    document at the border is taken if that brings the sum nearer to it.
    Documents without tokens or of sources without target are not used; rows
    with a NULL doc_id are documents like others.  ``bucket_rows`` bounds what
    one task sorts; it does not change the selection.
    """
    keyed = sampling_keys(measured.where("tokens > 0"), seed).select("doc_id", "source", "tokens", "key")
    written = materialize(keyed, "mix-sizes")
    keys = binned(written, written.count(), bucket_rows)
    plan = materialize(budgets(keys.groupBy("source").agg(F.sum("tokens").alias("available")), targets, total_tokens), "mix-plan")
    bounded = plan.select("source", "epochs", "remainder", "max_repeats").join(key_buckets(keys, bucket_rows), "source")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "tokens").rowsBetween(Window.unboundedPreceding, -1)
    placed = keys.join(bounded, ["source", "bin"]).withColumn("upto", F.col("offset") + F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    extra = ((F.col("upto") + F.col("tokens") / 2) <= F.col("remainder")) & (F.col("epochs") < F.col("max_repeats"))
    mixture = placed.select("doc_id", "source", "tokens", (F.col("epochs") + extra.cast("bigint")).alias("uses")).where("uses > 0")
    return mixture, plan


def shares(mixture: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source of the targets: what was asked and what was reached."""
    per = mixture.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens_used"), F.max("uses").alias("most_uses")
    )
    # One row per source; written, so that the mixture is made once.
    reached = materialize(per, "mix-reached")
    total = reached.agg(F.sum("tokens_used")).first()[0] or 0
    return plan.join(reached, "source", "left").select(
        "source", "target_share", "max_repeats", "available", "budget", "epochs",
        *(F.coalesce(c, F.lit(0)).alias(c) for c in ("documents", "tokens_used", "most_uses")),
        F.coalesce(F.try_divide(F.col("tokens_used"), F.lit(total)), F.lit(0.0)).alias("actual_share"),
    )
