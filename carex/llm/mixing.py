"""Mixing sources to target shares of the total size (problem 9).

Tokens are summed per source. The mixture is the largest one in which every source keeps its share and none is used
more often than its cap: its size is the least, over the sources, of cap * tokens / share, and a source is repeated
at the rate share * size / tokens. Each document is emitted floor(rate) times, and once more if a hash of its id and
the seed falls below the fraction of the rate, so any executor takes the same decision again after a loss.

Null and edge cases: documents of a null source, or of one without a target, are left out. Empty and null texts
have no tokens and are emitted at the rate of their source. A source with a target but without tokens has no rate,
adds nothing and does not bound the size; the report shows the share it misses. Targets of share 0 or null, or with
a null cap, are left out. Repeated rows are rows of their own, but share their fate as they share the id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from carex.llm.tokens import token_counts

SEED = 20_240_601


def source_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, n_docs, n_tokens, rate) of each source with a target.

    sizes: source, n_docs, n_tokens. targets: the fixed table of shares, one row a source.
    """
    wanted = targets.where("source is not null and target_share > 0 and max_repeats > 0")
    known = wanted.join(sizes, "source", "left").select(
        "source",
        "target_share",
        "max_repeats",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
    )
    usable = known.where("n_tokens > 0")
    size = usable.agg(F.min(F.col("max_repeats") * F.col("n_tokens") / F.col("target_share")).alias("size"))
    rate = F.least(F.round(F.col("target_share") * F.col("size") / F.col("n_tokens"), 12), F.col("max_repeats"))
    return known.join(F.broadcast(size)).withColumn("rate", F.when(F.col("n_tokens") > 0, rate)).drop("size")


def copies(rate: Column, doc_id: Column, seed: int = SEED) -> Column:
    """How often a document is emitted."""
    draw = F.pmod(F.xxhash64(F.lit(seed), doc_id), F.lit(1 << 52)) / float(1 << 52)
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def _sizes(documents: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    counted = token_counts(documents.where("source is not null"), ["source"], **tokenizers)
    return counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def mixture(documents: DataFrame, targets: DataFrame, seed: int = SEED, **tokenizers: str) -> DataFrame:
    """(doc_id, source, copy_no, text): the records of the mixture. The rates are one row a source of the targets."""
    rates = source_rates(_sizes(documents, tokenizers), targets).where("rate is not null").select("source", "rate")
    chosen = documents.select("doc_id", "source", "text").join(F.broadcast(rates), "source")
    times = chosen.withColumn("times", copies(F.col("rate"), F.col("doc_id"), seed)).where("times > 0")
    return times.select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy_no"), "text")


def mixture_report(documents: DataFrame, targets: DataFrame, seed: int = SEED, **tokenizers: str) -> DataFrame:
    """What each source was to give and gives: shares of the tokens of the mixture that mixture() emits."""
    from carex.session import materialise

    counted = materialise(token_counts(documents.where("source is not null"), ["doc_id", "source"], **tokenizers))
    sizes = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    rates = source_rates(sizes, targets)
    used = counted.join(F.broadcast(rates.select("source", "rate")), "source").withColumn(
        "times", copies(F.col("rate"), F.col("doc_id"), seed)
    )
    given = used.groupBy("source").agg(
        F.sum("times").alias("n_records"), F.sum(F.col("times") * F.col("n_tokens")).alias("mixed_tokens")
    )
    total = given.agg(F.sum("mixed_tokens").alias("total"))
    return (
        rates.join(given, "source", "left")
        .join(F.broadcast(total))
        .select(
            "source", "target_share", "max_repeats", "n_docs", "n_tokens", "rate",
            F.coalesce("n_records", F.lit(0)).alias("n_records"),
            F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"),
            (F.coalesce("mixed_tokens", F.lit(0)) / F.col("total")).alias("actual_share"),
        )
    )
