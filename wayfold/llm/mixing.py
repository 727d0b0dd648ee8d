"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit_draw(key: Column, seed: str) -> Column:
    """A number in (0, 1) that key and seed alone decide."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(key.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def poisson_inverse(u: Column, cdf: Column) -> Column:
    """How many values of a Poisson distribution function lie at or below u: the inverse of that distribution."""
    return F.size(F.filter(cdf, lambda c: c <= u))


def poisson_cdf(rate: Column, terms: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of a Poisson distribution with mean ``rate``, as an array of ``terms`` + 1 values."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("total"), F.array(F.exp(-rate)).alias("all"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["total"] + acc["p"] * rate / k).alias("total"), F.concat(acc["all"], F.array(acc["total"] + acc["p"] * rate / k)).alias("all"))
    return F.aggregate(F.sequence(F.lit(1), terms), start, step, lambda acc: acc["all"])


#: Up to this rate a distribution function starts at 0; above, where its terms are too small to tell from 0.
DIRECT = 512.0
#: So many standard deviations on both sides of a large rate hold all of its distribution that doubles can tell.
SPAN = 12


def large_poisson_cdf(rate: Column, first: Column, last: Column) -> Column:
    """P(X <= first), ..., P(X <= last) of a Poisson distribution with a large mean, from the terms' ratios; their sum counts as 1."""
    start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("total"), F.array(F.lit(1.0)).alias("all"))
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), (acc["total"] + acc["p"] * rate / k).alias("total"), F.concat(acc["all"], F.array(acc["total"] + acc["p"] * rate / k)).alias("all"))
    return F.aggregate(F.sequence(first + 1, last), start, step, lambda acc: F.transform(acc["all"], lambda x: x / acc["total"]))


def source_rates(df: DataFrame, source: str, size: Column, weights: dict[str, float], scale: float = 1.0) -> DataFrame:
    """(stratum, rate): how often a document of each stratum should come on average; one row per named source and one for the rest.

    ``weights`` names sources and their shares of the output in units of ``size``; what is left of 1 goes to all
    other sources (null included) together, in their own proportions. The output is ``scale`` times the input's size.
    Sizes are summed over all documents. A stratum without documents gets no row, and its share goes to the others
    in proportion to theirs. Rates are as high as the shares ask.
    """
    rest = 1.0 - sum(weights.values())
    if min(weights.values(), default=0.0) < 0 or rest < 0:
        raise ValueError("weights must be shares of 1")
    share = F.lit(rest)
    for name, weight in weights.items():
        share = F.when(F.col("stratum") == f"={name}", F.lit(float(weight))).otherwise(share)
    sums = df.groupBy(_stratum(source, weights).alias("stratum")).agg(F.sum(size).cast("double").alias("held"))
    whole = W.partitionBy(F.lit(0))  # over one row for each stratum
    asked = sum(w > 0 for w in (*weights.values(), rest))
    filled = (F.col("held") > 0) & (share > 0)
    # with all strata there the shares stay as they are, to the last bit
    there = F.when(F.count(F.when(filled, 1)).over(whole) == asked, F.lit(1.0)).otherwise(F.sum(F.when(filled, share)).over(whole))
    sums = sums.withColumn("total", F.sum("held").over(whole)).withColumn("there", there)
    rate = F.when(filled, F.col("total") * F.lit(scale) * (share / F.col("there")) / F.col("held")).otherwise(F.lit(0.0))
    return sums.select("stratum", rate.alias("rate"))


def _stratum(source: str, weights: dict[str, float]) -> Column:
    known = F.col(source).isin(*weights) if weights else F.lit(False)
    return F.when(known, F.concat(F.lit("="), F.col(source))).otherwise(F.lit("*"))


def replicate(df: DataFrame, key: str, source: str, size: Column, weights: dict[str, float], *, seed: str = "mix", scale: float = 1.0, shuffle: bool = True) -> DataFrame:
    """Each row of ``df`` as often as a Poisson variable with its source's rate says, in an order that forgets sources.

    Adds n_copies, copy (0 to n_copies - 1) and order_key (a hash of seed, key and copy, by which the output is
    dealt to partitions and sorted within them). Key and seed alone decide a row's draw, so a lost task is redone with the same
    result; rows that share a key share a draw. A row whose draw is 0 doesn't appear. Columns of ``df`` with the
    three added names are replaced. An empty table gives an empty one.
    """
    df = df.drop("n_copies", "copy", "order_key")
    rates = _rates(df.select(F.col(source), size.alias("_mix_size")), source, weights, scale)
    # one row per named source and one more
    rated = df.withColumn("_mix_stratum", _stratum(source, weights)).join(F.broadcast(rates), F.col("_mix_stratum") == F.col("_mix_of"), "left")
    drawn = rated.withColumn("n_copies", F.col("_mix_first") + poisson_inverse(unit_draw(F.col(key), seed), F.col("_mix_cdf"))).drop("_mix_stratum", "_mix_of", "_mix_first", "_mix_cdf")
    copies = drawn.filter(F.col("n_copies") > 0).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    name = F.concat(F.lit(f"{seed}/"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/"), F.col("copy").cast("string"))
    copies = copies.withColumn("order_key", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long"))
    return copies.repartition("order_key").sortWithinPartitions("order_key", key) if shuffle else copies


def _rates(sized: DataFrame, source: str, weights: dict, scale: float) -> DataFrame:
    rates = source_rates(sized, source, F.col("_mix_size"), weights, scale)
    rate = F.col("rate")
    terms = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    far = F.ceil(SPAN * F.sqrt(rate)).cast("int")
    middle = F.floor(rate).cast("int")
    large = rate > DIRECT
    first = F.when(large, middle - far).otherwise(F.lit(0))
    cdf = F.when(large, large_poisson_cdf(rate, middle - far, middle + far)).otherwise(poisson_cdf(rate, terms))
    return rates.select(F.col("stratum").alias("_mix_of"), first.alias("_mix_first"), cdf.alias("_mix_cdf"))
