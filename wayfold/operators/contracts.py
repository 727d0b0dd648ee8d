"""Contracts on rows: named rules as boolean columns, reports in one scan, and gates that fail a plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: How many failing ids a report names.
SAMPLE = 50


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that a row breaks, in order; a rule that is null is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def report(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(rule, checked, failures, first_failure) for each rule, in one scan: rows checked, rows that break it, and the least key of these."""
    fails = {name: ~F.coalesce(rule, F.lit(False)) for name, rule in rules.items()}
    sums = rows.agg(F.count(F.lit(1)).alias("checked"), *(x for i, f in enumerate(fails.values()) for x in (F.count_if(f).alias(f"f{i}"), F.min(F.when(f, F.col(key))).alias(f"m{i}"))))
    each = F.array(*(F.struct(F.lit(name).alias("rule"), F.col("checked"), F.col(f"f{i}").alias("failures"), F.col(f"m{i}").alias("first_failure")) for i, name in enumerate(rules)))
    return sums.select(F.explode(each).alias("x")).select("x.*")


def failing(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, rule): a row for each rule that a row breaks."""
    return rows.select(key, F.explode(broken(rules)).alias("rule"))


def checks(parts: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """(check_id, pass, failures, sample): for each check the rows of a table of offending keys, counted, with the least SAMPLE of them."""

    def one(name: str, bad: DataFrame) -> DataFrame:
        keys = bad.select(F.col(key).cast("string").alias("k"))
        sample = keys.orderBy("k").limit(SAMPLE).agg(F.array_join(F.array_sort(F.collect_list("k")), " ").alias("sample"), F.lit(1).alias("_one"))
        count = keys.agg(F.count(F.lit(1)).alias("failures"), F.lit(1).alias("_one"))
        # one row each
        both = count.join(F.broadcast(sample), "_one")
        return both.select(F.lit(name).alias("check_id"), (F.col("failures") == 0).alias("pass"), "failures", "sample")

    return reduce(DataFrame.union, (one(*x) for x in parts.items()))


def require(rows: DataFrame, rule: Column, message: str, key: str) -> DataFrame:
    """``rows``, with a plan that fails on the first row that breaks the rule, naming its key."""
    fail = F.raise_error(F.concat(F.lit(f"{message}: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return rows.filter(F.when(F.coalesce(rule, F.lit(False)), F.lit(True)).otherwise(fail.cast("boolean")))


def lookup(rows: DataFrame, table: DataFrame, on: list[str], message: str, key: str) -> DataFrame:
    """An inner join that a row without a match fails instead of dropping."""
    found = rows.join(table.withColumn("_found", F.lit(True)), on, "left")
    return require(found, F.col("_found"), message, key).drop("_found")


def row_differences(one: DataFrame, other: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, fault) of rows that two tables don't have alike: missing in the second, extra in it, or the first of ``fields`` that differs."""
    j = one.withColumn("_a", F.lit(True)).join(other.select(key, *(F.col(c).alias(f"_{c}") for c in fields)).withColumn("_b", F.lit(True)), key, "full")
    fault = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra")
    for c in fields:
        fault = fault.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c)
    return j.select(key, fault.alias("fault")).filter("fault is not null")


def readiness(wanted: DataFrame, manifest: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, layer, declared, available, precache, state) for each wanted layer (by, layer) of a manifest (by, id, available, precache); ready only if all of one ``by`` are all three."""
    by = by or []
    mine = manifest.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("id").alias("_id"), F.col("available").alias("_available"), F.col("precache").alias("_precache"), F.lit(True).alias("_there"))
    on = F.col("layer") == F.col("_id")
    for c in by:
        on = on & (F.col(c) == F.col(f"_{c}"))
    no = F.lit(False)
    there = F.coalesce("_there", no)
    j = wanted.join(mine, on, "left").select(*by, "layer", there.alias("declared"), (there & F.coalesce("_available", F.lit(True))).alias("available"), F.coalesce("_precache", no).alias("precache"))
    whole = W.partitionBy(*(by or [F.lit(0)]))  # a row for each wanted layer
    ready = F.bool_and(F.col("declared") & F.col("available") & F.col("precache")).over(whole)
    return j.withColumn("state", F.when(ready, "ready-after-warm").otherwise("partial"))


def gate(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, expected, actual, differs) for everything that either side names."""
    return expected.join(actual, key, "full").select(key, "expected", "actual", (~F.col("expected").eqNullSafe(F.col("actual"))).alias("differs"))


def release_time(epoch: Column) -> Column:
    """Seconds since 1970, given as text, as an ISO time stamp; null or empty gives null, anything but digits fails."""
    fail = F.raise_error(F.concat(F.lit("invalid epoch: "), epoch)).cast("bigint")
    seconds = F.when(epoch.rlike("^[0-9]+$"), epoch.try_cast("bigint")).when(F.coalesce(epoch, F.lit("")) != "", fail)
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def ordered_digest(rows: DataFrame, key: str, text: str, *, run: int = 1000, levels: int = 3) -> DataFrame:
    """(sha256, n): a digest over ``text`` in order of ``key``, a whole number that tells rows apart.

    Texts of ``run`` consecutive keys are digested together, then the digests of as many runs, and so on: no row of the plan holds more than a run, and the
    last one of the whole only what is left after ``levels``. Null texts count as empty. It depends on rows and keys alone.
    """
    level = rows.select(F.col(key).cast("long").alias("k"), F.coalesce(text, F.lit("")).alias("t"), F.lit(1).cast("long").alias("n"))
    joined = lambda: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n"), 256)
    for _ in range(levels):
        level = level.groupBy(F.floor(F.col("k") / run).alias("part")).agg(joined().alias("t"), F.sum("n").alias("n")).select(F.col("part").alias("k"), "t", "n")
    return level.agg(joined().alias("sha256"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
