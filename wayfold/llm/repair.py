"""Repair of conversations: the cheapest edits that bring turns into the order system, user, assistant, user, assistant, ...

Windows flag each turn's fault. The turns of a conversation are collected in order, and one aggregate() over them carries the best way to
each of four states: nothing kept yet, after the system turn, after a user turn, after an assistant turn. A way is a struct (cost, path), and least() of two structs picks the cheaper, then
the one whose path is ASCII-least. Everything is Spark SQL; there is no Python on the way.

A path has one letter for an edit: D(elete), I or J (insert a user or assistant turn), K(eep), R or S (rerole to user or assistant). Letters before a place
decide the state there, so two paths of one state never first differ between I and J or between R and S: their order is that of the edits' initials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What edits cost, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: The cost of a state that can't be reached: above that of any real way.
NEVER = 1 << 40
#: Not white space: what a text must hold so as not to be blank.
SOLID = r"[^\x20\x09-\x0D]"
STATES = ("none", "system", "user", "assistant")


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of damaged turns, for tests of repair: crc32 of ``conv_id:turn`` modulo 20 drops a turn (0), empties its
    text (1), strips its ``.!?`` (2), repeats it (3) or makes it the user's (4). Nulls read as one space; conv_id and turn stay null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy"))
    return rows.drop("copy")


def _step(way: Column, cost: int | Column, letter: str) -> Column:
    return F.struct((way["cost"] + cost).alias("cost"), F.concat(way["path"], F.lit(letter)).alias("path"))


def _inserted(ways: dict[str, Column]) -> dict[str, Column]:
    """The ways after insertions: a user turn where one may come, then an assistant turn."""
    user = F.least(ways["user"], *(_step(ways[s], INSERT, "I") for s in ("none", "system", "assistant")))
    return ways | {"user": user, "assistant": F.least(ways["assistant"], _step(user, INSERT, "J"))}


def _never() -> Column:
    return F.struct(F.lit(NEVER).alias("cost"), F.lit("").alias("path"))


def _after(acc: Column, turn: Column) -> Column:
    """The four ways after one more turn: insertions before it, then it is deleted, or kept or reroled where its place allows."""
    ways = _inserted({s: acc[s] for s in STATES})
    stays = F.when(turn["fault"].isin("blank", "duplicate"), F.lit(NEVER)).when(turn["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0)).cast("long")
    keep = lambda initial: F.when(turn["initial"] == initial, stays).otherwise(F.lit(NEVER))
    before_user = F.least(ways["none"], ways["system"], ways["assistant"])
    gone = {s: _step(ways[s], DELETE, "D") for s in STATES}
    return F.struct(
        gone["none"].alias("none"),
        F.least(gone["system"], _step(ways["none"], keep("s"), "K")).alias("system"),
        F.least(gone["user"], _step(before_user, keep("u"), "K"), _step(before_user, stays + REROLE, "R")).alias("user"),
        F.least(gone["assistant"], _step(ways["user"], keep("a"), "K"), _step(ways["user"], stays + REROLE, "S")).alias("assistant"),
    )


def best_way(turns: Column) -> Column:
    """(cost, path) of the cheapest edits of an array of turns with ``initial`` and ``fault``."""
    start = F.struct(F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("path")).alias("none"), *(_never().alias(s) for s in STATES[1:]))

    def finish(acc: Column) -> Column:
        return F.least(acc["none"], _inserted({s: acc[s] for s in STATES})["assistant"])

    return F.aggregate(turns, start, _after, finish)


def _flagged(turns: DataFrame) -> DataFrame:
    """Turns with their place, their fault (the first of blank, duplicate and truncated that holds), and whether they may follow the turn before."""
    by = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    placed = turns.select("conv_id", "turn", "role", "text", initial.alias("initial"), F.lag(initial).over(by).alias("before"), F.lag("turn").over(by).alias("turn_before"), F.row_number().over(by).alias("at"))
    # no further shuffle: rows that agree in more than conv_id are together already
    seen = F.row_number().over(W.partitionBy("conv_id", "role", "text").orderBy("at")) > 1
    blank = ~F.col("text").rlike(SOLID)
    cut_off = ~F.regexp_extract(F.reverse("text"), SOLID, 0).isin(".", "!", "?")
    fault = F.when(blank, "blank").when(seen, "duplicate").when(cut_off, "truncated").otherwise("none")
    illegal = ~F.concat("before", "initial").isin("su", "ua", "au")
    # in order, a number is new where it differs from the one before
    new = F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    return placed.select("conv_id", "turn", "role", "text", "initial", "at", fault.alias("fault"), illegal.alias("illegal"), new.alias("new"))


def _repaired(turns: Column, path: Column) -> Column:
    """``role:text`` of the repaired turns, an array: one piece of the path for each turn, the insertions before it included."""
    insert = lambda letters: F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.when(x == "I", "user:").otherwise("assistant:"))
    pieces = F.regexp_extract_all(path, F.lit("([IJ]*[DKRS])"), F.lit(1))

    def piece(turn: Column, letters: Column) -> Column:
        last = F.substring(letters, -1, 1)
        role = F.when(last == "R", "user").when(last == "S", "assistant").otherwise(turn["role"])
        own = F.when(last == "D", F.array().cast("array<string>")).otherwise(F.array(F.concat(role, F.lit(":"), turn["text"])))
        return F.concat(insert(F.regexp_replace(letters, "[DKRS]", "")), own)

    return F.concat(F.flatten(F.zip_with(turns, pieces, piece)), insert(F.regexp_extract(path, "[IJ]*$", 0)))


def repair(turns: DataFrame) -> DataFrame:
    """A row for each conv_id of (conv_id, turn, role, text): gaps, faults by kind, illegal, cost, audit, repaired (an array of ``role:text``).

    Turns go by turn, nulls first; turns of one number by role and text. Nulls read as one space. Roles count by their first letter: what doesn't begin with s, u or
    a has to be reroled or deleted. A null conv_id is a conversation of its own. Other columns are ignored. An empty table gives no rows.
    """
    space = F.lit(" ")
    flagged = _flagged(turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text")))
    count = lambda kind: F.count(F.when(F.col("fault") == kind, 1)).alias(kind)
    gaps = F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new"), 1))
    rows = flagged.groupBy("conv_id").agg(
        F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"), count("blank"), count("duplicate"), count("truncated"), F.count(F.when(F.col("illegal"), 1)).alias("illegal"),
        F.array_sort(F.collect_list(F.struct("at", "initial", "fault", "role", "text"))).alias("turns"),
    )
    rows = rows.withColumn("way", best_way(F.col("turns")))
    audit = F.translate("way.path", "JS", "IR")
    return rows.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("way.cost").alias("cost"), audit.alias("audit"), _repaired(F.col("turns"), F.col("way.path")).alias("repaired"))


def report(turns: DataFrame, damaged: DataFrame) -> DataFrame:
    """repair() of ``damaged``, with a row of zeros, no edits and the empty text's digest for a conversation of ``turns`` that damage left nothing of;
    the repaired turns as the digest of their lines."""
    found = repair(damaged).withColumn("repaired_sha256", F.sha2(F.array_join("repaired", "\n"), 256)).drop("repaired")
    lost = turns.select("conv_id").distinct().withColumnRenamed("conv_id", "all_conv")
    rows = lost.join(found, F.col("all_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    numbers = [zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return rows.select(F.col("all_conv").alias("conv_id"), *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
