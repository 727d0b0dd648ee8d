"""Chat formatting: conversations become budgeted training windows with a loss mask, DataFrame functions only.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline for each turn. Control strings inside a text or role
(``<|``, ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``) are written with entities, and so are texts that already hold such an
entity, so that unescape(escape(x)) == x for every x and a marker in the output is always the template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Template tokens that a turn costs besides its words.
TURN_COST = 4
#: Token counts are gathered in blocks of so many turns.
BLOCK = 64


def escape(x: Column) -> Column:
    x = F.regexp_replace(x, r"&(amp;|lt;|lbrack;|nl;)", r"&amp;$1")
    x = F.regexp_replace(x, r"<(\||/?s>)", r"&lt;$1")
    return F.regexp_replace(x, r"\[(/?INST\])", r"&lbrack;$1")


def unescape(x: Column) -> Column:
    for entity, plain in (("&nl;", "\n"), ("&lt;", "<"), ("&lbrack;", "["), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return x


def escape_role(x: Column) -> Column:
    """A role is one line: its newlines become entities."""
    return F.replace(escape(x), F.lit("\n"), F.lit("&nl;"))


def token_count(text: Column) -> Column:
    """Words, and the template's tokens around a turn."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")) + F.lit(TURN_COST)


def _spans(blocks: Column, fresh: Column) -> Column:
    """The span of each turn, from blocks of token counts: a span ends before the turn that would pass its budget, wherever blocks end."""
    none = F.array().cast("array<int>")
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).alias("span"), F.array().cast("array<array<int>>").alias("all"), none.alias("own"))

    def step(acc, tokens):
        opens = (acc["span"] < 0) | (acc["used"] + tokens > fresh)
        span = F.when(opens, acc["span"] + 1).otherwise(acc["span"])
        used = F.when(opens, tokens.cast("long")).otherwise(acc["used"] + tokens)
        return F.struct(used.alias("used"), span.alias("span"), acc["all"].alias("all"), F.concat(acc["own"], F.array(span)).alias("own"))

    def close(acc):
        return F.struct(acc["used"].alias("used"), acc["span"].alias("span"), F.concat(acc["all"], F.array(acc["own"])).alias("all"), none.alias("own"))

    return F.flatten(F.aggregate(blocks, start, lambda acc, block: F.aggregate(block["tokens"], acc, step, close), lambda acc: acc["all"]))


def _targets(spans: str, history_turns: int) -> Column:
    """For each turn the windows it stands in, as (span, kind): kind 0 the system turn repeated, 1 history, 2 its own span."""
    to = lambda span, kind: F.struct(span.cast("int").alias("span"), F.lit(kind).alias("kind"))

    def of(span, i):
        # a turn is history of each span that starts at most history_turns later
        later = [F.when(F.get(spans, i + d) != F.get(spans, i + d - 1), to(F.get(spans, i + d), 1)) for d in range(1, history_turns + 1)]
        own = F.array(to(span, 2))
        history = F.filter(F.array(*later), lambda x: x.isNotNull()) if later else F.slice(own, 1, 0)
        again = F.transform(F.sequence(F.lit(1), F.element_at(spans, -1)), lambda x: to(x, 0))
        again = F.when(F.element_at(spans, -1) > 0, again).otherwise(F.slice(own, 1, 0))
        return F.concat(own, F.when(F.col("has_system") & (i == 0), again).otherwise(history))

    return F.transform(spans, of)


def _recent(turns: Column, most: int, budget: int) -> Column:
    """The last turns, at most ``most`` with at most ``budget`` tokens together; a suffix, in order."""
    none = F.slice(turns, 1, 0)
    start = F.struct(F.lit(0).alias("sum"), none.alias("kept"))

    def step(acc, turn):
        end = acc["sum"] + turn["tokens"]
        return F.struct(end.alias("sum"), F.when(end <= budget, F.concat(F.array(turn), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

    last = F.slice(turns, F.greatest(F.size(turns) - most + 1, F.lit(1)), most)
    return F.aggregate(F.reverse(last), start, step, lambda acc: acc["kept"])


def format_windows(df: DataFrame, *, budget: int = 512, history_turns: int = 2, history_tokens: int = 128) -> DataFrame:
    """Training windows of ``df`` (conv_id, turn, role, text): (conv_id, window, formatted, n_turns, n_repeated, n_tokens, loss_spans).

    A conversation's turns, by turn (ties by role, then text; null turns first; null role and text count as empty), are
    cut into spans at turn borders. A window is the conversation's system turn (its first turn, if the role is
    ``system``), up to ``history_turns`` turns before the span within ``history_tokens``, and the span. It
    stays within ``budget`` tokens, unless the system turn and one turn alone are longer: a turn is never cut.
    The n_repeated leading turns (system and history) have been in an earlier window and bear no loss; loss_spans are
    (start, length) in code points of ``formatted`` and cover each assistant turn's text once over all windows.
    Texts are gathered by window, never a whole conversation; of that only token counts. Further columns are ignored; an empty
    table gives an empty one; repeated rows are turns of their own.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    by = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    turns = df.select("conv_id", "turn", role.alias("role"), text.alias("text")).withColumn("pos", F.row_number().over(by) - 1)
    turns = turns.select("conv_id", "pos", "role", "text", token_count(F.col("text")).alias("tokens"))

    first = F.max(F.when((F.col("pos") == 0) & (F.col("role") == "system"), F.col("tokens")))
    counts = F.transform(F.sort_array(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"])
    blocks = turns.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(counts.alias("tokens"), first.alias("system"))
    convs = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "tokens"))).alias("blocks"), F.max("system").alias("system"))
    fresh = F.greatest(F.lit(budget - history_tokens) - F.coalesce(F.col("system"), F.lit(0)), F.lit(1))
    convs = convs.select("conv_id", F.col("system").isNotNull().alias("has_system"), _spans(F.col("blocks"), fresh).alias("spans"))
    placed = convs.select(F.col("conv_id").alias("_conv"), F.posexplode(_targets("spans", history_turns)).alias("_pos", "targets"))

    turns = turns.join(placed, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")))
    turns = turns.select("conv_id", "pos", "role", "text", "tokens", F.explode("targets").alias("to"))
    turn = F.struct("pos", "role", "text", "tokens", F.col("to.kind").alias("kind"))
    spans = turns.groupBy("conv_id", F.col("to.span").alias("window")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    of = lambda kind: F.filter("turns", lambda t: t["kind"] == kind)
    spans = spans.select("conv_id", "window", of(0).alias("system"), of(1).alias("before"), of(2).alias("own"))
    history = _recent(F.col("before"), history_turns, history_tokens)
    spans = spans.withColumn("repeated", F.concat("system", history))
    spans = spans.withColumn("all", F.concat("repeated", "own")).withColumn("n_repeated", F.size("repeated"))

    pieces = F.transform("all", lambda t, i: F.struct(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n")).alias("lead"), escape(t["text"]).alias("body"), ((t["role"] == "assistant") & (i >= F.col("n_repeated"))).alias("loss")))
    spans = spans.withColumn("pieces", pieces)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))

    def measure(acc, piece):
        start, length = acc["at"] + F.length(piece["lead"]), F.length(piece["body"])
        return F.struct((start + length + len(CLOSE)).alias("at"), F.when(piece["loss"], F.concat(acc["loss"], F.array(F.struct(start.alias("start"), length.alias("length"))))).otherwise(acc["loss"]).alias("loss"))

    return spans.select(
        "conv_id",
        F.col("window").cast("long").alias("window"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["lead"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.size("all").alias("n_turns"),
        "n_repeated",
        F.aggregate("all", F.lit(0), lambda acc, t: acc + t["tokens"]).alias("n_tokens"),
        F.aggregate("pieces", zero, measure, lambda acc: acc["loss"]).alias("loss_spans"),
    )


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, window, turns, losses, chars) of format_windows() output: the window's new turns as (role, text), and the unescaped texts under the mask."""
    parts = F.split("formatted", r"<\|im_end\|>\n")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    line = lambda p: F.substring_index(p, "\n", 1)
    turn = lambda p: F.struct(unescape(F.substr(line(p), F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(p, F.length(line(p)) + 2)).alias("text"))
    new = F.slice(parts, F.col("n_repeated") + 1, F.greatest(F.size(parts) - F.col("n_repeated"), F.lit(0)))
    losses = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", F.transform(new, turn).alias("turns"), losses.alias("losses"), F.length("formatted").alias("chars"))


def digests(windows: DataFrame) -> DataFrame:
    """A row for each conversation, read back from its windows: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    back = read_back(windows).select(
        "conv_id",
        "chars",
        F.size("turns").alias("n"),
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("losses", "").alias("losses"),
        ).alias("part"),
    )
    whole = back.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.sort_array(F.collect_list("part")).alias("parts"))
    turns, losses = F.array_join("parts.turns", ""), F.array_join("parts.losses", "")
    return whole.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(losses).cast("long").alias("loss_chars"), F.sha2(losses, 256).alias("loss_sha256"), "formatted_chars")
