"""The corpus queries as the driver runs them, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import chat, decontam, folds, importance, jaccard, langid, mixing, neighbours, quality, repair, rules, sharding, suffixes, toxicity

SHARDS = 16
#: Shares of the mix in UTF-8 bytes; all other sources keep their proportions in the rest.
MIX = {"src0": 0.2, "src1": 0.1, "src2": 0.1, "src3": 0.05}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = folds.fold(F.col("doc_id"), 4) == 2
    model = toxicity.train(docs, labels.filter(~held))
    out = toxicity.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_windows(turns.unionByName(extra)))


def op3_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = sharding.assign_shards(rows, "doc_id", [1.0] * SHARDS, grown=1.0)
    slots = sharding.number_slots(rows, "shard", ["doc_id", "text_crc32", "size"])
    return slots.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def op4_centroid_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = folds.fold(F.col("doc_id"), 3) == 1
    model = langid.train(docs.filter(~held))
    out = langid.predict(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_token_group_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_neighbour_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = folds.fold(F.col("doc_id"), 4) == 2
    model = quality.train(docs, labels.filter(~held))
    out = quality.score(docs, model)
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.replicate(docs, "doc_id", "source", F.octet_length(F.coalesce("text", F.lit(""))) + 1, MIX)


def op9_spaced_seed_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.mark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "n_items")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(turns, repair.damage(turns))


def op13_collision_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def queries() -> dict:
    return {f.__name__: f for f in (op1_string_kernel_toxicity, op2_chat_windows, op3_rendezvous_shards, op4_centroid_language, op5_token_group_join, op6_neighbour_quality, op7_perplexity_rules, op8_poisson_mix, op9_spaced_seed_decontam, op10_suffix_dedup, op11_importance_resampling, op12_conversation_repair, op13_collision_neighbours)}


_DRAW = "(('0x' || substr(md5(concat({key})), 1, 13))::bigint::double + 0.5) / 4503599627370496e0"


def _shard_sql(n: int) -> str:
    draw = _DRAW.format(key="d.doc_id, '/', s.range")
    return f"select d.doc_id, d.size, d.text_crc32, arg_min(s.range, (-ln({draw}), s.range)) shard from d, range({n}) s group by all"


_TABLE256 = """table256 as (select list(list_reduce([range, 1, 2, 3, 4, 5, 6, 7, 8]::bigint[], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by range) t from range(256))"""

_CRC = f"""{_TABLE256},
 bytes as (select doc_id, octet_length(encode(coalesce(text, ''))) + 1 size, hex(encode(coalesce(text, ''))) h from documents),
 d as (select doc_id, size, xor(list_reduce([4294967295]::bigint[] || list_transform(range(size - 1), lambda i: ('0x' || substr(h, cast(2 * i + 1 as bigint), 2))::bigint), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) text_crc32 from bytes, table256)"""

_OP3 = f"""with {_CRC}, a as ({_shard_sql(SHARDS)}), g as ({_shard_sql(SHARDS + 1)}),
 b as (select *, ('0x' || substr(md5(concat_ws('/', doc_id, text_crc32, size)), 1, 8))::bigint % 256 bin from a)
 select b.doc_id, cast(b.size as bigint) size, b.text_crc32, 'key' law, cast(b.shard as int) shard, row_number() over (partition by b.shard order by bin, b.doc_id, b.text_crc32, b.size) - 1 slot, cast(g.shard as int) grown_shard
 from b join g using (doc_id)"""

_SHARE = " ".join(f"when '={k}' then {v}e0" for k, v in MIX.items())
_KNOWN = ", ".join(f"'{k}'" for k in MIX)
_OP8 = f"""with recursive d as (select *, case when source in ({_KNOWN}) then '=' || source else '*' end stratum, octet_length(encode(coalesce(text, ''))) + 1 size from documents),
 h as (select stratum, sum(size)::double held from d group by 1),
 r as (select stratum, sum(held) over () * 1e0 * (case stratum {_SHARE} else {1.0 - sum(MIX.values())!r}::double end) / held rate from h),
 c(stratum, rate, k, p, total) as (select stratum, rate, 0, exp(-rate), exp(-rate) from r union all select stratum, rate, k + 1, p * rate / (k + 1), total + p * rate / (k + 1) from c where k < ceil(rate + 12 * sqrt(rate) + 24)),
 u as (select *, {_DRAW.format(key="'mix/', doc_id")} u from d),
 n as (select u.doc_id, u.text, u.lang, u.source, u.n_chars, cast((select count(*) from c where c.stratum = u.stratum and c.total <= u.u) as int) n_copies from u),
 e as (select *, unnest(range(n_copies)) i from n)
 select doc_id, text, lang, source, n_chars, n_copies, cast(i as int) "copy", ('0x' || substr(md5(concat('mix/', doc_id, '/', i)), 1, 15))::bigint order_key from e"""


def _escaped(x: str) -> str:
    x = f"regexp_replace({x}, '&(amp;|lt;|lbrack;|nl;)', '&amp;\\1', 'g')"
    x = f"regexp_replace({x}, '<(\\||/?s>)', '&lt;\\1', 'g')"
    return f"regexp_replace({x}, '\\[(/?INST\\])', '&lbrack;\\1', 'g')"


_OP2 = f"""with recursive c as (select conv_id, turn, coalesce(role, '') role, coalesce(text, '') text from conversations
  union all select -1, range, case range when 0 then 'user' else 'assistant' end, '</s>[INST] ok [/INST]' from range(2)),
 t as materialized (select conv_id, role, text, row_number() over (partition by conv_id order by turn nulls first, role, text) pos, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + 4 tokens,
  length(replace({_escaped('role')}, chr(10), '&nl;')) + length({_escaped('text')}) + 24 chars from c),
 y as materialized (select conv_id, tokens, chars from t where pos = 1 and role = 'system'),
 b as materialized (select distinct t.conv_id, greatest(384 - coalesce(y.tokens, 0), 1) fresh from t left join y using (conv_id)),
 r(conv_id, pos, span, used) as (select conv_id, pos, 0, tokens from t where pos = 1 union all
  select t.conv_id, t.pos, case when r.used + t.tokens > b.fresh then r.span + 1 else r.span end, case when r.used + t.tokens > b.fresh then t.tokens else r.used + t.tokens end
  from r join t on t.conv_id = r.conv_id and t.pos = r.pos + 1 join b on b.conv_id = r.conv_id),
 w as (select conv_id, span, min(pos) f from r group by all having span > 0),
 again as (select w.conv_id, coalesce(y.chars, 0) + coalesce(case when a.tokens <= 128 and not (w.f = 2 and y.chars is not null) then a.chars end, 0)
  + coalesce(case when a.tokens + z.tokens <= 128 and not (w.f = 3 and y.chars is not null) then z.chars end, 0) chars
  from w left join y using (conv_id) left join t a on a.conv_id = w.conv_id and a.pos = w.f - 1 left join t z on z.conv_id = w.conv_id and z.pos = w.f - 2),
 x as (select conv_id, sum(chars) chars from again group by 1)
 select t.conv_id, count(*) n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by pos)) turns_sha256,
  coalesce(length(string_agg(text, '' order by pos) filter (role = 'assistant')), 0) loss_chars, sha256(coalesce(string_agg(text, '' order by pos) filter (role = 'assistant'), '')) loss_sha256,
  cast(sum(t.chars) + coalesce(max(x.chars), 0) as bigint) formatted_chars from t left join x using (conv_id) group by t.conv_id"""


_OP5 = """with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents),
 s as materialized (select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) g from d),
 n as materialized (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
 l as materialized (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
 e as materialized (select x, y from l union all select y, x from l),
 r(doc_id, seen) as (select doc_id, doc_id from d union select r.doc_id, e.y from r join e on e.x = r.seen)
 select r.doc_id, coalesce(max(n.n), 0) n_shingles, min(seen) component_id from r left join n using (doc_id) group by 1"""


_OP10 = """with d as (select doc_id, hex(encode(coalesce(text, ''))) h, strlen(coalesce(text, '')) n from documents), s as (select doc_id, unnest(range(n - 199)) pos from d where n >= 200),
 k as materialized (select s.doc_id, pos, md5(substr(h, cast(2 * pos + 1 as bigint), 400)) g from s join d using (doc_id)), r as (select doc_id, pos from k where g in (select g from k group by g having count(*) > 1)),
 f as (select doc_id, pos, case when pos <= lag(pos) over w + 200 then 0 else 1 end new from r window w as (partition by doc_id order by pos)), i as (select doc_id, pos, sum(new) over (partition by doc_id order by pos) span from f),
 x as (select doc_id, span, min(pos) lo, max(pos) + 200 hi from i group by all), y as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) before from x),
 z as (select doc_id, sum(hi - lo) n_removed, count(*) n_spans, string_agg(substr(h, cast(2 * before + 1 as bigint), cast(2 * (lo - before) as bigint)), '' order by lo) || substr(any_value(h), cast(2 * max(hi) + 1 as bigint)) kept from y join d using (doc_id) group by doc_id)
 select d.doc_id, cast(n as bigint) n_bytes, coalesce(cast(n_removed as bigint), 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, h))) kept_sha256 from d left join z using (doc_id)"""

#: Lower case where the operator folds it, and its tokens; the given benchmark has items of 16 tokens or more, none in a script without spaces.
_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ', 'abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ'), '[0-9a-z\\x{80}-\\x{10ffff}]+')"
_OP9 = f"""with i as materialized (select row_number() over () k, item_id, t, len(t) n, least(len(t), 16) width from (select item_id, {_TOKENS} t from benchmark) where len(t) > 0), d as materialized (select doc_id, {_TOKENS} t from documents),
 ip as (select k, unnest(t) w, generate_subscripts(t, 1) p from i), dp as (select doc_id, unnest(t) w, generate_subscripts(t, 1) p from d where len(t) > 0),
 e as materialized (select doc_id, k, dp.p - ip.p diagonal, ip.p from dp join ip using (w)), c as (select e.*, width, n from e join (select doc_id, k, diagonal from e group by all having count(*) >= 4) using (doc_id, k, diagonal) join i using (k)),
 v as (select doc_id, k, diagonal, width, n, p, count(*) over (partition by doc_id, k, diagonal order by p range between current row and 15 following) equal from c),
 s as (select v.doc_id, v.k, case when n < 16 then (select count(*) from c where c.doc_id = v.doc_id and c.k = v.k and c.diagonal = v.diagonal) else equal end equal, width, n, diagonal, len(d.t) doc_n, p from v join d using (doc_id)),
 o as (select distinct doc_id, coalesce('=' || item_id, '') item from s join i using (k) where equal * 16 >= s.width * 13 and (s.n < 16 and diagonal >= 0 and diagonal + s.n <= doc_n or s.n >= 16 and diagonal + least(p + 15, s.n) <= doc_n and diagonal + least(p, s.n - 15) >= 1))
 select doc_id, count(item) > 0 contaminated, count(item) n_items from d left join o using (doc_id) group by doc_id"""


def _crc_of(h: str) -> str:
    """crc32 of the bytes that the hexadecimal string ``h`` holds, with ``t`` of table256."""
    byte = f"('0x' || substr({h}, cast(2 * i + 1 as bigint), 2))::bigint"
    return f"xor(list_reduce([4294967295]::bigint[] || list_transform(range(length({h}) // 2), lambda i: {byte}), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"


_FEATURES = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_OP11 = f"""with {_TABLE256}, d as materialized (select doc_id, {_FEATURES} w from documents), b as (select {_FEATURES} w from benchmark),
 df as materialized (select doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from d), bf as materialized (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) g from b),
 h as (select g, hex(encode(g)) h from (select g from df union select g from bf)), k as materialized (select g, {_crc_of('h')} % 10000 bucket from h, table256),
 s as (select bucket, count(*) n from df join k using (g) group by 1), t as (select bucket, count(*) n from bf join k using (g) group by 1),
 x as (select range bucket, coalesce(s.n, 0)::double s, coalesce(t.n, 0)::double t, (select count(*) from df)::double ss, (select count(*) from bf)::double tt from range(10000) r left join s on s.bucket = range left join t on t.bucket = range),
 gain as materialized (select bucket, floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) gain from x),
 w as materialized (select doc_id, count(*) n_features, cast(floor(sum(gain) / count(*)) as bigint) weight from df join k using (g) join gain using (bucket) group by doc_id),
 z as (select d.doc_id, len(d.w) n_words, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight, ('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint u from d left join w using (doc_id)),
 y as (select *, cast(weight + floor(-1000 * ln(-ln((u + 0.5e0) / 4294967296e0))) as bigint) score from z), o as (select *, row_number() over (order by score desc, doc_id) r from y where n_words >= 20)
 select y.doc_id, y.n_features, y.weight, y.score, case when o.r <= (select 25 * count(*) // 100 from o) then o.r end "rank" from y left join o using (doc_id)"""

#: States: 0 nothing yet, 1 after the system turn, 2 after a user's, 3 after an assistant's. Each edit of a turn may follow up to two insertions.
_OP12 = f"""with recursive {_TABLE256}, c as (select conv_id, turn, coalesce(role, ' ') "role", coalesce(text, ' ') text, hex(encode(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))) h from conversations),
 k as materialized (select conv_id, turn, "role", text, {_crc_of('h')} % 20 kind from c, table256),
 d as (select conv_id, turn, case kind when 4 then 'user' else "role" end "role", case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) from k),
 f as (select conv_id, turn, "role", text, left("role", 1) i, row_number() over (partition by conv_id order by turn nulls first, "role", text) pos, lag(left("role", 1)) over (partition by conv_id order by turn nulls first, "role", text) before from d),
 n as (select *, row_number() over (partition by conv_id, "role", text order by pos) nth from f),
 g as materialized (select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'blank' when nth > 1 then 'duplicate' when right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) not in ('.', '!', '?') then 'truncated' else '' end fault from n),
 ins(x, y, added, says) as (values (0, 0, '', []::varchar[]), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (3, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (3, 3, 'II', ['user:', 'assistant:'])),
 edit(x, y, letter, initial, price) as (values (0, 0, 'D', null, 4), (1, 1, 'D', null, 4), (2, 2, 'D', null, 4), (3, 3, 'D', null, 4), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (3, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (0, 2, 'R', null, 3), (1, 2, 'R', null, 3), (3, 2, 'R', null, 3), (2, 3, 'R', null, 3)),
 w(conv_id, pos, state, cost, audit, said) as (select distinct conv_id, 0::bigint, 0, 0, '', []::varchar[] from g union all
  select g.conv_id, g.pos, edit.y, w.cost + 3 * len(added) + price + case when fault = 'truncated' and letter <> 'D' then 3 else 0 end cost, audit || added || letter, said || says || case letter when 'D' then [] when 'K' then ["role" || ':' || text] else [case edit.y when 2 then 'user:' else 'assistant:' end || text] end
  from w join g on g.conv_id is not distinct from w.conv_id and g.pos = w.pos + 1 join ins on ins.x = w.state join edit on edit.x = ins.y and (initial is null or initial = i) and (letter = 'D' or fault not in ('blank', 'duplicate'))
  qualify row_number() over (partition by g.conv_id, edit.y order by w.cost + 3 * len(added) + price + case when fault = 'truncated' and letter <> 'D' then 3 else 0 end, audit || added || letter) = 1),
 a as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) gaps, count(*) filter (fault = 'blank') blank, count(*) filter (fault = 'duplicate') duplicate, count(*) filter (fault = 'truncated') truncated, count(*) filter (before || i not in ('su', 'ua', 'au')) illegal, max(pos) n from g group by 1),
 e as (select w.conv_id, arg_min({{'cost': cost + 3 * len(added), 'audit': audit || added, 'said': said || says}}, (cost + 3 * len(added), audit || added)) best from w join a on a.conv_id is not distinct from w.conv_id and a.n = w.pos join ins on ins.x = state where y in (0, 3) group by 1)
 select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal, cast(coalesce(best.cost, 0) as bigint) "cost", coalesce(best.audit, '') audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) repaired_sha256
 from (select distinct conv_id from conversations) o left join a on a.conv_id is not distinct from o.conv_id left join e on e.conv_id is not distinct from o.conv_id"""


def oracle_sql() -> dict[str, str]:
    """None where SQL has no form for the method: tests hold those against brute force or held-out labels."""
    return {"op2_chat_windows": _OP2, "op5_token_group_join": _OP5, "op3_rendezvous_shards": _OP3, "op8_poisson_mix": _OP8, "op9_spaced_seed_decontam": _OP9, "op10_suffix_dedup": _OP10, "op11_importance_resampling": _OP11, "op12_conversation_repair": _OP12}
