"""The queries of this subpackage for __spark_entry__.py, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return rows.select("doc_id", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"), F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(_read(spark, sf_dir, "documents"), 24)


def op3_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import verdicts

    rows = verdicts(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import held_out, learn, scored

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = scored(docs, learn(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


#: The rules that the URL query is asked for.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import judge

    return judge(_read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan, summary

    rows = scan(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), summary("licenses").alias("licenses"), F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["coverage"])), F.lit(0.0)), 4).alias("coverage"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_copies

    rows = without_copies(_read(spark, sf_dir, "documents").select("doc_id", "text"), report=True)
    return rows.select("doc_id", F.size("cut_places").cast("long").alias("n_cut"), F.array_join("cut_places", ",").alias("cut_places"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import item_digest, matches

    rows = matches(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0), lambda a, s: a + s[1] - s[0]).cast("long")
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), item_digest(F.col("items")).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digests, read_back, windows

    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    return digests(read_back(windows(turns.unionByName(added))))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    rows = near_duplicates(_read(spark, sf_dir, "documents"), budget=3, width=3)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import audit

    return audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_align import align

    return align(_read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix, taken

    rows = taken(Mix(_read(spark, sf_dir, "documents").select("doc_id", "text", "source")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_lpt_sharding": op2_lpt_sharding,
        "op3_line_frequency": op3_line_frequency,
        "op4_toxicity": op4_toxicity,
        "op5_url_filter": op5_url_filter,
        "op6_license_scan": op6_license_scan,
        "op7_line_dedup": op7_line_dedup,
        "op8_decontamination": op8_decontamination,
        "op9_chat_windows": op9_chat_windows,
        "op10_simhash": op10_simhash,
        "op11_filter_audit": op11_filter_audit,
        "op12_token_alignment": op12_token_alignment,
        "op13_mixing": op13_mixing,
    }


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
_FULL = "trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> ''"

_OP3 = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as host, coalesce(text, '') as text, {_WORDS} as w from documents),
windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d)),
again as (select r, g from windows group by r, g having count(*) > 1),
hit as (select r, count(distinct i + k) as n from windows join again using (r, g), (values (0), (1), (2)) as o(k) group by r),
lines as (select r, doc_id, host, x, regexp_replace(lower(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), '[0-9]+', '0', 'g') as line
  from (select r, doc_id, host, unnest(string_split(text, chr(10))) as x from d) where {_FULL}),
hosts as (select host, count(distinct doc_id) as docs from lines group by host),
often as (select host, line from lines join hosts using (host) group by host, line having count(distinct doc_id) >= 10 and count(distinct doc_id) > 0.02 * any_value(docs)),
l as (select r, count(*) - count(distinct x) as dup, sum(length(x)) as chars, sum(if(often.line is null, 0, length(x))) as gone, sum(if(often.line is null, 0, len(regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+')))) as gone_words from lines left join often using (host, line) group by r),
s as (select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  coalesce(dup, 0) as n_dup_lines, coalesce(n, 0) as n_repeat_words, coalesce(gone, 0) as gone, coalesce(gone_words, 0) as gone_words, coalesce(chars, 0) as chars from d left join hit using (r) left join l using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
  cast(n_repeat_words as bigint) as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and gone <= 0.3 * chars and n_words - gone_words >= 50 as kept from s
"""

_CUT = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP8 = f"""
with items as (select cast(item_id as varchar) as item, {_CUT} as w from benchmark),
spans as (select item, w, least(10, len(w)) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from items where len(w) > 0),
windows as (select distinct item, k, array_to_string(w[i:i + k - 1], ' ') as g from spans),
d as (select row_number() over () as r, doc_id, {_CUT} as w from documents),
places as (select r, k, i, array_to_string(w[i:i + k - 1], ' ') as g from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from windows))),
found as (select r, k, i, item from places join windows using (k, g)),
words as (select r, count(distinct p) as n from (select r, unnest(range(i, i + k)) as p from found) group by r),
named as (select r, count(*) as n, string_agg(item, ',' order by item) as s from (select distinct r, item from found) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit, cast(coalesce(named.n, 0) as bigint) as n_items,
  sha256(coalesce(s, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated from d left join words using (r) left join named using (r)
"""


_OP9 = """
with recursive said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
t as (select dense_rank() over (order by conv_id nulls first) as g, conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) - 1 as n, role, text,
  cast(ceil(strlen(text) / 4.0) as bigint) + 4 as tok, 15 + length(regexp_replace(role, '[\\\\<\n]', 'xx', 'g')) + length(regexp_replace(text, '[\\\\<]', 'xx', 'g')) as chars from said),
s as (select *, coalesce(sum(tok) over w, 0) as before, coalesce(sum(chars) over w, 0) as before_chars from t window w as (partition by g order by n rows between unbounded preceding and 1 preceding)),
h as (select g, case when role = 'system' then 1 else 0 end as system, tok as head, chars as head_chars from s where n = 0),
b as (select s.g, s.n, min(p.n) as back from s join h using (g) join s as p on p.g = s.g and p.n <= s.n and p.n >= greatest(least(system, s.n), s.n - 8) and s.before - p.before <= 256 group by s.g, s.n),
c as (select s.*, system * head + s.before - p.before as context, system * head_chars as fixed_chars, s.before_chars - p.before_chars as back_chars from s join h using (g) join b using (g, n) join s as p on p.g = s.g and p.n = b.back),
r as (select g, n, tok as used, false as starts from c where n = 0
  union all select c.g, c.n, case when r.used + c.tok > 1024 then least(1024, c.context) + c.tok else r.used + c.tok end, r.used + c.tok > 1024 from r join c on c.g = r.g and c.n = r.n + 1)
select any_value(conv_id) as conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by n) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars + case when starts then fixed_chars + case when context + tok > 1024 then 0 else back_chars end else 0 end) as bigint) as formatted_chars
from c join r using (g, n) group by g
"""


_TRIM = "trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

# the shortest runs of 50 words from each line on and up to each line; equal runs are grouped by their whole text
_OP7 = f"""
with d as (select row_number() over (order by doc_id nulls first, text) as r, doc_id, text, string_split(coalesce(text, ''), chr(10)) as a from documents),
raw as (select r, unnest(a) as raw, unnest(range(len(a))) as place from d),
l as (select r, place, {_TRIM} as x, len(regexp_extract_all(raw, '[^\\x20\\x09-\\x0D]+')) as words from raw where {_TRIM} <> ''),
s as (select r, place, x, row_number() over w as n, sum(words) over w as upto, sum(words) over w - words as before from l window w as (partition by r order by place)),
runs as (select a.r, a.n as lo, b.n as hi from s as a asof join s as b on a.r = b.r and a.before + 50 <= b.upto
  union select a.r, b.n, a.n from s as a asof join s as b on a.r = b.r and a.upto - 50 >= b.before),
texts as (select r, lo, hi, string_agg(x, chr(10) order by n) as run from runs join s using (r) where n between lo and hi group by r, lo, hi),
later as (select r, lo, hi from (select r, lo, hi, row_number() over (partition by run order by r, lo) as nth from texts) where nth > 1),
gone as (select distinct r, place from later join s using (r) where n between lo and hi),
cut as (select r, count(*) as n_cut, string_agg(place, ',' order by place) as cut_places from gone group by r),
rest as (select r, string_agg(raw, chr(10) order by place) as t, bool_or({_TRIM} <> '') as full_line from raw semi join cut using (r) anti join gone using (r, place) group by r)
select doc_id, cast(coalesce(n_cut, 0) as bigint) as n_cut, coalesce(cut_places, '') as cut_places,
  sha256(case when n_cut is null then coalesce(text, '') when full_line then t else '' end) as text_sha256 from d left join cut using (r) left join rest using (r)
"""


# sets of filters are bits, A the lowest; the last step of an order is its whole set
_OP11 = f"""
with w as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, {_WORDS} as w from documents),
least as (select t, min(doc_id) as first from w group by t),
d as (select part, (len(w) < 100)::int + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::int + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::int
    + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(doc_id > first, false)::int as fails, doc_id in (select doc_id from labels where quality = 1) as good,
    doc_id in (select doc_id from labels where toxic = 1) as toxic from w join least using (t)),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit),
orders as (select a.f || b.f || c.f || d.f || e.f as filter_order from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (select filter_order, step, bit, coalesce(sum(bit) over (partition by filter_order order by step rows between unbounded preceding and 1 preceding), 0)::int as before
  from orders, range(1, 6) as s(step) join letters on f = filter_order[step]),
g as (select part, fails, count(*) as n, count(*) filter (good) as n_good, count(*) filter (toxic) as n_toxic from d group by part, fails),
r as (select part, filter_order, cast(step as int) as step, bit, sum(if(fails & (before | bit) = 0, n, 0)) as kept, sum(if(fails & before = 0 and fails & bit > 0, n, 0)) as removed,
  sum(if(fails & before > 0 and fails & bit > 0, n, 0)) as redundant, sum(if(fails = bit, n, 0)) as unique_fails,
  sum(if(fails & before = 0 and fails & bit > 0, n_good, 0)) as good_lost, sum(if(fails & before = 0 and fails & bit > 0, n_toxic, 0)) as toxic_lost from g, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails,
  good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost, (sum(removed) over (partition by part, bit))::bigint as shapley from r
"""


# what a source's slots take is a beginning of its repeated stream, so a document's share is what its repetitions have in common with it
_OP13 = f"""
with d as (select row_number() over () as r, doc_id, source, len({_WORDS}) as size, md5(coalesce(doc_id::varchar, '?') || ':' || coalesce(text, '')) as key from documents),
s as (select source, sum(size) as source_size, row_number() over (order by source nulls last) - 1 as nth from d group by source),
w as (select *, [5, 2, 1][nth % 3 + 1] as weight, sum(source_size) over () as total from s),
c as (select *, coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (o rows between current row and unbounded following) as rest,
  row_number() over o as turn from w window o as (order by 3 * source_size / weight, nth)),
l as (select total - before as free, rest as shares, turn as first_free from c where (total - before) * weight <= 3 * source_size * rest order by turn limit 1),
t as (select source, source_size, nth, total, case when turn < first_free then 3 * source_size::double else free::double * weight / shares end as target from c, l),
p as (select *, floor(target / greatest(total, 1)::double * 4503599627370496)::bigint as points, (sum(points) over (order by nth))::bigint as hi from t),
k as (select (i::hugeint * 2783377641436329 % 4503599627370496)::bigint as u from range((select ceil(any_value(total) / 32)::bigint from w)) as x(i)),
n as (select nth, count(*) as slots from k join p on u >= hi - points and u < hi group by nth),
m as (select source, source_size, target, least(32 * coalesce(slots, 0), 3 * source_size) as most from p left join n using (nth)),
o as (select d.*, m.source_size, m.target, m.most, coalesce(sum(size) over (partition by d.source order by key, r rows between unbounded preceding and 1 preceding), 0) as place from d join m on d.source is not distinct from m.source)
select doc_id, size::bigint as size, source_size::bigint as source_size, target,
  (greatest(least(place + size, most) - place, 0) + greatest(least(source_size + place + size, most) - source_size - place, 0) + greatest(least(2 * source_size + place + size, most) - 2 * source_size - place, 0))::bigint as taken from o
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_frequency": _OP3, "op7_line_dedup": _OP7, "op8_decontamination": _OP8, "op9_chat_windows": _OP9, "op11_filter_audit": _OP11, "op13_mixing": _OP13}
