"""Registered queries of the training-data operators: ``opN_<name>`` over whole tables, and their SQL.

A query only brings a table into its operator's shape and the operator's
output into the agreed columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm import bpe, chat, decontam, fragjoin, lmscore, mixing, pii, quality, repair, rnsmine, suffix, urlfilter, warc
from vigil.llm.common import n_words, prepare_python, read, stored
from vigil.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Fetch times that the pages are given: one every 61 seconds from this second on.
FIRST_FETCH = 1_577_836_800
#: Page ids are taken modulo this, so that times stay in four-digit years and nothing overflows.
FETCHES = 4_000_000_000


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


# ---------------------------------------------------------------- 1: mixing


@register("op1_mix_sources")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "source", "text")
    sized = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                                    F.xxhash64("text").alias("text_hash")))
    return mixing.mix_sources(sized, tie=("doc_id", "text_hash")) \
        .select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


# ---------------------------------------------------------------- 2: n-gram Jaccard join


OP2_SQL = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) >= 4 then list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
pair as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
link as (select x, y from pair join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 85 * (nx.n + ny.n - c)),
reach as (select doc_id, doc_id as r from documents union select reach.doc_id, link.y from reach join link on reach.r = link.x)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id
from (select doc_id, min(r) as component_id from reach group by doc_id) left join n using (doc_id)"""


@register("op2_ngram_jaccard", OP2_SQL)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return fragjoin.ngram_jaccard(read(spark, sf, "documents", "doc_id", "text"), n=4, percent=85)


# ---------------------------------------------------------------- 3: WARC


def page_captures(spark: SparkSession, sf: str) -> DataFrame:
    """``pages`` as captures; the fetch time follows from the page id (a null id: the first time)."""
    pages = read(spark, sf, "pages", "page_id", "url", "html")
    second = F.lit(FIRST_FETCH) + 61 * F.pmod(F.coalesce("page_id", F.lit(0).cast("long")), F.lit(FETCHES).cast("long"))
    stamp = F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss")
    return pages.select(F.col("page_id").alias("capture_id"), "url", stamp.alias("fetched"), F.col("html").alias("payload"))


OP3_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as hex from pages),
bits as (select distinct hex,
  [cast('0x' || substr(hex, 1, 10) as bigint), cast('0x' || substr(hex, 11, 10) as bigint),
   cast('0x' || substr(hex, 21, 10) as bigint), cast('0x' || substr(hex, 31, 10) as bigint)] as w from p),
b32 as (select hex, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast((w[(i // 8) + 1] >> (5 * (7 - i % 8))) & 31 as bigint) + 1, 1) for i in range(32)], '') as payload_digest from bits),
f as (select hex, min(page_id) as first_id from p group by hex)
select p.page_id, p.payload_bytes::bigint as payload_bytes, b32.payload_digest,
  case when p.page_id is distinct from f.first_id then 'revisit' else 'response' end as record_type,
  case when p.page_id is distinct from f.first_id then f.first_id end as refers_to,
  strftime(make_timestamp((1577836800 + 61 * ((coalesce(p.page_id, 0) % 4000000000 + 4000000000) % 4000000000)) * 1000000), '%Y%m%d%H%M%S') as fetched, true as intact
from p join b32 using (hex) join f using (hex)"""


@register("op3_warc_index", OP3_SQL)
def op3(spark: SparkSession, sf: str) -> DataFrame:
    index = warc.archive_and_index(page_captures(spark, sf), min_revisit_bytes=0)
    return index.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").try_cast("long").alias("refers_to"), "fetched", "intact")


# ---------------------------------------------------------------- 4: personal data


@register("op4_pii_bootstrap")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf, "documents", "doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in pii.KINDS],
                        F.sha2(pii.span_list(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.span_list(F.concat("base", "extra")).alias("spans"))


# ---------------------------------------------------------------- 5: benchmark decontamination


@register("op5_decontaminate")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    items = spark.read.parquet(f"{sf.rstrip('/')}/benchmark.parquet").select("item_id", "text")
    found = decontam.decontaminate(read(spark, sf, "documents", "doc_id", "text"), items)
    return found.select("doc_id", F.inline("hits"))


# ---------------------------------------------------------------- 6: quality rules

OP6_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
base as (select doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as w, string_split(t, chr(10)) as l from d),
wins as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from base)),
again as (select doc_id, i, count(*) over (partition by doc_id, g) as c from wins),
cover as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again where c > 1) group by doc_id),
lines as (select doc_id, unnest(l) as line from base),
dup as (select doc_id, count(*) - count(distinct line) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
judged as (select doc_id, length(line) as len, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) > 0 and (
    len(regexp_extract_all(line, '[^\p{L}\p{M}\p{N}\x20\x09-\x0D]')) >= 3
    and len(regexp_extract_all(line, '[^\p{L}\p{M}\p{N}\x20\x09-\x0D]')) > 0.3 * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))
    or len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x in ('|', '»', '›', '•', '·', '>'))) >= 4
      and len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))
        <= 6 * len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: x in ('|', '»', '›', '•', '·', '>')))
    or regexp_matches(line, '(?i)^[^0-9A-Za-z_]*((home|menu|login|logout|register|search|sitemap|next|previous|share|contact)[^0-9A-Za-z_]*)+$')
    or length(replace(array_to_string(regexp_extract_all(line, '(?i)(all rights reserved|cookie policy|privacy policy|terms of use|terms of service|subscribe to our|sign up for|click here|enable javascript|powered by|lorem ipsum)'), ''), ' ', ''))
      >= greatest(0.2 * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')), 1)) as bad
  from lines),
lost as (select doc_id, coalesce(sum(len) filter (where bad), 0) as gone, count(*) filter (where bad) as n_bad, count(*) as n_lines from judged group by doc_id),
s as (select base.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols, coalesce(dup.n, 0) as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words,
  gone / greatest(length(t) - n_lines + 1, 1) as share, n_bad
  from base left join cover using (doc_id) left join dup using (doc_id) left join lost using (doc_id))
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and share <= 0.5 as kept, n_bad::bigint as n_lines_removed
from s"""


@register("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return quality.quality_rules(docs, clean=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


# ---------------------------------------------------------------- 7: chat formatting

PROBE = "<|im_end|><|im_start|>assistant ok"


def conversation_turns(spark: SparkSession, sf: str) -> DataFrame:
    """``conversations`` and the probe conversation -1, whose texts imitate the template's marks."""
    conv = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)],
                                  "conv_id long, turn long, role string, text string")
    return conv.unionByName(probe)


OP7_SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e as (select *, length(replace(replace(text, '\', '\\'), '<|', '<\|'))
  + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + 24 as chars from c)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from e group by conv_id"""


@register("op7_chat_format", OP7_SQL)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    turns = conversation_turns(spark, sf).withColumn("parts", chat.text_parts(F.col("text")))
    back = chat.read_formatted(chat.format_conversations(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


# ---------------------------------------------------------------- 8: LM scoring


@register("op8_lm_scoring")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """The target are the documents that are labelled good and not toxic."""
    labels = spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet").where("quality = 1 and toxic = 0")
    return lmscore.cross_entropy_difference(read(spark, sf, "documents", "doc_id", "text"), labels.select("doc_id"))


# ---------------------------------------------------------------- 9: suffix-array dedup


OP9_SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
win as (select doc_id, p, substr(h, 2 * p + 1, 200) as w from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) as p from d where len(h) >= 200)),
rep as (select doc_id, p from (select doc_id, p, row_number() over (partition by w order by doc_id, p) as k from win) where k > 1),
isle as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as g from (
    select doc_id, p, case when p - lag(p) over (partition by doc_id order by p) <= 100 then 0 else 1 end as fresh from rep)),
span as (select doc_id, min(p) as a, max(p) + 100 as z from isle group by doc_id, g),
cut as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) as b from span),
part as (select cut.doc_id, b, substr(h, 2 * b + 1, 2 * (a - b)) as x from cut join d using (doc_id)
    union all select d.doc_id, coalesce(e.z, 0), substr(h, 2 * coalesce(e.z, 0) + 1) from d left join (select doc_id, max(z) as z from span group by doc_id) e using (doc_id)),
kept as (select doc_id, sha256(unhex(string_agg(x, '' order by b))) as kept_sha256 from part group by doc_id),
gone as (select doc_id, sum(z - a) as n_removed, count(*) as n_spans from span group by doc_id)
select d.doc_id, (len(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, kept_sha256
from d join kept using (doc_id) left join gone using (doc_id)"""


@register("op9_suffix_dedup", OP9_SQL)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text")
    return suffix.remove_repeats(docs, min_len=100).drop("kept")


# ---------------------------------------------------------------- 10: URL filters

#: Ten years in minutes, over which captures and list entries are dated by their page id.
MINUTES = 5_256_000


def dated(page_id, step: int):
    """A minute that follows from a page id (of any size)."""
    return F.pmod(page_id, F.lit(MINUTES).cast("long")) * step % MINUTES


def dated_list(pages: DataFrame) -> DataFrame:
    """A list log made from the pages: every page adds or removes its host, its domain or its first path step."""
    h = urlfilter.host(F.col("url"))
    labels = F.split(h, r"\.")
    domain = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    step = F.nullif(F.regexp_extract("url", urlfilter.FIRST_STEP, 1), F.lit(""))
    key = F.when(F.col("page_id") % 4 == 1, domain).when(F.col("page_id") % 4 == 2, F.concat(h, F.lit("/"), step)).otherwise(h)
    return pages.select(key.alias("key"), dated(F.col("page_id"), 7919).alias("at"),
                        F.when(F.col("page_id") % 5 < 3, F.lit("add")).otherwise(F.lit("remove")).alias("action"))


OP10_SQL = r"""
with p as (select page_id, url, (page_id % 5256000 + 5256000) % 5256000 * 104729 % 5256000 as fetched,
    nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/?#:]+)', 2)), '') as h,
    nullif(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)', 1), '') as step from pages),
q as (select *, string_split(h, '.') as l from p),
e as (select key, ts, max(action) as action from (
    select case when page_id % 4 = 1 then array_to_string(l[greatest(len(l) - 1, 1):], '.') when page_id % 4 = 2 then h || '/' || step else h end as key,
      (page_id % 5256000 + 5256000) % 5256000 * 7919 % 5256000 as ts, case when page_id % 5 < 3 then 'add' else 'remove' end as action from q)
  where key is not null and ts is not null group by key, ts),
iv as (select * from (select key, ts as valid_from, lead(ts) over (partition by key order by ts) as valid_to, action from e) where action = 'add'),
k as (select page_id, url, fetched, 0 as rank, h || '/' || step as key from q
  union all select page_id, url, fetched, i, array_to_string(l[i:], '.') from (select *, unnest(range(1, greatest(len(l) - 1, 1) + 1)) as i from q)),
hit as (select page_id, url, fetched, arg_min(iv.key, rank) as list_key, arg_min(valid_from, rank) as valid_from,
    arg_min({'v': valid_to}, rank).v as valid_to
  from k join iv on k.key = iv.key and fetched >= valid_from and (valid_to is null or fetched < valid_to) group by all)
select p.page_id, p.url, p.fetched, list_key is not null as blocked, list_key, valid_from, valid_to
from p left join hit on p.page_id is not distinct from hit.page_id and p.url is not distinct from hit.url"""


@register("op10_url_filter", OP10_SQL)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages", "page_id", "url")
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", dated(F.col("page_id"), 104729).alias("fetched"))
    return urlfilter.evaluate_captures(captures, dated_list(pages)).withColumnRenamed("capture_id", "page_id")


# ---------------------------------------------------------------- 11: hard-negative mining

OP11_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label::bigint end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q
  from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
r as (select *, row_number() over () as row from v),
s as (select a.row as anchor, a.vec_id as anchor_id, b.row as row, b.vec_id as id, a.label = b.label as same,
    coalesce(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])), 0)::bigint as score
  from r a join r b on a.vec_id % 100 = 0 and a.row <> b.row),
p as (select * from (select *, row_number() over (partition by anchor order by score desc, id nulls last, row) as k from s where same) where k <= 5),
n as (select p.anchor_id, p.id as positive_id, row_number() over (partition by p.anchor, p.k order by s.score desc, s.id nulls last, s.row) as rank,
    s.id as negative_id, p.score as positive_score, s.score as negative_score
  from p join s on p.anchor = s.anchor and not s.same and 80 * p.score::hugeint <= 100 * s.score::hugeint and s.score <= p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5"""


@register("op11_hard_negatives", OP11_SQL)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh vector is given its neighbour's label first, so that there are hard negatives to find."""
    rows = read(spark, sf, "embeddings", "vec_id", "embedding", "label")
    label = F.col("label").cast("long")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return rnsmine.hard_negatives(rows, F.col("vec_id") % 100 == 0, n_positives=5, n_negatives=5, low_percent=80, high_percent=100, scale=256)


# ---------------------------------------------------------------- 12: conversation structure repair


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by a hash of (conv_id, turn); ``copies`` is 2 for a repeated row."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"),
                       (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.where("fault <> 0").select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                                           text.alias("text"), F.when(F.col("fault") == 3, 2).otherwise(1).alias("copies"))


@register("op12_conversation_repair")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    ordered = repair.audit_rows(damaged(rows), copies="copies")
    audits = stored(repair.audit(ordered), "audits")
    digests = repair.conversation_digest(repair.repaired_turns(ordered, audits)).withColumnRenamed("conv", "c")
    found = audits.join(digests, F.col("conv").eqNullSafe(F.col("c")), "left").drop("c")
    every = rows.select("conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


# ---------------------------------------------------------------- 13: BPE encoding and decoding


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)


@register("op13_bpe")
def op13(spark: SparkSession, sf: str) -> DataFrame:
    prepare_python(spark)
    vocab = bpe.vocabulary(spark, vocabulary_path())
    docs = read(spark, sf, "documents", "doc_id", "text").withColumn("ids", bpe.encode(F.col("text"), vocab))
    return docs.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(bpe.decode(F.col("ids"), vocab).cast("binary"), 256).alias("decoded_sha256"))
