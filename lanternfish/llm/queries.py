"""The queries of this package, over the tables of a folder, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanternfish.llm import chat, codes, decontaminate, exact_dedup, licences, mtree, quality, secrets, sentencepiece_bpe, simhash, spelling, toxicity, warc

PIECES = "piece_bpe_32k.model"


def model_path(name: str = PIECES) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """With ``matches`` as item:word of the item:word of the document:words, in the order of item and place."""
    found = decontaminate.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    said = F.transform("matches", lambda m: F.concat_ws(":", m["item_id"], m["item_word"].cast("string"), m["doc_word"].cast("string"), m["words"].cast("string")))
    return found.withColumn("matches", F.array_join(said, ","))


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_digests(_table(spark, folder, "pages"))


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_bpe.token_digests(_table(spark, folder, "documents"), model_path())


def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, folder, "documents"), carry=False)


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_dedup(_table(spark, folder, "documents"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """With ``spans`` as start:end of each toxic word, in code points."""
    found = toxicity.toxicity(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    said = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.withColumn("spans", F.array_join(said, ","))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, folder, "documents"))


def op9_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return chat.swapped_replies(_table(spark, folder, "conversations"))


def op10_licences(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_spans(_table(spark, folder, "documents"))


def op11_top_k(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose id is divisible by 50 ask all others."""
    rows = _table(spark, folder, "embeddings")
    return mtree.top_products(rows.where("vec_id % 50 = 0"), rows, k=5, scale=256)


def op12_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, folder, "documents"), spoil=31)


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return codes.vector_codes(_table(spark, folder, "embeddings"))


def secrets_base(spark: SparkSession, folder: str) -> DataFrame:
    """The base columns of op8, which SQL can say."""
    return op8_secrets(spark, folder).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_warc, op3_quality, op4_sentencepiece, op5_exact_dedup, op6_simhash, op7_toxicity, op8_secrets, op9_preferences, op10_licences,
                                op11_top_k, op12_spelling, op13_vector_codes, secrets_base)
}

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: Base32 of the eight numbers of 20 bits in ``v``.
BASE32 = "array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((v[j // 4 + 1] >> (15 - 5 * (j % 4))) & 31)::int + 1, 1)), '')"

#: Kept rows of embeddings (id, vector ``x``).
FINITE = "embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"

#: CRC-32 of the hexadecimal digits ``x`` of a string's bytes, half a byte at a time, the lower half first.
CRC_HALVES = [0, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C, 0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C]
CRC = f"""xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, length(x)), lambda i: (instr('0123456789ABCDEF', x[case when i % 2 = 0 then i + 2 else i end]) - 1)::bigint)),
  lambda a, b: xor(a >> 4, {CRC_HALVES}[(xor(a, b) & 15) + 1])))"""

#: Assignments of parts to the nearest entries of the books of round ``r``, and the books of the round after.
ROUND = """a{r} as materialized (select vec_id, p, any_value(v) as v, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), e := e)) as m from parts join b{r} using (p) group by vec_id, p),
s{r} as (select p, e, i, cast(floor(sum(x) / count(*)) as bigint) as x from (select p, m.e as e, unnest(range(1, len(v) + 1)) as i, unnest(v) as x from a{r}) group by p, e, i),
b{q} as materialized (select p, e, coalesce(n.c, o.c) as c from b{r} o left join (select p, e, list(x::double order by i) as c from s{r} group by p, e) n using (p, e))"""

ORACLE_SQL: dict[str, str] = {
    "op11_top_k": f"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings where vec_id is not null and {FINITE}),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score from v q join v on q.vec_id <> v.vec_id where q.vec_id % 50 = 0)
select query_id, rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5""",
    "op12_spelling": f"""
with recursive runs as (select coalesce(doc_id::varchar, '') as d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) as run from documents),
k as (select run, count(*) as c, hex(encode(d || ':' || run)) as x from runs where length(run) >= 7 group by d, run),
h as (select run, c, {CRC} as h from k),
spoilt as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, c from h),
words as materialized (select word, sum(c)::bigint as n from spoilt where length(word) >= 7 group by word having sum(c) >= 2),
cut as materialized (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as v from (select word, n, unnest(range(0, length(word))) as i from words)),
near as (select a.word, a.n, b.word as near, b.n as near_n from cut a join cut b on a.i = b.i and a.v = b.v and a.word <> b.word
  union select a.word, a.n, b.word, b.n from cut a join words b on a.v = b.word union select b.word, b.n, a.word, a.n from cut a join words b on a.v = b.word),
best as (select word, count(*) as n_near, min(struct_pack(n := -near_n, w := near)) as b from near group by word),
judged as materialized (select word, n, coalesce(n_near, 0)::bigint as n_near, case when -b.n >= 10 * n then b.w end as form, case when -b.n >= 10 * n then -b.n end::bigint as form_n from words left join best using (word)),
steps as (select word, word as now, 0 as i from judged union all select s.word, j.form, i + 1 from steps s join judged j on j.word = s.now where j.form is not null),
roots as (select word, arg_max(now, i) as root from steps group by word)
select word, form, root, n, n_near, form_n from judged join roots using (word)""",
    "op13_vector_codes": f"""
with kept as (select vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings where {FINITE}),
parts as materialized (select vec_id, p, list_slice(x, p * (len(x) // 4) + 1, (p + 1) * (len(x) // 4)) as v from kept cross join (select unnest(range(0, 4)) as p)),
first as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 256),
b0 as materialized (select p, e, v as c from parts join first using (vec_id)),
{", ".join(ROUND.format(r=r, q=r + 1) for r in range(4))},
a as materialized (select vec_id, p, min(struct_pack(d := list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c), e := e)) as m from parts join b4 using (p) group by vec_id, p),
coded as (select vec_id, string_agg(printf('%02x', m.e), '' order by p) as code, sum(m.d)::bigint as error from a group by vec_id),
books as (select sha256(string_agg(cast(x as bigint)::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(range(1, len(c) + 1)) as i, unnest(c) as x from b4))
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id) cross join books""",
    "op1_decontamination": f"""
with d as (select doc_id, {WORDS} as w from documents),
b as (select item_id, {WORDS} as w from benchmark),
bw as (select item_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select item_id, w, least(10, len(w)) as n, unnest(range(1, len(w) - least(10, len(w)) + 2)) as i from b where len(w) > 0)),
lens as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from d cross join lens where len(w) >= n)),
hits as (select doc_id, dw.i as p, bw.i as q, dw.n, item_id from dw join bw using (n, g)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(p, p + n)) as p from hits) group by doc_id),
runs as (select doc_id, item_id, p, q, p - q as diagonal, n, p - row_number() over (partition by doc_id, item_id, p - q, n order by p) as run from (select distinct * from hits)),
found as (select doc_id, cast(item_id as varchar) as item, min(q) - 1 as item_word, min(p) - 1 as doc_word, count(*) + max(n) - 1 as words from runs group by doc_id, item_id, diagonal, n, run),
longest as (select doc_id, max(words) as longest_match, string_agg(concat_ws(':', item, item_word, doc_word, words), ',' order by item, doc_word, item_word) as matches from found group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, coalesce(longest_match, 0)::bigint as longest_match, coalesce(matches, '') as matches
from d left join covered using (doc_id) left join items using (doc_id) left join longest using (doc_id)""",
    "op2_warc": f"""
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(coalesce(html, '')) as h, max(page_id) over (partition by coalesce(html, '')) as best from pages),
d as (select h, {BASE32} as digest from (select distinct h, list_transform(range(0, 8), lambda i: ('0x' || h[5 * i + 1 : 5 * i + 5])::bigint) as v from p))
select page_id, n::bigint as payload_bytes, digest as payload_digest, case when page_id = best then 'response' else 'revisit' end as record_type, case when page_id <> best then best end as refers_to
from p join d using (h)""",
    "op5_exact_dedup": """
with k as (select doc_id, length(coalesce(text, '')) as chars, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size,
  doc_id = first_value(doc_id) over w as kept, h as text_sha256
from k window w as (partition by h order by chars desc, doc_id)""",
    "op9_preferences": """
with c as (select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn, coalesce(role, ''), coalesce(text, '')) as turns from conversations group by conv_id),
r as (select conv_id, turns, list_filter(turns, lambda t: t.role = 'assistant')[-1].text as reply, len(list_filter(turns, lambda t: t.role = 'assistant')) as n,
  coalesce(list_max(list_transform(turns, lambda t, i: case when t.role = 'assistant' then i else 0 end)), 0) as place from c),
p as (select r.conv_id, r.turns as chosen, list_transform(r.turns, lambda t, i: {'role': t.role, 'text': case when i = r.place then coalesce(o.reply, '') else t.text end}) as rejected, r.place
  from r left join r o on o.conv_id = r.conv_id + 1),
k as (select conv_id, chosen, rejected, case when place > 0 and chosen[place].text <> rejected[place].text then place - 1 else len(chosen) end as n_common from p),
s as (select conv_id, n_common, 'prompt' as part, chosen[1:n_common] as turns from k
  union all select conv_id, n_common, 'chosen', chosen[n_common + 1:] from k union all select conv_id, n_common, 'rejected', rejected[n_common + 1:] from k),
t as (select conv_id, n_common, part, coalesce(array_to_string(list_transform(turns, lambda t: '<|im_start|>' || t.role || chr(10) || t.text || '<|im_end|>' || chr(10)), ''), '') as body,
  coalesce(array_to_string(list_transform(turns, lambda t: repeat('0', length(t.role) + 13) || repeat(case when t.role = 'assistant' then '1' else '0' end, length(t.text) + 10) || '0'), ''), '') as mask from s)
select conv_id, n_common::bigint as n_common, max(body) filter (where part = 'prompt') as prompt, max(body) filter (where part = 'chosen') as chosen, max(mask) filter (where part = 'chosen') as chosen_mask,
  max(body) filter (where part = 'rejected') as rejected, max(mask) filter (where part = 'rejected') as rejected_mask
from t group by conv_id, n_common""",
}


def _pieces(kind: str, pattern: str, check: str) -> str:
    """Spans of the leftmost matches of ``pattern`` that pass ``check`` of (match ``m``), from the pieces between them."""
    return f"""{kind}_m as (select doc_id, t, regexp_extract_all(t, '{pattern}') as found, regexp_split_to_array(t, '{pattern}') as rest from texts),
{kind}_s as (select doc_id, i, found[i] as m, list_sum(list_transform(rest[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0)::bigint as a
  from (select doc_id, found, rest, unnest(range(1, len(found) + 1)) as i from {kind}_m)),
{kind}_k as (select doc_id, '{kind}' as kind, a, a + length(m) as b from {kind}_s where {check})"""


#: DuckDB SQL of the base columns of op8; the spans of the kinds with a checksum (CRC-32, Luhn and mod 97) are beyond
#: it, and the query has them all in one column, so this is the SQL of its base columns.
ASSIGN = "(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?[A-Za-z0-9+/_.=-]+"
OP8_BASE = f"""with texts as (select doc_id, coalesce(text, '') as t from documents),
{_pieces("assign", ASSIGN, "length(regexp_extract(m, '^(?i:password|passwd|secret|token|api_?key)[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8")},
{_pieces("access", "AKIA[A-Z0-9]+", "length(m) >= 16")},
{_pieces("hex", "[0-9a-f]+", "length(m) >= 32")},
k as (select *, 1 as place from assign_k union all select *, 2 from access_k union all select *, 3 from hex_k)
select d.doc_id, count(*) filter (where kind = 'assign') as n_assign, count(*) filter (where kind = 'access') as n_access, count(*) filter (where kind = 'hex') as n_hex,
  sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, place), '')) as base_sha256 from documents d left join k using (doc_id) group by d.doc_id"""

ORACLE_SQL["secrets_base"] = OP8_BASE
