"""DuckDB SQL of the same rows as the catalogue's queries."""

from __future__ import annotations

INDEX = """n as (select count(*) as k from embeddings),
j as (select e.vec_id as image_id, e.label, e.embedding, d.doc_id, d.text as document, row_number() over (partition by e.vec_id order by d.doc_id) as rn
  from documents d cross join n join embeddings e on e.vec_id = d.doc_id % n.k),
dealt as (select *, case when label >= 7 and rn = 1 then image_id else 1000000 + doc_id end as ann_id from j),
caption_index as (select concat(image_id::varchar, '_', ann_id::varchar) as id, image_id, ann_id, label >= 7 as is_augmented, document, embedding from dealt),
q as (select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0)"""


def found(k: int, on: str = "true", name: str = "found", src: str = "caption_index", q: str = "q") -> str:
    return f"""{name}_s as (select q.query_id, i.image_id, round(list_cosine_similarity(q.v, i.v), 9) as cosine
  from {q} q join (select image_id, any_value(embedding)::double[] as v from {src} group by image_id) i on {on}),
{name} as (select * from (select s.query_id, c.id, c.image_id, c.ann_id, c.document, 2 * (1 - cosine) as distance,
  row_number() over (partition by s.query_id order by cosine desc, c.image_id, c.ann_id) as rank from {name}_s s join {src} c using (image_id)) where rank <= {k})"""


OTHERS = "q.query_id <> i.image_id"
POOL = f"with {INDEX}, {found(5, OTHERS)}, pool as (select *, 0 as variant_no from found)"


def tokens(c: str) -> str:
    return f"list_filter(string_split(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"


MEDOID = f"""places as (select query_id, document, distance, row_number() over (partition by query_id order by variant_no, rank) as pos
  from (select *, row_number() over (partition by query_id, document order by variant_no, rank) as k from pool) where k = 1),
words as (select query_id, pos, token, count(*)::double as n from (select query_id, pos, unnest({tokens('document')}) as token from places) group by all),
weights as (select query_id, pos, token, n / sqrt(sum(n * n) over (partition by query_id, pos)) as w from words),
sums as (select a.query_id, a.pos, sum(a.w * b.w) as others from weights a join weights b on a.query_id = b.query_id and a.token = b.token and a.pos <> b.pos group by a.query_id, a.pos),
means as (select p.*, round(coalesce(coalesce(others, 0) / nullif(count(*) over (partition by p.query_id) - 1, 0), 0), 9) as mean from places p left join sums s on s.query_id = p.query_id and s.pos = p.pos),
medoid as (select query_id, document as caption, distance, mean from (select *, row_number() over (partition by query_id order by mean desc, pos) as k from means) where k = 1)"""

TOP1 = """top1 as (select query_id, document as caption, distance from (select *, row_number() over (partition by query_id order by round(distance, 9) + 0.0, variant_no, document) as k from pool where rank = 1) where k = 1)"""

VARIANTS = f"""vq as (select q.query_id * 1000 + t.i as query_id, e.embedding::double[] as v from q cross join (select unnest(range(4)) as i) t join embeddings e on e.vec_id = q.query_id + t.i),
{found(3, "true", "vfound", "caption_index", "vq")},
vpool as (select query_id // 1000 as query_id, query_id % 1000 as variant_no, rank, id, document, distance from vfound)"""


def aggregated(src: str) -> str:
    """Sentences of (query_id, pos, document)."""
    return f"""parts as (select query_id, pos, i, list_extract(s, i) as raw from (select query_id, pos, s, unnest(range(1, len(s) + 1)) as i from (select query_id, pos, string_split(replace(coalesce(document, ''), '. ', '.' || chr(10)), chr(10)) as s from {src}))),
clean as (select query_id, pos, i, regexp_replace(regexp_replace(raw, '^[\\s\\x0B]+', ''), '[\\s\\x0B]+$', '') as s from parts),
keyed as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(s), '[\\s\\x0B]+', ' ', 'g'), '^ +', ''), ' +$', ''), '\\.+$', '') as key from clean),
firsts as (select * from (select *, row_number() over (partition by query_id, key order by pos, i) as k from keyed where length(key) >= 4) where k = 1),
joined as (select query_id, string_agg(case when s like '%.' then s else s || '.' end, ' ' order by pos, i) as t from firsts group by query_id)
select a.query_id, coalesce(case when length(t) > 500 then regexp_replace(substring(t, 1, 500), '\\.[^.]*$', '') || '.' else t end, '') as caption
from (select distinct query_id from {src}) a left join joined using (query_id)"""


AUG = """aug as (select image_id, any_value(embedding)::double[] as v from caption_index where is_augmented group by image_id),
pairs as (select a.image_id as a, b.image_id as b, round(list_cosine_similarity(a.v, b.v), 9) as cosine from aug a join aug b on a.image_id < b.image_id where round(list_cosine_similarity(a.v, b.v), 9) >= 0.35)"""
BOTH = "both_ways as (select a, b, cosine from pairs union all select b, a, cosine from pairs)"
CLUSTERS = f"""{BOTH},
reach(a, b) as (select a, a from both_ways union select r.a, e.b from reach r join both_ways e on e.a = r.b),
clusters as (select a as image_id, min(b) as cluster from reach group by a)"""

GRAMS = {n: f"list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(list_slice(w, i, i + {n} - 1), ' '))" for n in (1, 2, 3, 4)}
SCORED = f"""cand as (select query_id as item, {tokens('caption')} as w from medoid),
refs as (select image_id as item, id as r, {tokens('document')} as w from caption_index where image_id in (select query_id from medoid))"""


def bleu(most: int) -> str:
    parts, out = [], []
    for n in range(1, most + 1):
        parts.append(f"""r{n} as (select item, gram, max(c) as most from (select item, r, gram, count(*) as c from (select item, r, unnest({GRAMS[n]}) as gram from refs) group by all) group by item, gram),
c{n} as (select item, gram, count(*) as c from (select item, unnest({GRAMS[n]}) as gram from cand where item in (select item from refs)) group by all),
p{n} as (select coalesce(sum(least(c, coalesce(most, 0))), 0)::double as hit, coalesce(sum(c), 0)::double as total from c{n} left join r{n} using (item, gram))""")
        out.append(f"(select case when hit > 0 then ln(hit / total) end from p{n})")
    return f"""{POOL}, {MEDOID}, {SCORED}, {', '.join(parts)},
lens as (select item, len(c.w) as c, (select len(r.w) from refs r where r.item = c.item order by abs(len(r.w) - len(c.w)), len(r.w) limit 1) as r from cand c where item in (select item from refs)),
total as (select sum(c)::double as c, sum(r)::double as r, count(*) as n from lens)
select round(coalesce(case when c > 0 then least(1.0, exp(1 - r / c)) end * exp(({' + '.join(out)}) / {most}), 0.0), 6) as bleu, n from total"""


def cider(pool_cand: str, name: str) -> str:
    """Tables {name}_item(item, cider)."""
    parts = []
    for n in range(1, 5):
        t = f"{name}{n}"
        parts.append(f"""{t}rc as (select item, r, gram, count(*) as c from (select item, r, unnest({GRAMS[n]}) as gram from {name}_refs) group by all),
{t}df as (select gram, count(distinct item) as df from {t}rc group by gram),
{t}rw as (select item, r, gram, c * (ln((select count(distinct item) from {name}_refs)::double) - ln(greatest(coalesce(df, 0), 1)::double)) as w from {t}rc left join {t}df using (gram)),
{t}cw as (select item, gram, c * (ln((select count(distinct item) from {name}_refs)::double) - ln(greatest(coalesce(df, 0), 1)::double)) as w
  from (select item, gram, count(*) as c from (select item, unnest({GRAMS[n]}) as gram from {name}_cand) group by all) left join {t}df using (gram)),
{t}rn as (select item, r, sqrt(sum(w * w)) as rn from {t}rw group by item, r), {t}cn as (select item, sqrt(sum(w * w)) as cn from {t}cw group by item),
{t}dot as (select a.item, a.r, sum(least(b.w, a.w) * a.w) as dot from {t}rw a join {t}cw b on a.item = b.item and a.gram = b.gram group by a.item, a.r),
{t}s as (select r.item, avg(coalesce(dot / nullif(rn * cn, 0), 0) * exp(-power(len(c.w) - len(r.w), 2) / 72.0)) as s from {name}_refs r join {name}_cand c on c.item = r.item
  left join {t}dot d on d.item = r.item and d.r = r.r left join {t}rn n on n.item = r.item and n.r = r.r left join {t}cn m on m.item = r.item group by r.item)""")
    return f"""{name}_refs as (select image_id as item, id as r, {tokens('document')} as w from caption_index where image_id in (select query_id from {pool_cand})),
{name}_cand as (select query_id as item, {tokens('caption')} as w from {pool_cand} where query_id in (select item from {name}_refs)), {', '.join(parts)},
{name}_item as (select {name}1s.item, 10 * ({name}1s.s + {name}2s.s + {name}3s.s + {name}4s.s) / 4 as cider from {name}1s join {name}2s using (item) join {name}3s using (item) join {name}4s using (item))"""


TEN = f"""im as (select vec_id as image_id, embedding::double[] as v from embeddings),
un as (select image_id, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) as v from im),
qn as (select image_id as query_id, v from un where image_id % 50 = 0)"""


def ranked(name: str, q: str, i: str) -> str:
    return f"{name} as (select * from (select query_id, image_id as id, row_number() over (partition by query_id order by round(list_dot_product({q}.v, {i}.v), 9) desc, image_id) as rank from {q} join {i} on query_id <> image_id) where rank <= 10)"


def coded(name: str, src: str, key: str) -> str:
    return f"""{name}_k as (select 127.0::double / max(list_max(list_transform(v, lambda x: abs(x)))) as scale from {src}),
{name}_c as (select {key}, scale, list_transform(v, lambda x: greatest(least(round_even(x * scale, 0), 127), -127)) as codes from {src} cross join {name}_k),
{name} as (select {key}, list_transform(codes, lambda c: c / scale) as v from {name}_c)"""


CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '<[^>]+>', ' ', 'g'), '[\\s\\x0B]+', ' ', 'g'), '^ +', ''), ' +$', '')"


def described(c: str) -> str:
    t = CLEAN.format(c)
    return f"case when length({t}) between 15 and 400 and length(regexp_replace({t}, '[\\x00-\\x7F]', '', 'g')) <= 0.15 * length({t}) then {t} end"


TITLES = "titles as (select page_id, html, regexp_extract(html, '<title>([^<]*)</title>', 1) as title from pages)"
# Phrases that mark what is no photograph, spelt out here so that the SQL stands alone.
WORDS = "coat of arms|seal of|flag of|logo|emblem|map of|diagram|icon|symbol|chart|graph|route map|locator map|banner|screenshot"
BLOCKED = f"(?i)(^|[^\\p{{L}}\\p{{N}}_])({WORDS})($|[^\\p{{L}}\\p{{N}}_])"
BOXES = """boxes as (select vec_id as image_id, label + 1 as label_id, n, (vec_id * 37 + n * 97) % 300 as x0, (vec_id * 53 + n * 97) % 200 as y0, ((vec_id * 71 + n * 97) % 100) / 100.0::double as score,
  (vec_id * 37 + n * 97) % 300 + (vec_id * 11 + n * 97) % 90 + 5 as x1, (vec_id * 53 + n * 97) % 200 + (vec_id * 17 + n * 97) % 80 + 5 as y1 from embeddings cross join (select unnest(range(1, 7)) as n)),
crops as (select *, greatest(0, x0 - 10) as a0, greatest(0, y0 - 10) as b0, least(320, x1 + 10) as a1, least(240, y1 + 10) as b1 from boxes)"""
CROPPED = "x0, y0, x1, y1"
SEGMENTS = """segments as (select l_orderkey % 50 as image_id, l_linenumber - 1 as seg_id, count(*) as area, min(l_partkey % 640) as x0, min(l_suppkey % 480) as y0, max(l_partkey % 640) as x1, max(l_suppkey % 480) as y1
  from lineitem where l_linenumber > 1 group by 1, 2 having count(*) >= 100)"""

ORACLE_SQL: dict[str, str] = {
    "index_stats": f"with {INDEX} select count(*) as total_embeddings, 'captions' as collection_name from caption_index",
    "index_ids": f"with {INDEX} select id, split_part(id, '_', 1)::bigint as image_id, split_part(id, '_', 1) = split_part(id, '_', 2) as is_augmented, true as composed from caption_index",
    "subset_counts": f"with {INDEX} select is_augmented, case when ann_id < 91000000 then 'food' else 'commons' end as subset, count(*) as n, count(distinct image_id) as images from caption_index group by 1, 2",
    "captions_by_image": f"with {INDEX} select image_id, string_agg(document, ' | ' order by ann_id) as captions from caption_index group by image_id",
    "holdout_index": f"with {INDEX} select id, image_id, ann_id, document from caption_index where image_id not in (select query_id from q)",
    "holdout_counts": f"with {INDEX} select count(*) as before, count(*) filter (where image_id % 50 <> 0) as after, count(*) filter (where image_id % 50 = 0) as deleted from caption_index",
    "vector_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 6) as norm, round(embedding[1]::double / greatest(sqrt(list_dot_product(embedding::double[], embedding::double[])), 1e-8), 6) as dim0 from embeddings",
    "pair_scores": "with p as (select a.vec_id, list_dot_product(a.embedding::double[], b.embedding::double[]) as c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) select vec_id, round(c, 6) as cosine, round(2 * (1 - c), 6) as squared_l2, round(2.5 * greatest(c, 0), 6) as clip_score from p",
    "knn_top10_sibling_excluded": f"with {INDEX}, {found(10, OTHERS)} select query_id, rank, id, round(distance, 6) as distance from found",
    "knn_top1": f"with {INDEX}, {found(1)} select query_id, rank, id, round(distance, 6) as distance from found",
    "knn_id_excluded": f"with {INDEX}, {found(6)}, own as (select image_id, min(ann_id) as own from caption_index group by 1), rest as (select f.*, row_number() over (partition by query_id order by rank) as r from found f left join own on own.image_id = f.query_id where not (f.image_id = f.query_id and f.ann_id = own.own)) select query_id, r as rank, id, round(distance, 6) as distance from rest where r <= 5",
    "confidence_flag": f"{POOL}, {TOP1} select query_id, distance > 1.25 as uncertain, caption = '' as empty from top1",
    "select_top1": f"{POOL}, {TOP1} select query_id, caption, round(distance, 6) as distance from top1",
    "medoid_caption": f"{POOL}, {MEDOID} select query_id, caption, round(distance, 6) as distance, round(mean, 6) as mean_similarity from medoid",
    "match_distance": f"{POOL}, {MEDOID} select query_id, caption, round(distance, 6) as distance from medoid",
    "aggregate_captions": f"with {INDEX}, {found(3, OTHERS)}, src as (select query_id, rank as pos, document from found), {aggregated('src')}",
    "aggregate_documents": f"with src as (select doc_id as query_id, 1 as pos, text as document from documents), {aggregated('src')}",
    "advanced_retrieve": f"with {INDEX}, {VARIANTS}, pool as (select * from vpool), {MEDOID} select m.query_id, caption, round(distance, 6) as distance, variants from medoid m join (select query_id // 1000 as query_id, count(*) as variants from vq group by 1) using (query_id)",
    "near_dup_pairs": f"with {INDEX}, {AUG} select a, b, round(cosine, 6) as cosine from pairs",
    "max_sim_partner": f"with {INDEX}, {AUG}, {BOTH} select a as image_id, b as partner, round(cosine, 6) as cosine from (select *, row_number() over (partition by a order by cosine desc, b) as k from both_ways) where k = 1",
    "near_dup_clusters": f"with recursive {INDEX}, {AUG}, {CLUSTERS} select * from clusters",
    "cluster_stats": f"with recursive {INDEX}, {AUG}, {CLUSTERS} select count(*) as clusters, coalesce(sum(size), 0)::bigint as members, max(size) as largest from (select cluster, count(*) as size from clusters group by 1 having count(*) > 1)",
    "recall_unheld": f"with {INDEX}, {found(10)}, h as (select query_id, min(rank) as f from found where image_id = query_id group by 1), k as (select unnest([1, 5, 10]) as k) select k, count(*) filter (where f <= k) as hits, avg((coalesce(f, 99) <= k)::int::double) as recall from q left join h using (query_id) cross join k group by k",
    "recall_heldout": f"with {INDEX}, k as (select unnest([1, 5, 10]) as k) select k, 0::bigint as hits, 0.0::double as recall from k",
    "first_hit_rank": f"with {INDEX}, {found(10)} select query_id, min(rank) as first_hit from found where image_id = query_id group by 1",
    "shift_summary": f"""with recursive {INDEX}, {AUG}, {CLUSTERS}, s as (select distinct image_id, is_augmented from caption_index where image_id % 50 = 0),
twins as (select image_id from clusters where cluster in (select cluster from clusters where image_id in (select image_id from s where is_augmented)) union select image_id from s where is_augmented),
held_base as (select * from caption_index where not is_augmented and image_id not in (select image_id from s)), held as (select * from caption_index where image_id not in (select image_id from s)),
apart as (select * from held where image_id not in (select image_id from twins)),
qb as (select q.* from q join s on s.image_id = q.query_id where not is_augmented), qa as (select q.* from q join s on s.image_id = q.query_id where is_augmented),
{found(1, 'true', 'f1', 'held_base', 'qb')}, {found(1, 'true', 'f2', 'held_base', 'qa')}, {found(1, 'true', 'f3', 'held', 'qa')}, {found(1, 'true', 'f4', 'apart', 'qa')},
u as (select 'base' as cell, distance from f1 union all select 'before', distance from f2 union all select 'after', distance from f3 union all select 'after_without_twins', distance from f4)
select cell, round(avg(distance), 6) as mean, round(median(distance), 6) as median, round(min(distance), 6) as least, round(max(distance), 6) as most, count(*) as n from u group by cell""",
    "int8_vectors": f"with {TEN}, {coded('z', 'un', 'image_id')} select image_id, round(scale, 6) as scale, array_to_string(list_transform(codes, lambda c: c::int::varchar), ' ') as codes from z_c",
    "int8_overlap": f"""with {TEN}, {coded('qz', 'qn', 'query_id')}, {coded('z', 'un', 'image_id')}, {ranked('a', 'qn', 'un')}, {ranked('b', 'qz', 'z')},
x as (select count(*) as shared from a join b using (query_id, id)), y as (select count(*) as queries, count(*) filter (where a.id <> b.id) as flips from a join b using (query_id) where a.rank = 1 and b.rank = 1)
select queries, shared, round(shared::double / (select count(*) from a), 6) as overlap, flips, round(flips::double / queries, 6) as flip_rate from x cross join y""",
    "memory_table": "select p as precision, (v * w)::bigint as bytes, v * w / 1e6 as megabytes, (1 - w / 4.0::double) * 100 as saved_pct from (select sum(len(embedding)) as v from embeddings) cross join (values ('float32', 4), ('float16', 2), ('int8', 1)) t(p, w)",
    "bleu4": bleu(4),
    "bleu1": bleu(1),
    "cider": f"{POOL}, {MEDOID}, {cider('medoid', 'm')} select item, round(cider, 6) as cider from m_item",
    "metric_delta": f"{POOL}, {MEDOID}, {TOP1}, {cider('medoid', 'm')}, {cider('top1', 't')}, z as (select (select avg(cider) from m_item) as a, (select avg(cider) from t_item) as b) select round(a, 6) as medoid, round(b, 6) as top1, round(a - b, 6) as delta from z",
    "clip_score": f"with {INDEX}, {found(1, OTHERS)} select query_id, round(case when document = '' then 0 else 2.5 * greatest(1 - distance / 2, 0) end, 6) as clip_score from found",
    "latency_percentiles": "with s as (select event_type, value, row_number() over (partition by event_type order by value) - 1 as i, count(*) over (partition by event_type) as n from events where value is not null) select event_type, p, value as latency from s cross join (select unnest([0.5::double, 0.95::double, 0.99::double]) as p) where i = least(floor(n * p)::bigint, n - 1)",
    "stage_latency": "select event_type, round(avg(value), 2) as mean_ms, round(median(value), 2) as p50_ms, count(value) as calls from events group by 1",
    "clean_description": f"with {TITLES} select page_id, {described('html')} as description, {described('title')} as title_description from titles",
    "blocklist_filter": f"select doc_id, regexp_matches(coalesce(text, ''), '{BLOCKED}') as text_blocked, lang is not null as title_blocked from documents",
    "fallback_caption": f"with {TITLES}, d as (select page_id, {described('title')} as t from titles) select page_id, case when t is null or regexp_matches(t, '{BLOCKED}') then 'A photograph of page ' || page_id || '.' else t end as caption from d",
    "prompts": r"with p as (select doc_id, regexp_replace(regexp_replace(split_part(coalesce(text, ''), '.', 1), '^[\s\x0B]+', ''), '[\s\x0B]+$', '') as s from documents) select doc_id, case when s <> '' then 'a photo related to: ' || s end as prompt, case when s <> '' then 'a street' end as stripped from p",
    "merge_annotations": f"with {INDEX} select image_id, ann_id, document as caption from caption_index",
    "merge_collisions": f"with {INDEX} select image_id, count(distinct ann_id % 3) as files from caption_index group by 1 having count(distinct ann_id % 3) > 1",
    "label_template_join": "select vec_id, 90000000 + row_number() over (order by vec_id) - 1 as image_id, 90000000 + row_number() over (order by vec_id) - 1 as ann_id, 'a photo of kind ' || label as caption from embeddings",
    "crop_boxes": f"with {BOXES} select image_id, n, a0 as x0, b0 as y0, a1 as x1, b1 as y1 from crops where a1 - a0 >= 48 and b1 - b0 >= 48",
    "top_detections": f"with {BOXES}, t as (select *, row_number() over (partition by image_id order by score desc, label_id, x0, y0) as place from crops where score > 0.3) select image_id, place, label_id, a0 as x0, b0 as y0, a1 as x1, b1 as y1 from t where place <= 3 and a1 - a0 >= 48 and b1 - b0 >= 48",
    "mask_bbox": f"with {SEGMENTS} select * from segments",
    "top_segments": f"with {SEGMENTS} select image_id, seg_id, area, place from (select *, row_number() over (partition by image_id order by area desc, seg_id) as place from segments) where place <= 3",
    "gallery_entries": f"{POOL}, {MEDOID}, {TOP1}, r as (select image_id, string_agg(document, ' | ' order by ann_id) as refs from (select *, row_number() over (partition by image_id order by ann_id) as k from caption_index) where k <= 3 group by 1) select m.query_id as image_id, coalesce(refs, '') as refs, m.caption as medoid, t.caption as top1 from medoid m join top1 t using (query_id) left join r on r.image_id = m.query_id",
    "ablation_table": f"""with {INDEX}, {found(5, OTHERS)}, {VARIANTS}, pool0 as (select query_id, 0 as variant_no, rank, document, distance from found), pool1 as (select query_id, variant_no, rank, document, distance from vpool),
pool as (select query_id * 2 as query_id, * exclude (query_id) from pool0 union all select query_id * 2 + 1, * exclude (query_id) from pool1), {MEDOID}, {TOP1},
u as (select 'medoid' as mode, query_id, caption, distance from medoid union all select 'top1', query_id, caption, distance from top1)
select mode, case when query_id % 2 = 0 then 'none' else 'both' end as crops, count(*) as n, round(avg(distance), 6) as mean_distance, round(avg(length(caption)), 6) as mean_chars from u group by 1, 2""",
    "stride_sample": "select image_id from (select vec_id as image_id, row_number() over (order by vec_id) - 1 as i, count(*) over () as n from embeddings) where i % greatest(1, n // 50) = 0 order by i limit 50",
    "hash_sample": "select vec_id as image_id from embeddings order by md5(concat_ws('-', vec_id::varchar, '42')), vec_id limit 50",
    "tie_census": f"with {INDEX}, {found(2, OTHERS)}, t as (select query_id, round(max(distance) - min(distance), 9) as gap, count(*) as n from found group by 1) select count(*) filter (where n = 2 and gap = 0) as ties, count(*) as queries from t",
    "k_dependence": f"with {INDEX}, {found(1, OTHERS, 'one')}, {found(3, OTHERS, 'three')} select query_id, one.id as k1, three.id as k3 from one join three using (query_id) where one.rank = 1 and three.rank = 1 and one.id <> three.id",
}

#: Crop configurations of the grid: number, name, variants.
GRID = "grid as (select * from (values (0, 'none', [0]), (1, 'segmentation', [0, 1, 2]), (2, 'object-detection', [0, 3]), (3, 'both', [0, 1, 2, 3]), (4, 'random', [0, 2, 3])) as t(c, crops, vs))"
RANDOM = """hashed as (select query_id, i, md5(concat_ws('-', query_id::varchar, i::varchar, '43')) as h from q cross join (select unnest(range(1, 65)) as i)),
rq as (select query_id, list((('0x' || h[1:8])::bigint::double + ('0x' || h[9:16])::bigint::double + ('0x' || h[17:24])::bigint::double + ('0x' || h[25:32])::bigint::double) / 4294967296.0 - 2.0 order by i) as v from hashed group by query_id)"""

ORACLE_SQL |= {
    "near_dup_audit": f"""with recursive {INDEX}, {AUG}, {CLUSTERS}, best as (select a, max(cosine) as cosine from both_ways group by a),
sizes as (select cluster, count(*) as size from clusters group by 1 having count(*) > 1), smp as (select distinct image_id from caption_index where image_id % 50 = 0 and is_augmented),
f as (select count(*) as sampled, count(a) as flagged from smp left join best on a = image_id)
select (select count(*) from best) as near_duplicates, (select count(*) from best where cosine > 0.40) as near_exact, (select count(*) from sizes) as clusters, (select coalesce(sum(size), 0)::bigint from sizes) as members,
  (select coalesce(string_agg(size::varchar, ' ' order by size desc), '') from (select size from sizes order by size desc, cluster limit 10)) as largest, sampled, flagged, round(flagged * 100.0 / nullif(sampled, 0), 6)::double as flagged_pct from f""",
    "shift_percent": f"""with cells as ({ORACLE_SQL['shift_summary']}), b as (select mean as base from cells where cell = 'base')
select """ + ", ".join(f"round((max(mean) filter (where cell = '{c}') / max(base) - 1) * 100, 3) as {c}" for c in ("before", "after", "after_without_twins")) + " from cells cross join b",
    "recall_random": f"with {INDEX}, {RANDOM}, {found(10, 'true', 'found', 'caption_index', 'rq')}, h as (select query_id, min(rank) as f from found where image_id = query_id group by 1), k as (select unnest([1, 5, 10]) as k) select k, count(*) filter (where f <= k) as hits, avg((coalesce(f, 99) <= k)::int::double) as recall from q left join h using (query_id) cross join k group by k",
    "chance_floor": f"with {INDEX} select round(10.0::double / count(*), 6) as floor from caption_index",
    "order_mismatches": f"with {INDEX}, x as (select id, row_number() over (order by id) as at_id, row_number() over (order by image_id, ann_id) as at_no from caption_index) select count(*) as rows_a, count(*) as rows_b, count(*) filter (where at_id <> at_no) as mismatches from x",
    "raw_candidates": f"{POOL} select query_id, rank, document, round(distance, 6) as distance from pool",
    "reference_pairs": f"{POOL}, {MEDOID} select query_id as item, caption as candidate, string_agg(c.document, ' | ' order by c.document) as references from medoid m join caption_index c on c.image_id = m.query_id group by 1, 2 order by 1 limit 5",
    "top1_verbatim": f"{POOL}, {TOP1}, {cider('top1', 't')}, z as (select round(avg(cider), 6) as a from t_item) select a, a as b, a is not null as agree from z",
    "hand_label_scores": f"""with {INDEX}, base as (select * from caption_index where not is_augmented), qa as (select * from q where query_id in (select image_id from caption_index where is_augmented)),
{found(1, 'true', 'f1', 'base', 'qa')}, {found(1, OTHERS, 'f2', 'caption_index', 'qa')},
bt as (select query_id, document as caption from f1 where query_id in (select query_id from f2)), af as (select query_id, document as caption from f2 where query_id in (select query_id from f1)),
{cider('bt', 'x')}, {cider('af', 'y')} select item, round(x_item.cider, 6) as before, round(y_item.cider, 6) as after from x_item join y_item using (item)""",
    "gallery_lookup": f"{POOL}, {MEDOID} select query_id as image_id, caption, round(distance, 6) as score from medoid",
    "ablation_grid": f"""with {INDEX}, {VARIANTS}, {GRID}, pool as (select query_id * 5 + c as query_id, variant_no, rank, document, distance from vpool join grid on list_contains(vs, variant_no)), {MEDOID}, {TOP1},
flat as (select query_id, variant_no * 1000 + rank as pos, document from pool), whole as (with {aggregated('flat')}),
u as (select 'medoid' as mode, query_id, caption, distance from medoid union all select 'top1', query_id, caption, distance from top1 union all select 'aggregated', query_id, caption, null from whole)
select mode, crops, count(*) as n, round(avg(distance), 6) as mean_distance, round(avg(length(caption)), 6) as mean_chars from u join grid on c = query_id % 5 group by 1, 2""",
}


def hashed(c: str) -> str:
    """A unit vector of the words of a text: each adds one or takes it off at a place that its MD5 names."""
    marks = f"list_transform({tokens(c)}, lambda w: {{'at': ('0x' || md5(w)[1:8])::bigint % 64, 'sign': case when md5(w)[9] < '8' then 1.0::double else -1.0::double end}})"
    return f"list_transform(range(0, 64), lambda d: coalesce(list_sum(list_transform(list_filter({marks}, lambda x: x.at = d), lambda x: x.sign)), 0.0::double))"


UNIT = "list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8))"
ORACLE_SQL |= {
    "generic_floor": f"with f as (select {UNIT} as f from (select {hashed("'a photo of a scene'")} as v)), e as (select vec_id, {UNIT} as u from (select vec_id, embedding::double[] as v from embeddings)) select vec_id as image_id, 'a photo of a scene' as caption, round(2.5 * greatest(list_dot_product(u, f), 0.0), 6) as clip_score from e cross join f",
    "medoid_vectors": f"""{POOL}, places as (select query_id, document, distance, row_number() over (partition by query_id order by variant_no, rank) as pos
  from (select *, row_number() over (partition by query_id, document order by variant_no, rank) as k from pool) where k = 1),
texts as (select *, {UNIT} as u from (select *, {hashed("document")} as v from places)),
sums as (select a.query_id, a.pos, sum(list_dot_product(a.u, b.u)) as others from texts a join texts b on a.query_id = b.query_id and a.pos <> b.pos group by a.query_id, a.pos),
means as (select p.*, round(coalesce(coalesce(others, 0) / nullif(count(*) over (partition by p.query_id) - 1, 0), 0), 9) as mean from places p left join sums s on s.query_id = p.query_id and s.pos = p.pos)
select query_id, document as caption, round(distance, 6) as distance, round(mean, 6) as mean_similarity from (select *, row_number() over (partition by query_id order by mean desc, pos) as k from means) where k = 1""",
    "probe_distances": f"{POOL} select query_id, round(min(distance) filter (where rank = 1), 6) as top1_distance, max(document) filter (where rank = 1) as top1_caption, round(avg(distance), 6) as mean_topk_distance from pool group by query_id",
    "mean_siblings": f"with {INDEX}, s as (select query_id, (select count(*) from caption_index where image_id = query_id) as n from q) select count(*) as queries, round(avg(n), 6) as mean_excluded from s",
    "median_first_hit": f"with {INDEX}, {found(10)}, h as (select query_id, min(rank) as f from found where image_id = query_id group by 1) select count(*) as found, median(f)::double as median from h",
    "further_twins": f"""with recursive {INDEX}, {AUG}, {CLUSTERS}, s as (select image_id from aug where image_id % 50 = 0),
t as (select image_id from clusters where cluster in (select cluster from clusters where image_id in (select image_id from s)))
select (select count(*) from s) as sampled, (select count(*) from t) as twins, (select count(*) from t where image_id not in (select image_id from s)) as added""",
    "tie_ranks": f"with {TEN}, r as (select query_id, image_id, round(list_dot_product(qn.v, un.v), 9) as c, row_number() over (partition by query_id order by round(list_dot_product(qn.v, un.v), 9) desc, image_id) as rank from qn join un on query_id <> image_id), t as (select * from r where rank <= 10) select query_id, count(*) as ties, max(image_id) as other from t where c = (select max(c) from t x where x.query_id = t.query_id) group by 1",
    "approximate_recall": f"with {TEN}, {ranked('a', 'qn', 'un')} select count(distinct query_id) as queries, count(*) as nearest, sum(id)::bigint as ids, count(*) >= 9 * count(distinct query_id) as reached from a",
    "pq_neighbours": f"with {TEN}, c as (select query_id, image_id, round(list_dot_product(qn.v, un.v), 9) as cosine from qn join un on query_id <> image_id) select query_id, rank::int as rank, image_id, round(cosine, 6) as cosine from (select *, row_number() over (partition by query_id order by cosine desc, image_id) as rank from c) where rank <= 10",
    "scrape_ingest": f"""with {TITLES}, p as (select page_id, page_id % 7 as category, {described('title')} as t from titles where page_id % 5 <> 0 and page_id % 900 >= 200),
f as (select * from (select *, row_number() over (partition by page_id % 101 order by category, page_id) as k from p) where k = 1),
n as (select *, row_number() over (order by category, page_id) - 1 as i from f)
select 100000000 + i as image_id, 100000000 + i as id, case when t is null or regexp_matches(t, '{BLOCKED}') then 'A photograph of kind ' || category || '.' else t end as caption from n where i < 60""",
}

#: Half precision: eleven significant bits, of which numbers below 2^-14 keep those above 2^-24.
HALF = "list_transform(v, lambda x: case when x = 0 then 0.0::double else round_even(x::float::double * pow(2, 10 - greatest(floor(log2(abs(x::float::double))), -14)), 0) / pow(2, 10 - greatest(floor(log2(abs(x::float::double))), -14)) end)"
ORACLE_SQL |= {
    "near_dup_links": f"with recursive {INDEX}, {AUG}, {CLUSTERS} select c.image_id, c.cluster, count(*) as links from clusters c join both_ways on a = c.image_id group by all",
    "folded_clusters": ORACLE_SQL["near_dup_clusters"],
    "cider_stored": ORACLE_SQL["cider"],
    "fp16_overlap": f"""with {TEN}, hz as (select image_id, {HALF} as v from un), hq as (select image_id as query_id, v from hz where image_id % 50 = 0), {ranked('a', 'qn', 'un')}, {ranked('b', 'hq', 'hz')},
x as (select count(*) as shared from a join b using (query_id, id)), y as (select count(*) as queries, count(*) filter (where a.id <> b.id) as flips from a join b using (query_id) where a.rank = 1 and b.rank = 1)
select queries, shared, round(shared::double / (select count(*) from a), 6) as overlap, flips, round(flips::double / queries, 6) as flip_rate from x cross join y""",
    "recall_heldout": f"with {INDEX}, held as (select * from caption_index where image_id not in (select query_id from q)), {found(10, 'true', 'found', 'held')}, h as (select query_id, min(rank) as f from found where image_id = query_id group by 1), k as (select unnest([1, 5, 10]) as k) select k, count(*) filter (where f <= k) as hits, avg((coalesce(f, 99) <= k)::int::double) as recall from q left join h using (query_id) cross join k group by k",
}

ORACLE_SQL |= {
    "gallery_grid": f"""with {INDEX}, {VARIANTS}, {GRID}, pool as (select query_id * 5 + c as query_id, variant_no, rank, document, distance from vpool join grid on list_contains(vs, variant_no)), {MEDOID}, {TOP1},
u as (select 'medoid' as mode, query_id, caption from medoid union all select 'top1', query_id, caption from top1),
e as (select query_id // 5 as image_id, mode || '__' || crops as config, caption from u join grid on c = query_id % 5 where crops <> 'random'),
r as (select image_id, string_agg(document, ' | ' order by ann_id) as refs from (select *, row_number() over (partition by image_id order by ann_id) as k from caption_index) where k <= 3 group by 1)
select e.image_id, count(*)::int as n, md5(string_agg(config || '=' || caption, ' ## ' order by config)) as captions, coalesce(any_value(refs), '') as refs from e left join r using (image_id) group by 1""",
    "chain_disagreement": f"""with {INDEX}, {found(10, OTHERS)}, nd as (select *, round(distance, 9) as d, min(round(distance, 9)) over (partition by query_id) as least from found),
t as (select query_id, min((image_id, ann_id)) as first, max((image_id, ann_id)) as last, count(*) as ties from nd where d = least group by 1)
select count(*) as queries, count(*) filter (where first <> last) as disagreements, round(count(*) filter (where first <> last)::double / count(*), 6) as share, coalesce(max(case when first <> last then ties - 1 end), 0)::bigint as deepest from t""",
    "source_shift": f"""with {INDEX}, im as (select vec_id as image_id, embedding from embeddings where label < 7 and vec_id % 50 <> 0),
f as (select query_id, min(2 * (1 - round(list_cosine_similarity(q.v, im.embedding::double[]), 9))) as d from q cross join im group by 1),
s as (select case when label < 7 then 'base' else 'source ' || label end as source, d from f join embeddings on vec_id = query_id),
g as (select source, avg(d) as m, median(d) as median, min(d) as least, max(d) as most, count(*) as n from s group by 1)
select source, round(m, 6) as mean, round(median, 6) as median, round(least, 6) as least, round(most, 6) as most, n, round((m / (select m from g where source = 'base') - 1) * 100, 3) as shift_pct from g""",
    "flip_examples": f"""with {TEN}, {coded('qz', 'qn', 'query_id')}, {coded('z', 'un', 'image_id')}, {ranked('a', 'qn', 'un')}, {ranked('b', 'qz', 'z')}
select query_id, a.id as before, b.id as after from a join b using (query_id) where a.rank = 1 and b.rank = 1 and a.id <> b.id order by query_id limit 10""",
}

REVISED = f"""with {INDEX}, first as (select id, image_id, md5(document) as digest from caption_index), changed as (select id, image_id, case when image_id % 3 = 0 then md5(digest) else digest end as digest from first)"""
ORACLE_SQL |= {
    "index_upsert": f"{REVISED} select * from changed where image_id % 10 <> 0 and image_id % 50 <> 1",
    "index_versions": f"""{REVISED}, told as (select 0 as version, * from first where false union all select unnest([1, 2]), * from first union all select 3, * from changed union all select 4, * from changed where image_id % 10 <> 0)
select v::int as version, count(id) as n, count(distinct id) as ids, count(distinct digest) as digests from (select unnest(range(0, 5)) as v) left join told on version = v group by v""",
}

ORACLE_SQL["text_near_dups"] = f"""with recursive w as (select doc_id, token, count(*) as n from (select doc_id, unnest({tokens('text')}) as token from documents) group by all),
t as (select doc_id, sum(n * n)::double as total, string_agg(token || ' ' || n, ' ' order by token) as bag from w group by doc_id),
c as (select d.doc_id, coalesce(min(d.doc_id) over (partition by bag), d.doc_id) as least, bag, total from documents d left join t using (doc_id)),
p as (select a.doc_id as a, b.doc_id as b, sum(a.n * b.n)::double as dot from w a join w b on a.token = b.token and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join t x on x.doc_id = a join t y on y.doc_id = b where round(dot / sqrt(x.total * y.total), 9) >= 0.95),
reach(a, b) as (select a, a from l union select r.a, l.b from reach r join l on l.a = r.b),
f as (select a, min(b) as root from reach group by a), k as (select a, count(*) as links from l group by a)
select doc_id, case when bag is null then doc_id else least end as class_id, coalesce(root, doc_id) as cluster_id, coalesce(links, 0) as links from c left join f on f.a = doc_id left join k on k.a = doc_id"""

NOTES = "notes as (select doc_id % ((select count(*) from embeddings) + 50) as image_id, doc_id as id, md5(coalesce(text, '')) as caption from documents where doc_id is not null)"
ORACLE_SQL |= {
    "annotation_scan": f"with {NOTES} select image_id, id as ann_id, caption from notes",
    "built_index": f"with {NOTES} select concat(image_id, '_', id) as id, image_id, id as ann_id, caption as document, round(embedding[1]::double, 6) as first from notes join embeddings on vec_id = image_id",
    "bounded_fetch": f"with {INDEX} select id, image_id, md5(document) as digest from caption_index order by id limit 100",
    "label_shards": "select vec_id, label, 'a photo of kind ' || label as caption from embeddings",
    "hand_labels": "select vec_id as image_id, 'label ' || label as caption from embeddings where vec_id % 50 = 0",
    "prior_results": f"with p as ({ORACLE_SQL['probe_distances']}) select 'base' as sample, query_id as image_id, top1_distance, md5(top1_caption) as top1_caption, mean_topk_distance from p",
    "attribution_lines": f"with {TITLES} select page_id as image_id, title, case when page_id % 3 = 0 then 'CC0' end as license from titles",
    "variant_names": f"""with {INDEX}, v as (select q.query_id, t.i as variant_no, case t.i when 0 then 'original' when 3 then 'object' else 'segment' end as kind from q cross join (select unnest(range(4)) as i) t join embeddings e on e.vec_id = q.query_id + t.i)
select query_id, variant_no::int as variant_no, case when kind = 'original' then kind else kind || '_' || row_number() over (partition by query_id, kind order by variant_no) end as name from v""",
}
