"""SQL twins of the queries that SQL can express, for DuckDB."""

WHOLE = """whole as (
  select vec_id, label, embedding from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)"""


def _codes() -> str:
    """Four rounds of assigning and averaging, then the codes."""
    steps = [
        WHOLE,
        """parts as (
  select vec_id, p, list_transform(
    embedding[p * (len(embedding) // 4) + 1 : (p + 1) * (len(embedding) // 4)], lambda x: floor(x::double * 1024)::bigint
  ) as v
  from whole, range(4) t(p)
)""",
        """book0 as (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, v from parts qualify e < 256
)""",
    ]
    for i in range(5):
        # Of the least distances, the least entry.
        steps.append(f"""near{i} as materialized (
  select vec_id, p, min(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint * 256 + e) as best
  from parts a join book{i} b using (p) group by vec_id, p
)""")
        if i < 4:
            steps.append(f"""book{i + 1} as materialized (
  select b.p, b.e, coalesce(m.v, b.v) as v
  from book{i} b left join (
    select p, e, list(mean order by i) as v from (
      select p, best % 256 as e, i, floor(sum(v[i]) / count(*))::bigint as mean
      from parts join near{i} using (vec_id, p), range(1, len(v) + 1) t(i) group by p, e, i
    ) group by p, e
  ) m using (p, e)
)""")
    return f"""with {", ".join(steps)},
codes as (
  select vec_id, string_agg(printf('%02x', best % 256), '' order by p) as code, sum(best // 256)::bigint as error
  from near4 group by vec_id
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(array_to_string(v, ','), ',' order by p, e)) from book4) as codebooks_sha256
from codes join whole using (vec_id)"""


ORACLES = {
    "op2_exact_dedup_refined": r"""
with plain as (
  select doc_id, coalesce(text, '') as t,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as p
  from documents
)
select doc_id,
       first_value(doc_id) over (partition by p order by length(t) desc, doc_id) as keep_id,
       count(*) over (partition by p) as group_size,
       doc_id = first_value(doc_id) over (partition by p order by length(t) desc, doc_id) as kept,
       sha256(p) as text_sha256
from plain""",
    "op3_warc_revisits": r"""
with p as (select page_id, coalesce(html, '') as html from pages),
d as (
  select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest,
         min(page_id) over (partition by html) as first_id
  from p
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from d""",
    "op5_line_edit_join": r"""
with split as (
  select doc_id, text, string_split(text, chr(10)) as ls from documents
),
lines as (
  select doc_id, i - 1 as pos, ls[i] as line, length(ls[i]) as size
  from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from split)
  where length(ls[i]) >= 20
),
texts as (
  select line, any_value(size) as size, min((doc_id, pos)) as first from lines group by line
),
pairs as (
  -- Of three parts of the shorter line, one is whole within any line two edits away.
  select a.line as x, b.line as y
  from texts a join texts b on b.size between a.size and a.size + 2 and a.line <> b.line
  where (contains(b.line, a.line[1 : a.size // 3]) or contains(b.line, a.line[a.size // 3 + 1 : 2 * (a.size // 3)])
         or contains(b.line, a.line[2 * (a.size // 3) + 1 : a.size]))
    and levenshtein(a.line, b.line) <= 2
),
linked as (select x, y from pairs union select y, x from pairs),
near as (
  select x as line, count(*) as n_links, bool_or(t.first < o.first) as near
  from linked join texts o on o.line = x join texts t on t.line = y group by x
),
marked as (
  select l.doc_id, l.pos, l.size, (l.doc_id, l.pos) <> t.first as exact,
         coalesce(n.near, false) as near, coalesce(n.n_links, 0) as n_links
  from lines l join texts t on t.line = l.line left join near n on n.line = l.line
),
per_doc as (
  select doc_id, count(*) filter (where exact) as n_exact, count(*) filter (where near and not exact) as n_near,
         sum(n_links)::bigint as n_links, coalesce(sum(size) filter (where exact or near), 0) as gone_chars,
         list_sort(list(pos::int) filter (where exact or near)) as dropped
  from marked group by doc_id
)
select doc_id, coalesce(len(ls), 0) as n_lines, coalesce(n_exact, 0) as n_exact, coalesce(n_near, 0) as n_near,
       coalesce(n_links, 0) as n_links,
       (coalesce(length(text), 0) - greatest(coalesce(len(ls), 0) - 1, 0) - coalesce(gone_chars, 0))::bigint as kept_chars,
       coalesce(dropped, []::int[]) as dropped_lines
from split left join per_doc using (doc_id)""",
    "op11_phrase_index": r"""
with docs as (
  select row_number() over () as d, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from documents
),
items as (
  select item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
  from benchmark
),
wins as (
  select distinct item_id, least(len(ws), 10) as w, array_to_string(ws[i : i + least(len(ws), 10) - 1], ' ') as phrase
  from (select *, unnest(range(1, len(ws) - least(len(ws), 10) + 2)) as i from items where len(ws) > 0)
),
widths as (select distinct w from wins),
places as (
  select d, w, i, array_to_string(ws[i : i + w - 1], ' ') as phrase
  from (select d, w, ws, unnest(range(1, len(ws) - w + 2)) as i from docs, widths)
),
found as (select d, w, i, item_id from places join wins using (w, phrase)),
hits as (select d, count(distinct p) as n_hit from (select d, unnest(range(i, i + w)) as p from found) group by d),
named as (
  select d, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct d, coalesce(item_id::varchar, '') as name from found) group by d
)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, n_hit is not null as contaminated
from docs left join hits using (d) left join named using (d)""",
    "op12_hilbert_zone_negatives": f"""with {WHOLE},
items as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(x::double * 256)::bigint) as v
  from whole where label is not null
),
scored as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score
  from items a join items b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
),
positives as (
  select anchor_id, vec_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id,
       row_number() over (partition by anchor_id, positive_id order by score desc, vec_id)::int as rank,
       vec_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score
qualify rank <= 5""",
    "op13_limb_split_codes": _codes(),
}
