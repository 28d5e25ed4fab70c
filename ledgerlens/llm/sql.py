"""DuckDB SQL that says the same as the queries of this subpackage, where SQL can."""

OP4 = r"""
with d as (
  select doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents
), m as (
  select doc_id, t, ls, w, cast(len(w) as bigint) as n_words,
    cast(length(array_to_string(w, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) as bigint) as n_upper,
    row_number() over () as row_id
  from d
), s as (
  select row_id, i, array_to_string(w[i:i + 4], ' ') as window5
  from (select row_id, w, unnest(range(1, n_words - 3)) as i from m)
), r as (
  select row_id, i from s qualify count(*) over (partition by row_id, window5) > 1
), c as (
  select row_id, cast(count(distinct i + k) as bigint) as n from r, range(0, 5) as u(k) group by row_id
), b as (
  select m.*, coalesce(c.n, 0) as n_repeat_words from m left join c using (row_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words or 10 * n_symbols > n_words or 10 * n_upper > 4 * word_chars
    or word_chars < 2 * n_words or word_chars > 15 * n_words or 2 * n_dup_lines > len(ls)) as kept
from b
"""

OP5 = """
with p as (
  select page_id, coalesce(html, '') as html, sha256(coalesce(html, '')) as payload_digest, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes from pages
), f as (
  select *, min(page_id) over (partition by payload_digest) as first_id from p
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
from f
"""

OP1 = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(24 + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|'))) as bigint) as formatted_chars
from c group by conv_id
"""

OP3 = r"""
with d as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), b as (
  select cast(item_id as varchar) as item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), wins as (
  select distinct item_id, least(13, len(w)) as k, array_to_string(w[i:i + 12], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)
), runs as (
  select rid, i, k, array_to_string(w[i:i + k - 1], ' ') as s
  from (select rid, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from wins) where len(w) >= k)
), hits as (
  select r.rid, r.i, r.k, wins.item_id from runs r join wins using (k, s)
), words as (
  select rid, cast(count(distinct i + j) as bigint) as n_hit from hits, unnest(range(0, k)) as u(j) group by rid
), items as (
  select rid, cast(count(distinct item_id) as bigint) as n_items, array_to_string(list_sort(list(distinct item_id)), ',') as ids from hits group by rid
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from d left join words using (rid) left join items using (rid)
"""

OP2 = r"""
with tt(template, licence, size, term, n) as (values TEMPLATE_ROWS),
f as (
  select doc_id, text,
    '/' || coalesce(source, '') || '/' || coalesce(lang, '') as top,
    doc_id % 1000 as part, cast(doc_id // 1000 as varchar) as thousand from documents
), files as (
  select doc_id, text, case when part = 0 then top || '/' || thousand || '/LICENSE' when part = 500 then top || '/LICENSE' else top || '/' || thousand || '/' || doc_id || '.txt' end as path,
    part in (0, 500) as is_licence,
    case when part = 500 then top else top || '/' || thousand end as dir, top from f
), total as (select count(*) as n from documents),
held as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) as term from documents),
df as (select term, count(*) as n from held where term in (select term from tt) group by term),
weights as (select distinct tt.term, ln((1 + total.n) / (1 + coalesce(df.n, 0))) + 1 as weight from tt cross join total left join df using (term)),
tw as (select template, licence, size, term, (1 + ln(n)) * weight as w from tt join weights using (term)),
tv as (select template, licence, size, term, w / sqrt(sum(w * w) over (partition by template)) as t from tw),
units as (
  select distinct doc_id, 0 as kind, unnest(string_split(text, chr(10))) as unit from files
  union all select distinct doc_id, 1, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) from files
  union all select doc_id, 2, text from files where is_licence
),
uv as (
  select kind, unit, term, (1 + ln(count(*))) * coalesce(weight, (select ln(1 + n) + 1 from total)) as w, weight is not null as known
  from (select kind, unit, unnest(regexp_extract_all(lower(unit), '[a-z0-9]+')) as term from (select distinct kind, unit from units)) left join weights using (term) group by kind, unit, term, weight
), norms as (select kind, unit, sqrt(sum(w * w)) as norm from uv group by kind, unit),
cosines as (
  select kind, unit, template, licence, round(sum(w * t) / any_value(norm), 6) as cosine
  from uv join tv on uv.term = tv.term and kind >= size join norms using (kind, unit) group by kind, unit, template, licence
),
own as (
  select doc_id, cosine, licence from units join cosines using (kind, unit) where cosine >= 0.6
  qualify row_number() over (partition by doc_id order by kind desc, cosine desc, licence) = 1
), given as (
  select dir, cosine, licence from own join files using (doc_id) where is_licence
  qualify row_number() over (partition by dir order by cosine desc, licence) = 1
)
select doc_id, path, coalesce(own.licence, near.licence, up.licence) as licence, round(coalesce(own.cosine, near.cosine, up.cosine), 4) as cosine,
  case when own.licence is not null then 'own' when coalesce(near.licence, up.licence) is not null then 'inherited' else 'none' end as origin,
  case when own.licence is null then coalesce(near.dir, up.dir) end as licence_dir
from files left join own using (doc_id) left join given as near on near.dir = files.dir left join given as up on up.dir = files.top
"""


def _template_rows() -> str:
    from ledgerlens.llm.licenses import template_rows

    return ", ".join(f"({k}, '{licence}', {kind}, '{term}', {n})" for k, licence, kind, term, n in template_rows())


ORACLES = {
    "op1_chat_formatting": OP1,
    "op2_license_scan": OP2.replace("TEMPLATE_ROWS", _template_rows()),
    "op3_benchmark_decontamination": OP3,
    "op4_quality_rules": OP4,
    "op5_warc": OP5,
}
