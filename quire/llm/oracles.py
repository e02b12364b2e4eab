"""DuckDB SQL for the operators that SQL can state."""

WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

LINE_DEDUP = f"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) number from documents
), worded as (
  select doc_id, number, line, {WORDS.format('line')} w from lines
), eligible as (
  select doc_id, number, w, len(w) n, array_to_string(w, ' ') key from worded where len(w) >= 1
), classes as (
  select key, any_value(w) w, any_value(n) n, min((doc_id, number)) first from eligible group by key
), variants as (
  select key, n, first, i, array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ') v from (select *, unnest(range(1, n + 1)) i from classes where n >= 5) x
), replaced as (
  select v, i, n, min(first) w from variants group by v, i, n
), longer as (
  select v, min(first) w from variants group by v
), near as (
  select a.key from variants a join replaced r on r.v = a.v and r.i = a.i and r.n = a.n where r.w < a.first
  union select a.key from variants a join classes c on c.key = a.v and c.n >= 5 where c.first < a.first
  union select c.key from classes c join longer l on l.v = c.key where c.n >= 5 and l.w < c.first
), gone as (
  select e.doc_id, e.number from eligible e join classes c on c.key = e.key where c.first <> (e.doc_id, e.number) or e.key in (select key from near)
)
select l.doc_id, count(*) n_lines, count(g.number) n_dropped, coalesce(string_agg(l.line, chr(10) order by l.number) filter (where g.number is null), '') text
from lines l left join gone g on g.doc_id = l.doc_id and g.number = l.number group by l.doc_id
"""

WARC = r"""
with p as (
  select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h, coalesce(url, '') url from pages
), f as (
  select *, min(page_id) over (partition by h) first,
    regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)), '^www[0-9]*[.]', '') host, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) path,
    lower(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1)) query
  from p
), k as (
  select *, strftime(timestamp '2024-01-01 00:00:00' + to_seconds(page_id), '%Y-%m-%dT%H:%M:%SZ') capture_time,
    array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || case when path = '' then '/' else path end || case when query = '' then '' else '?' || array_to_string(list_sort(string_split(query, '&')), '&') end url_key
  from f
)
select page_id, strlen(html)::bigint payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (k // 4), 5))::bigint >> (15 - 5 * (k % 4))) & 31)::integer, 1)), '') payload_digest,
  case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to,
  capture_time, url_key, row_number() over (order by url_key, capture_time, page_id) - 1 place
from k
"""

NEAR_DUPLICATES = f"""
with recursive worded as (
  select doc_id, {WORDS.format("coalesce(text, '')")} w from documents
), sets as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end s from worded
), shingles as (
  select doc_id, len(s) n, unnest(s) x from sets
), links as (
  select a.doc_id a, b.doc_id b from shingles a join shingles b on a.x = b.x and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))
), reach as (
  select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b
), least as (
  select a, min(b) m from reach group by a
)
select s.doc_id, len(s.s)::bigint n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) component_id from sets s left join least l on l.a = s.doc_id
"""

QUALITY = r"""
with t as (
  select doc_id, coalesce(text, '') text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents
), l as (
  select doc_id, count(*) - count(distinct line) n from (select doc_id, unnest(string_split(text, chr(10))) line from t) x where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id
), windows as (
  select doc_id, i, array_to_string(w[i:i + 2], ' ') x from (select doc_id, w, unnest(range(1, len(w) - 1)) i from t where len(w) >= 3) y
), twice as (
  select doc_id, x from windows group by doc_id, x having count(*) > 1
), covered as (
  select doc_id, count(*) n from (select distinct v.doc_id, v.i + k.k place from windows v join twice d on d.doc_id = v.doc_id and d.x = v.x cross join (select unnest(range(0, 3)) k) k) z group by doc_id
)
select t.doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint n_symbols,
  coalesce(l.n, 0)::bigint n_dup_lines, coalesce(c.n, 0)::bigint n_repeat_words, len(w) < 50 or 100 * coalesce(c.n, 0) > 50 * len(w) base_failed
from t left join l on l.doc_id = t.doc_id left join covered c on c.doc_id = t.doc_id
"""

SHARDS = """
select doc_id, coalesce(strlen(text), 0) + 16 size, count(*) copies from documents group by doc_id, text
"""
