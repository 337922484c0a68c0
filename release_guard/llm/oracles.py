"""The results of some operators of this subpackage in SQL, as DuckDB runs it on the given tables."""

from __future__ import annotations

SOURCE_DIVERGENCE = r"""
with docs as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents
), words as (
  select lang, source, row,
    translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as term
  from docs
), kept as (
  select lang, term from words group by lang, term having count(distinct row) >= 30
), counts as (
  select lang, source, term, count(*) as n from words join kept using (lang, term) group by all
), sizes as (
  select lang, count(*) as v from kept group by lang
), grid as (
  select lang, source, term, coalesce(n, 0)::hugeint as n
  from (select distinct lang, source from docs) join kept using (lang) left join counts using (lang, source, term)
), shares as (
  select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang, source) + 5 * v) as p
  from grid join sizes using (lang)
), typical as (
  select lang, term, 1 + (1000000000::hugeint * (n + 5)) // (sum(n) over (partition by lang) + 5 * v) as q
  from (select lang, term, sum(n) as n from grid group by all) join sizes using (lang)
), pairs as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum(abs(x.p - y.p)), 0) as value
  from (select distinct lang, source from docs) a join (select distinct lang, source from docs) b on a.lang = b.lang and a.source <> b.source
  left join shares x on x.lang = a.lang and x.source = a.source
  left join shares y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by all
), terms as (
  select lang, source, 'term' as part, term as item, p - q as value from shares join typical using (lang, term) where n > 0 and p > q
), ranked as (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
  from (select * from pairs union all select * from terms)
)
select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= 50
"""

# SQL has no crc32: the checksum folds the characters of an ASCII string, eight shifts for each.
CONVERSATION_REPAIR = r"""
with recursive named as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations
), summed as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(range(1, strlen(name) + 1), lambda i: ascii(name[i])::bigint),
    lambda sum, byte: list_reduce([xor(sum, byte)] || range(0, 8),
      lambda part, step: xor(part >> 1, case when part & 1 = 1 then 3988292384::bigint else 0 end))), 4294967295::bigint) % 20 as kind
  from named
), convs as (
  select row_number() over () as conv, conv_id from (select distinct conv_id from conversations)
), damaged as (
  select conv, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from summed join convs on summed.conv_id is not distinct from convs.conv_id, range(0, 2) copies(copy)
  where kind <> 0 and (copy = 0 or kind = 3)
), placed as (
  select *, row_number() over (partition by conv order by turn nulls first, role, text, copy) as i
  from (select *, row_number() over (partition by conv, role, text order by turn nulls first) as copy from damaged)
), faulty as (
  select *, left(role, 1) as initial, case
    when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank'
    when copy > 1 then 'duplicate'
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault
  from placed
), pairs as (
  select *, lag(initial) over (partition by conv order by i) || initial as pair from faulty
), counts as (
  select conv, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (fault = 'blank') as blank,
    count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
    count(*) filter (pair not in ('su', 'ua', 'au')) as illegal, max(i) as n
  from pairs group by conv
), moves(state, letters, added, middle) as (
  values (0, '', null, 0), (1, '', null, 1), (2, '', null, 2), (3, '', null, 3),
    (0, 'I', 'user:', 2), (1, 'I', 'user:', 2), (3, 'I', 'user:', 2), (2, 'I', 'assistant:', 3),
    (0, 'II', 'user:' || chr(10) || 'assistant:', 3), (1, 'II', 'user:' || chr(10) || 'assistant:', 3)
), edits(edit, middle, own, target, given) as (
  values ('D', 0, null, 0, null), ('D', 1, null, 1, null), ('D', 2, null, 2, null), ('D', 3, null, 3, null),
    ('K', 0, 's', 1, null), ('K', 0, 'u', 2, null), ('K', 1, 'u', 2, null), ('K', 3, 'u', 2, null), ('K', 2, 'a', 3, null),
    ('R', 0, null, 2, 'user'), ('R', 1, null, 2, 'user'), ('R', 3, null, 2, 'user'), ('R', 2, null, 3, 'assistant')
), fold as (
  select conv, 0::bigint as i, 0 as state, 0::bigint as cost, '' as audit, null::varchar as lines from convs
  union all
  select conv, i, state, cost, audit, lines from (
    select *, row_number() over (partition by conv, state order by cost, audit) as best from (
      select f.conv, r.i, e.target as state, f.audit || m.letters || e.edit as audit,
        f.cost + 3 * strlen(m.letters) + case e.edit when 'D' then 4 when 'R' then 3 else 0 end
          + case when e.edit <> 'D' and r.fault = 'truncated' then 3 else 0 end as cost,
        nullif(concat_ws(chr(10), f.lines, m.added, case when e.edit <> 'D' then coalesce(e.given, r.role) || ':' || r.text end), '') as lines
      from fold f join faulty r on r.conv = f.conv and r.i = f.i + 1 join moves m on m.state = f.state
      join edits e on e.middle = m.middle and coalesce(e.own = r.initial, true) and (e.edit = 'D' or r.fault not in ('blank', 'duplicate'))
    )
  ) where best = 1
), ends as (
  select conv, f.cost + 3 * strlen(m.letters) as cost, f.audit || m.letters as audit, concat_ws(chr(10), f.lines, m.added) as lines
  from fold f join moves m on m.state = f.state and m.middle in (0, 3) join convs using (conv) left join counts using (conv)
  where f.i = coalesce(n, 0)
)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, cost::bigint as cost, audit,
  sha256(coalesce(lines, '')) as repaired_sha256
from convs left join counts using (conv)
join (select *, row_number() over (partition by conv order by cost, audit) as best from ends) using (conv) where best = 1
"""

TOP_K = """
with vectors as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from vectors q join vectors c on c.vec_id <> q.vec_id where q.vec_id % 50 = 0
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 5
"""

JACCARD_COMPONENTS = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s
  from words
), shingles as (
  select doc_id, len(s) as n, unnest(s) as shingle from sets
), links as (
  select a.doc_id as a, b.doc_id as b from shingles a join shingles b on a.shingle = b.shingle and a.doc_id <> b.doc_id
  and 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached as (
  select doc_id, doc_id as other from sets union select r.doc_id, l.b from reached r join links l on r.other = l.a
)
select s.doc_id, len(s.s)::bigint as n_shingles, c.component_id
from sets s join (select doc_id, min(other) as component_id from reached group by doc_id) c using (doc_id)
"""
