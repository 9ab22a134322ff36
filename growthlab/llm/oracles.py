"""DuckDB statements that give the rows of the queries SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_line_runs"] = r"""
with split as (select doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as lines from documents),
line as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as place from split),
keyed as (select doc_id, place, line,
                 translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from line),
often as (select key, max(doc_id) as last_doc from keyed where length(key) >= 20
          group by key having count(distinct doc_id) >= 3),
marked as (select k.doc_id, k.place, k.line, o.key is not null and k.doc_id <> o.last_doc as gone
           from keyed k left join often o on k.key = o.key)
select doc_id, count(*) as n_lines, cast(sum(gone::int) as bigint) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
from marked group by doc_id
"""

ORACLES["op8_quality_rules"] = r"""
with base as (select doc_id, coalesce(text, '') as t from documents),
split as (select doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from base),
win as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from split where len(w) >= 3),
grams as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as g from win),
often as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from grams) where n >= 2),
covered as (select doc_id, count(distinct p) as n_repeat_words
            from (select doc_id, unnest([i, i + 1, i + 2]) as p from often) group by doc_id),
measured as (
  select s.doc_id, cast(len(w) as bigint) as n_words,
         cast(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols,
         cast(len(l) as bigint) as n_lines, cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words,
         length(regexp_replace(t, '[^A-Z]+', '', 'g')) as n_upper, length(regexp_replace(t, '[^a-z]+', '', 'g')) as n_lower
  from split s left join covered c on s.doc_id = c.doc_id),
failed as (select *, (n_words < 50)::int as f0, (100 * n_repeat_words > 50 * n_words)::int as f1,
                  (100 * n_symbols > 20 * n_words)::int as f2, (100 * n_dup_lines > 30 * n_lines)::int as f3,
                  (word_chars < 2 * n_words)::int as f4, (word_chars > 20 * n_words)::int as f5,
                  (n_upper > n_lower)::int as f6 from measured)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f0 + f1 > 0 as base_failed,
       f0 + f1 + f2 + f3 + f4 + f5 + f6 = 0 as kept,
       cast(f0 + 2 * f1 + 4 * f2 + 8 * f3 + 16 * f4 + 32 * f5 + 64 * f6 as bigint) as fail_bits
from failed
"""

ORACLES["op7_jaccard_tiles"] = r"""
with recursive words as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
         else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s from words),
shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (select a.doc_id as u, b.doc_id as v, any_value(a.n) as n, any_value(b.n) as m, count(*) as c
           from shingles a join shingles b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
links as (select u, v from common where 100 * c >= 80 * (n + m - c)),
reach(doc_id, other) as (select doc_id, doc_id from documents union select r.doc_id, l.v from reach r join links l on r.other = l.u),
least as (select doc_id, min(other) as component_id from reach group by doc_id)
select s.doc_id, cast(len(s) as bigint) as n_shingles, component_id from sets s join least l on s.doc_id = l.doc_id
"""

ORACLES["op1_phrase_dedup"] = r"""
with coded as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
sized as (select doc_id, x, cast(length(x) // 2 as bigint) as n from coded),
windows as (select doc_id, i, substr(x, 2 * i + 1, 100) as w from (select doc_id, x, unnest(range(n - 49)) as i from sized where n >= 50)),
gone as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by w) as f from windows) where f < doc_id),
bytes as (select doc_id, p, substr(x, 2 * p + 1, 2) as c from (select doc_id, x, unnest(range(n)) as p from sized)),
marked as (select b.doc_id, b.p, b.c,
                  max(g.i) over (partition by b.doc_id order by b.p rows unbounded preceding) >= b.p - 49 as hit
           from bytes b left join gone g on b.doc_id = g.doc_id and b.p = g.i),
edges as (select *, hit is true and lag(hit is true, 1, false) over (partition by doc_id order by p) = false as opens from marked),
summed as (select doc_id, cast(count(*) filter (where hit is true) as bigint) as n_removed,
                  cast(count(*) filter (where opens) as bigint) as n_spans,
                  coalesce(string_agg(c, '' order by p) filter (where hit is not true), '') as kept from edges group by doc_id)
select s.doc_id, s.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
       sha256(unhex(coalesce(kept, ''))) as kept_sha256 from sized s left join summed u on s.doc_id = u.doc_id
"""

ORACLES["op11_collocations"] = r"""
with piece as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents),
words as (select lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda x: x <> '') as w from piece),
sizes as (select lang, cast(sum(len(w)) as bigint) as n from words group by lang),
grams as (select lang, k, w[i:i + k - 1] as g
          from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (values (1), (2), (3), (4)) as s(k) where len(w) >= k)),
counts as (select lang, k, g, count(*) as f from grams group by all),
cand as (select * from counts where k > 1 and f >= 30),
inner_of as (select lang, g[i:i + j - 1] as g, f from (select lang, g, f, j, unnest(range(1, k - j + 2)) as i from cand, (values (2), (3)) as s(j) where j < k)),
cover as (select lang, g, max(f) as around from inner_of group by all),
kept as (select c.* from cand c left join cover o on c.lang = o.lang and c.g = o.g
         where o.around is null or 100::hugeint * o.around < 80::hugeint * c.f),
cuts as (select c.lang, c.g, c.k, c.f as a, j, x.f as l, y.f as r, cast((2000000::hugeint * c.f) // (x.f + y.f) as bigint) as score
         from (select *, unnest(range(1, k)) as j from kept) c join counts x on x.lang = c.lang and x.g = c.g[1:j]
         join counts y on y.lang = c.lang and y.g = c.g[j + 1:c.k]),
lowest as (select * from cuts qualify row_number() over (partition by lang, g order by score, j) = 1),
ranked as (select lang, array_to_string(g, ' ') as phrase, a, l, r, score,
                  row_number() over (partition by lang order by score desc, a desc, array_to_string(g, ' ')) as rank from lowest)
select ranked.lang, rank, phrase, a, l, r, n, score from ranked join sizes using (lang) where rank <= 2000
"""
