"""The queries of this package that SQL expresses, for DuckDB."""

from __future__ import annotations

from skyloom.llm.licenses import WORDINGS, rules

# A turn is a struct (role, text); all lists are in order of turns.
PREFERENCES = """
with conv as (
  select conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id
), placed as (
  select *, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') as spots from conv
), cut as (
  select conv_id, turns, case when len(spots) = 0 then len(turns) else spots[1 + (conv_id % len(spots) + len(spots)) % len(spots)] - 1 end as n_before from placed
), sides as (
  select conv_id, turns as chosen,
    list_concat(turns[1:n_before], coalesce(lead(turns[n_before + 1:]) over (partition by conv_id // 1000 order by conv_id),
      first_value(turns[n_before + 1:]) over (partition by conv_id // 1000 order by conv_id))) as rejected
  from cut
), compared as (
  select *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[1:i] = rejected[1:i])) as n from sides
), parts as (
  select conv_id, n,
    list_transform(chosen[1:n], lambda t: '<|' || t.role || '|>' || t.text || '<|end|>' || chr(10)) as prompt,
    list_transform(chosen[n + 1:], lambda t: '<|' || t.role || '|>' || t.text || '<|end|>' || chr(10)) as a, chosen[n + 1:] as ta,
    list_transform(rejected[n + 1:], lambda t: '<|' || t.role || '|>' || t.text || '<|end|>' || chr(10)) as b, rejected[n + 1:] as tb
  from compared
)
select conv_id as pair_id, cast(n as integer) as n_common, array_to_string(prompt, '') as prompt, array_to_string(a, '') as chosen, array_to_string(b, '') as rejected,
  array_to_string(list_transform(list_filter(range(1, len(a) + 1), lambda i: ta[i].role = 'assistant'),
    lambda i: (length(array_to_string(a[1:i - 1], '')) + 13) || '-' || length(array_to_string(a[1:i], ''))), ',') as chosen_spans,
  array_to_string(list_transform(list_filter(range(1, len(b) + 1), lambda i: tb[i].role = 'assistant'),
    lambda i: (length(array_to_string(b[1:i - 1], '')) + 13) || '-' || length(array_to_string(b[1:i], ''))), ',') as rejected_spans
from parts
"""

_VALUES = ", ".join(
    f"({r.id}, '{r.label}', {r.priority}, {r.score}::double, {str(r.base).lower()}, '{r.pattern}', {r.words})" for r in rules()
)
# the first word of each keyword of a wording stands in all of its sentences
_COMMON = "|".join(["identifier", "under", "terms", "licen", "cc by nc", *sorted({keyword.split()[0] for _, _, _, keyword, _ in WORDINGS})])
#: Every rule is tried in every text with one of the words that the rules have in common; keywords only spare work.
LICENSES = f"""
with rules(id, label, priority, score, base, pattern, n) as (values {_VALUES}),
lines as (
  select row_number() over () as row_no, doc_id,
    trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' ') as line
  from documents
), texts as (
  select *, case when line = '' then [] else string_split(line, ' ') end as words from lines
), tried as (
  select row_no, words, rules.* from (select * from texts where regexp_matches(line, '{_COMMON}')) join rules
    on regexp_matches(' ' || line || ' ', ' ' || pattern || ' ')
), starts as (
  select row_no, words, id, label, priority, score, base, pattern, n, unnest(range(len(words) - n + 1)) as pos from tried
), found as (
  select row_no, id, label, priority, score, base, pos, pos + n as stop from starts
  where regexp_full_match(array_to_string(words[pos + 1 : pos + n], ' '), pattern)
), judged as (
  select *, exists (
    select 1 from found e where e.row_no = d.row_no and e.priority >= d.priority and e.pos <= d.pos and e.stop >= d.stop
      and (e.pos < d.pos or e.stop > d.stop or e.priority > d.priority or e.id < d.id)
  ) as within from found d
)
select doc_id, cast(len(words) as bigint) as n_words, count(*) filter (base) as n_base,
  min(pos) filter (base) as first_word, max(pos) filter (base) as last_word,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base)), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list(distinct label) filter (base or not within)), ','), '') as labels,
  coalesce(max(score) filter (base or not within), 0.0::double) as score
from texts left join judged using (row_no) group by row_no, doc_id, words
"""

#: CRC-32 of the bytes of a text: a table of 256 remainders, then a step per byte.
_CRC_TABLE = """crc_table as materialized (
  select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as remainder
)"""


def _crc32(text: str) -> str:
    """SQL for the CRC-32 of a text column, where crc_table is joined."""
    digits = f"hex(encode({text}))"
    places = f"list_transform(range(0, len({digits})::bigint, 2), lambda i: ('0x' || {digits}[i + 1 : i + 2])::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {places}), lambda a, b: xor(a >> 8, remainder[(xor(a, b) & 255) + 1])), 4294967295::bigint)"


# Shares by rank of the cap: those before a row have reached theirs.
MIX = """
with texts as (
  select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    (('0x' || substr(md5('2024:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 12))::bigint + 0.5::double) / 281474976710656::double as u
  from documents
), sized as (
  select doc_id, coalesce('=' || source, '') as origin, source, size, length(bin(size)) as importance, u from texts
), sources as (
  select origin, source, sum(size)::bigint as source_size, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sized group by origin, source
), filled as (
  select *, 1.5::double * sum(source_size) over () as total, sum(weight) over () as weights,
    sum(2 * source_size) over w - 2 * source_size as caps_before, sum(weight) over w - weight as weights_before
  from sources window w as (order by 2 * source_size / weight::double, origin rows unbounded preceding)
), judged as (
  select *, (total - caps_before) * weight > (2 * source_size)::double * (weights - weights_before) as capped from filled
), targets as (
  select origin, source_size, case when capped then 2.0::double * source_size else
    weight * ((total - coalesce(sum(2 * source_size) filter (capped) over (), 0)) / (weights - coalesce(sum(weight) filter (capped) over (), 0))) end as target
  from judged
), classes as (
  select origin, importance, sum(size)::bigint as class_size from sized group by origin, importance
), class_filled as (
  select *, importance * class_size as weight, sum(importance * class_size) over (partition by origin) as weights,
    sum(2 * class_size) over w - 2 * class_size as caps_before, sum(importance * class_size) over w - importance * class_size as weights_before
  from classes join targets using (origin)
  window w as (partition by origin order by case when class_size > 0 then 2 * class_size / (importance * class_size)::double else 0 end, importance rows unbounded preceding)
), class_judged as (
  select *, weight <= 0 or (target - caps_before) * weight > (2 * class_size)::double * (weights - weights_before) as capped from class_filled
), chances as (
  select *, least(case when class_size = 0 then 0 when capped then 2.0 else
    weight * ((target - coalesce(sum(2 * class_size) filter (capped) over v, 0)) / (weights - coalesce(sum(weight) filter (capped) over v, 0))) / class_size end, 2.0::double) as copies
  from class_judged window v as (partition by origin)
), budgets as (
  select origin, max(floor(target + 0.5)) - sum(floor(copies) * class_size) as budget from chances group by origin
), keyed as (
  select s.*, c.source_size, c.target, floor(copies) as whole, copies - floor(copies) as p, b.budget,
    case when copies > floor(copies) then u * (1 - p) / (u * (1 - p) + (1 - u) * p) end as key
  from sized s join chances c using (origin, importance) join budgets b using (origin)
), units as (
  select origin, key, sum(size)::double as words, sum(sum(size)) over (partition by origin order by key rows unbounded preceding) as upto
  from keyed where key is not null and size > 0 group by origin, key
)
select doc_id, source, size, source_size, target, whole::bigint as whole, extra::bigint as extra, (whole * size + extra)::bigint as taken from (
  select k.*, case when key is null or size = 0 then 0 when upto <= budget then size when upto - words < budget then floor(size * (budget - upto + words) / words) else 0 end as extra
  from keyed k left join units using (origin, key)
)
"""

RESAMPLING = f"""
with {_CRC_TABLE}, texts as (
  select row_number() over () as row_no, doc_id, text, 0 as aim from documents union all select row_number() over (), null, text, 1 from benchmark
), words as (
  select row_no, doc_id, aim, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words from texts
), each_word as (
  select row_no, aim, unnest(words) as word from words
), vocabulary as (
  select word, {_crc32('word')} % 10000 as bucket from (select distinct word from each_word), crc_table
), placed as (
  select row_no, aim, bucket from each_word join vocabulary using (word)
), counts as (
  select bucket, count(*) filter (aim = 0)::double as s, count(*) filter (aim = 1)::double as t from placed group by bucket
), gains as (
  select bucket, floor(1000 * ln((t + 1) * (sum(s) over () + 10000) / ((s + 1) * (sum(t) over () + 10000))))::bigint as gain from counts
), weights as (
  select row_no, sum(gain)::bigint as weight from placed join gains using (bucket) where aim = 0 group by row_no
), scored as (
  select row_no, doc_id, len(words)::bigint as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from words left join weights using (row_no) where aim = 0
), ranked as (
  select row_no, row_number() over (order by score desc, doc_id nulls last, weight, n_features) as place, count(*) over () as n from scored where n_features >= 20
)
select doc_id, n_features, weight, score, case when place <= 10 * n // 100 then place end as rank from scored left join ranked using (row_no)
"""

PREFIXES = f"""
with {_CRC_TABLE}, own as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id
), grafts as (
  select conv_id, turns, conv_id - conv_id % 100 as head, {_crc32('conv_id::varchar')} % 6 as h from own, crc_table
), rebuilt as (
  select g.conv_id, list_concat(coalesce(f.turns[1:h], []), g.turns[h + 1:]) as turns from grafts g left join own f on f.conv_id = g.head
), prefixes as (
  select conv_id, turns, unnest(range(len(turns) + 1)) as depth from rebuilt
), nodes as (
  select turns[1:depth] as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(turns) = depth), '')) as ends_sha256
  from prefixes group by all
), children as (
  select path[1:depth - 1] as path, depth - 1 as depth, count(*) as n_children from nodes where depth > 0 group by all
), counted as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join children using (path, depth)
), lines as (
  select path, unnest(range(depth + 1)) as above, case when n_children = 0 then 1 else 0 end as leaf,
    case when depth = 0 then 0 else (n_convs - 1) * length(path[depth].text) end as saved from counted
), subtrees as (
  select path[1:above] as path, above as depth, sum(leaf) as n_leaves, sum(saved) as saved_tokens from lines group by all
)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves::bigint as n_leaves, saved_tokens::bigint as saved_tokens, c.ends_sha256
from counted c join subtrees using (path, depth) left join nodes p on p.depth = c.depth - 1 and p.path = c.path[1:c.depth - 1]
"""

ORACLES = {
    "op2_preference_format": PREFERENCES, "op10_license_scan": LICENSES, "op11_source_mix": MIX, "op12_target_resampling": RESAMPLING,
    "op13_prefix_trie": PREFIXES,
}
