"""DuckDB SQL for the results of the training-data queries that SQL can express."""

from __future__ import annotations

#: CRC-32 of a short ASCII text: a table of 256 entries from the polynomial, then one look-up a byte.
_CRC = """crc_rows(i, k, v) as (select i, 0, i from (select unnest(range(256)) i)
  union all select i, k + 1, xor(v >> 1, 3988292384 * (v & 1)) from crc_rows where k < 8),
crc_table as (select list(v order by i) t from crc_rows where k = 8)"""


def _crc(text: str) -> str:
    letters = f"list_transform(string_split({text}, ''), lambda x: ord(x)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {letters}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


def _more(state: str, cost: str, letter: str) -> str:
    """A path (nine digits of cost, then its edits) with one more edit; paths compare as text."""
    return f"(lpad((left({state}, 9)::bigint + {cost})::varchar, 9, '0') || substr({state}, 10) || '{letter}')"


def _inserts(s: str, u: str, a: str, z: str) -> tuple[str, str]:
    """The paths behind u and behind a when rows may be inserted."""
    two = f"least({u}, {_more(z, '5', 'I')}, {_more(s, '5', 'I')}, {_more(a, '5', 'I')})"
    return two, f"least({a}, {_more(u, '5', 'I')}, {_more(_more(z, '5', 'I'), '5', 'I')}, {_more(_more(s, '5', 'I'), '5', 'I')})"


def _step() -> str:
    keep = lambda state, initial: f"case when not gone and initial = '{initial}' then {_more(state, 'cut', 'K')} end"
    role = lambda state: f"case when not gone then {_more(state, 'cut + 1', 'R')} end"
    gone = lambda state: _more(state, "2", "D")
    to_u = ", ".join(x for s in "zsa" for x in (keep(s, "u"), role(s)))
    return (f"{gone('z')} z, least({gone('s')}, {keep('z', 's')}) s, least({gone('u')}, {to_u}) u, "
            f"least({gone('a')}, {keep('u', 'a')}, {role('u')}) a")


_TWO, _THREE = _inserts("s", "u", "a", "z")
REPAIR = f"""with recursive {_CRC},
noted as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt,
  {_crc("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 how from conversations, crc_table),
damaged as (select conv_id, turn, case when how = 4 then 'user' else role end role,
  case when how = 1 then '' when how = 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt,
  unnest(range(case when how = 3 then 2 else 1 end)) twice from noted where how <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(txt), twice) k,
  left(role, 1) initial, not regexp_matches(txt, '[^\\x20\\x09-\\x0D]') blank,
  regexp_extract(txt, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) ending from damaged),
seen as (select *, row_number() over (partition by conv_id, role, txt order by k) > 1 again,
  lag(initial) over (partition by conv_id order by k) before from placed),
faults as (select *, blank or again gone, case when blank or again or ending in ('.', '!', '?') then 0 else 5 end cut from seen),
sums as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, (count(*) filter (blank))::bigint blank,
  (count(*) filter (again and not blank))::bigint duplicate, (count(*) filter (cut > 0))::bigint truncated,
  (count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')))::bigint illegal, count(*) n from faults group by 1),
moves(conv_id, k, z, s, u, a) as (
  select conv_id, 0::bigint, '000000000', null::varchar, '000000005I', '000000010II' from sums
  union all select conv_id, k, z, s, {_TWO}, {_THREE} from (
    select m.conv_id, f.k, {_step()} from moves m join faults f on f.conv_id is not distinct from m.conv_id and f.k = m.k + 1)),
best as (select m.conv_id, least(z, a) path from moves m join sums t on t.conv_id is not distinct from m.conv_id and t.n = m.k),
letters as (select conv_id, substr(path, 10) audit, generate_subscripts(string_split(substr(path, 10), ''), 1) j from best where length(path) > 9),
edits as (select conv_id, j, substr(audit, j, 1) e, count(*) filter (substr(audit, j, 1) <> 'I') over w k,
  count(*) filter (substr(audit, j, 1) <> 'D') over w o from letters window w as (partition by conv_id order by j)),
kept as (select e.conv_id, e.j, e.e, e.o, f.role, f.initial, case when e.e = 'I' then '' else f.txt end txt
  from edits e left join faults f on f.conv_id is not distinct from e.conv_id and f.k = e.k and e.e <> 'I' where e.e <> 'D'),
system as (select *, coalesce(max(case when o = 1 and e = 'K' and initial = 's' then 1 end) over (partition by conv_id), 0) sys from kept),
texts as (select conv_id, string_agg(case when e = 'K' then role when (o - sys) % 2 = 1 then 'user' else 'assistant' end || ':' || txt, chr(10) order by j) body
  from system group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
  coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(left(path, 9)::bigint, 0)::bigint cost,
  coalesce(substr(path, 10), '') audit, sha256(coalesce(body, '')) repaired_sha256
from (select distinct conv_id from conversations) c left join sums s on s.conv_id is not distinct from c.conv_id
left join best b on b.conv_id is not distinct from c.conv_id left join texts x on x.conv_id is not distinct from c.conv_id"""

PHRASES = """with pieces as (select coalesce(lang, 'und') lang,
  unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) p from documents),
lists as (select lang, regexp_extract_all(p, '[^\\x20\\x09]+') w from pieces),
runs as (select lang, w, k, unnest(range(1, len(w) - k + 2)) i from lists, (select unnest(range(1, 6)) k) where len(w) >= k),
counted as (select lang, k, array_to_string(w[i:i + k - 1], ' ') phrase, count(*) c from runs group by 1, 2, 3),
sizes as (select lang, sum(c)::hugeint n from counted where k = 1 group by 1),
found as (select *, string_split(phrase, ' ') w from counted where c >= 100),
places as (select lang, c, w, k, unnest(range(1, k + 1)) i from found where k >= 3),
subs as (select lang, c, array_to_string(w[i:i + m - 1], ' ') phrase from (select *, unnest(range(2, k)) m from places) where i + m - 1 <= k),
covered as (select lang, phrase, max(c) longer from subs group by 1, 2),
free as (select f.* from found f left join covered v using (lang, phrase) where k >= 2 and (longer is null or 100 * longer < 100 * c)),
cuts as (select lang, phrase, c a, w, unnest(range(1, k)) j from free),
halves as (select lang, phrase, a, j, array_to_string(w[:j], ' ') x, array_to_string(w[j + 1:], ' ') y from cuts),
valued as (select h.*, f.c l, g.c r, n, (1000::hugeint * a * n) // (f.c::hugeint * g.c) score from halves h
  join found f on f.lang = h.lang and f.phrase = x join found g on g.lang = h.lang and g.phrase = y join sizes s on s.lang = h.lang),
lowest as (select * from valued qualify row_number() over (partition by lang, phrase order by score, j) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) rank from lowest)
select lang, rank::bigint rank, phrase, a::bigint a, l::bigint l, r::bigint r, n::bigint n, score::bigint score from ranked where rank <= 2000"""

COPIES = """with recursive v as (select vec_id, label, embedding::double[] e from embeddings),
fine as (select *, list_sum(list_transform(e, lambda x: x * x)) sq from v where label is not null and e is not null
  and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0),
links as (select a.vec_id a, b.vec_id b from fine a join fine b on a.label = b.label and a.vec_id <> b.vec_id
  where a.sq > 0 and b.sq > 0 and list_dot_product(a.e, b.e) / sqrt(a.sq) / sqrt(b.sq) >= 0.98),
reach(id, root) as (select vec_id, vec_id from embeddings union select b, root from reach join links on a = id),
roots as (select id, min(root) root from reach group by 1),
counted as (select a, count(*) n from links group by 1)
select id vec_id, coalesce(n, 0)::bigint n_links, root::bigint component_id, id = root kept from roots left join counted on a = id"""

ORACLES: dict[str, str] = {"op9_nn_descent": COPIES, "op11_dynamic_counting": PHRASES, "op12_block_repair": REPAIR}
