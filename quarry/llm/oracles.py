"""SQL of the operators on trees and conversations: CRC-32 bit by bit, recursive levels and shortest paths."""

from __future__ import annotations


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text, low bit first, as an expression of lists."""
    bits = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: list_transform(range(0, 8), lambda j: (ascii(substring({text}, i, 1)) >> j::int) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda c, b: xor(c >> 1, 3988292384::bigint * (xor(c, b::bigint) & 1))), 4294967295::bigint)"


def _field(name: str) -> str:
    return f"coalesce(strlen({name}::varchar)::varchar || ':' || {name}::varchar, '-')"


def _leaf(n_chars: str = "n_chars") -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_KEY = "(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))"

MORE_SQL: dict[str, str] = {
    "op11_conversation_repair": rf"""
with recursive k as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text, {_crc32(_KEY)} % 20 kind from conversations),
d as (select conv_id, turn, case when kind = 4 then 'user' else role end role,
             case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end text
      from k, range(0, 2) c(n) where kind <> 0 and (n = 0 or kind = 3)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) i from d),
f as (select *, substring(role, 1, 1) initial,
             case when not regexp_matches(text, '[^ 	-]') then 1
                  when row_number() over (partition by conv_id, role, text order by i) > 1 then 2
                  when regexp_matches(text, '[^ 	-.!?][ 	-]*\z') then 3 else 0 end fault,
             lag(substring(role, 1, 1)) over (partition by conv_id order by i) || substring(role, 1, 1) pair from o),
c as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (fault = 1) blank,
             count(*) filter (fault = 2) duplicate, count(*) filter (fault = 3) truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal
      from f group by conv_id),
ins(p, q, more, ins) as (values (0, 0, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'), (1, 1, 0, ''), (1, 2, 2, 'I'), (1, 3, 4, 'II'),
                                (2, 2, 0, ''), (2, 3, 2, 'I'), (3, 3, 0, ''), (3, 2, 2, 'I')),
arc(p, q, edit, price, initial) as (values (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'), (3, 2, 'K', 0, 'u'),
     (0, 2, 'R', 2, null), (1, 2, 'R', 2, null), (2, 3, 'R', 2, null), (3, 2, 'R', 2, null),
     (0, 0, 'D', 3, null), (1, 1, 'D', 3, null), (2, 2, 'D', 3, null), (3, 3, 'D', 3, null)),
w as (select conv_id, 0::bigint i, 0 st, {{'c': 0::bigint, 'l': ''}} best from c
      union all
      select w.conv_id, f.i, arc.q, min({{'c': w.best.c + ins.more + arc.price + case when fault = 3 and edit <> 'D' then 1 else 0 end, 'l': w.best.l || ins.ins || edit}})
      from w join ins on ins.p = w.st join f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
      join arc on arc.p = ins.q and (arc.initial is null or arc.initial = f.initial) and (edit = 'D' or fault not in (1, 2))
      group by w.conv_id, f.i, arc.q),
z as (select c.conv_id, min({{'c': best.c + more, 'l': best.l || ins}}) best
      from c join w on w.conv_id is not distinct from c.conv_id and w.i = c.n join ins on ins.p = w.st where ins.q in (0, 3) group by c.conv_id),
x as (select conv_id, j, substring(best.l, j, 1) e, best.l from z, unnest(range(1, length(best.l) + 1)) t(j)),
y as (select *, sum(case when e <> 'I' then 1 else 0 end) over (partition by conv_id order by j) i,
             sum(case when e <> 'D' then 1 else 0 end) over (partition by conv_id order by j) pos,
             sum(case when e <> 'D' then 1 else 0 end) over (partition by conv_id) made from x),
t as (select y.conv_id, string_agg(case when e = 'K' then f.role when (pos + made) % 2 = 1 then 'user' else 'assistant' end || ':'
             || case when e = 'I' then '' else f.text end, chr(10) order by j) repaired
      from y left join f on f.conv_id is not distinct from y.conv_id and f.i = y.i where e <> 'D' group by y.conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(duplicate, 0)::bigint duplicate,
       coalesce(truncated, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal, coalesce(z.best.c, 0)::bigint cost,
       coalesce(z.best.l, '') audit, sha256(coalesce(repaired, '')) repaired_sha256
from (select distinct conv_id from conversations) a left join c on c.conv_id is not distinct from a.conv_id
left join z on z.conv_id is not distinct from a.conv_id left join t on t.conv_id is not distinct from a.conv_id""",
    "op12_merkle_manifest": f"""
with recursive d as (
  select row_number() over () rid, doc_id, lang, {_leaf()} leaf,
         case when {_crc32('doc_id::varchar')} % 7 = 0 then {_leaf('(n_chars + 1)')} else {_leaf()} end used from documents),
l as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, count(*) over (partition by lang) n from d),
t as (select 0 lvl, lang, pos, n, leaf h from l
      union all select lvl + 1, lang, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from t where n > 1 group by lvl, lang, pos // 2, n),
s as (select lang, h subroot, lvl height, row_number() over (order by lang nulls first) - 1 pos, count(*) over () n from t where n = 1),
r as (select 0 lvl, pos, n, subroot h from s
      union all select lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from r where n > 1 group by lvl, pos // 2, n),
top as (select h root, lvl height from r where n = 1),
p as (select rid, row_number() over (partition by rid order by far, lvl) k, low, h from (
      select rid, false far, g.lvl, (l.pos >> g.lvl::int) & 1 low, t.h
      from l join s on l.lang is not distinct from s.lang join range(0, 64) g(lvl) on g.lvl < s.height
      left join t on t.lang is not distinct from l.lang and t.lvl = g.lvl and t.pos = xor(l.pos >> g.lvl::int, 1)
      union all
      select rid, true far, g.lvl, (s.pos >> g.lvl::int) & 1 low, r.h
      from l join s on l.lang is not distinct from s.lang, top join range(0, 64) g(lvl) on g.lvl < top.height
      left join r on r.lvl = g.lvl and r.pos = xor(s.pos >> g.lvl::int, 1))),
q as (select rid, count(*) steps, string_agg(h, '' order by k) path from p group by rid),
w as (select rid, 0::bigint k, used h from d
      union all select w.rid, w.k + 1, case when p.h is null then sha256(w.h) when low = 1 then sha256(p.h || w.h) else sha256(w.h || p.h) end
      from w join p on p.rid = w.rid and p.k = w.k + 1)
select doc_id, leaf, subroot, root, sha256(coalesce(path, '')) proof_sha256, w.h folded_root, w.h = root verified
from l join s on l.lang is not distinct from s.lang, top left join q on q.rid = l.rid join w on w.rid = l.rid and w.k = coalesce(steps, 0)""",
}
