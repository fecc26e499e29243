"""Damage and cheapest repair of ``conversations`` in DuckDB SQL: a recursion over rows that keeps the least (cost, edits) of each state."""

from signalops.llm.merkle_sql import CRC32, crc32

SQL = rf"""
with recursive {CRC32},
k as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
             {crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as k from conversations, crc_table),
dam as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
               case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
               unnest(case when k = 3 then [0, 1] else [0] end) as copy from k where k <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) - 1 as i from dam),
f as (select conv_id, turn, role, text, i, left(role, 1) as ini,
             case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b'
                  when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 't' else 'o' end as fault,
             lag(left(role, 1)) over (partition by conv_id order by i) as before from placed),
pre(q, q1, marks, turns, cost) as (values (0, 0, '', [], 0), (1, 1, '', [], 0), (2, 2, '', [], 0), (3, 3, '', [], 0),
    (0, 2, 'I', ['user:'], 5), (1, 2, 'I', ['user:'], 5), (3, 2, 'I', ['user:'], 5), (2, 3, 'I', ['assistant:'], 5),
    (0, 3, 'II', ['user:', 'assistant:'], 10), (1, 3, 'II', ['user:', 'assistant:'], 10)),
ops(q1, ini, op, q2, role) as (values (0, 's', 'K', 1, ''), (0, 'u', 'K', 2, ''), (1, 'u', 'K', 2, ''), (3, 'u', 'K', 2, ''), (2, 'a', 'K', 3, ''),
    (0, '*', 'R', 2, 'user'), (1, '*', 'R', 2, 'user'), (3, '*', 'R', 2, 'user'), (2, '*', 'R', 3, 'assistant'),
    (0, '*', 'D', 0, ''), (1, '*', 'D', 1, ''), (2, '*', 'D', 2, ''), (3, '*', 'D', 3, '')),
walk as (select distinct conv_id, 0 as i, 0 as q, struct_pack(c := 0, a := '', o := []::varchar[]) as b from f
    union all
    select w.conv_id, w.i + 1, ops.q2, min(struct_pack(
        c := w.b.c + pre.cost + case op when 'D' then 2 when 'R' then 1 else 0 end + case when op <> 'D' and fault = 't' then 5 else 0 end,
        a := w.b.a || pre.marks || op,
        o := list_concat(w.b.o, list_concat(pre.turns, case op when 'D' then []::varchar[] when 'R' then [ops.role || ':' || f.text] else [f.role || ':' || f.text] end))))
    from walk w join f on f.conv_id is not distinct from w.conv_id and f.i = w.i join pre on pre.q = w.q
         join ops on ops.q1 = pre.q1 and (ops.ini = '*' or ops.ini = f.ini) and (op = 'D' or fault in ('t', 'o'))
    group by w.conv_id, w.i + 1, ops.q2),
ends as (select conv_id, min(struct_pack(c := w.b.c + pre.cost, a := w.b.a || pre.marks, o := list_concat(w.b.o, pre.turns))) as b
         from walk w join pre using (q) join (select conv_id as cid, count(*) as n from f group by conv_id) m on m.cid is not distinct from w.conv_id and w.i = m.n
         where pre.q1 in (0, 3) group by conv_id),
stats as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'b') as blank,
                 count(*) filter (fault = 'd') as duplicate, count(*) filter (fault = 't') as truncated,
                 count(*) filter (i > 0 and before || ini not in ('su', 'ua', 'au')) as illegal from f group by conv_id)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(e.b.c, 0)::bigint as cost,
       coalesce(e.b.a, '') as audit, sha256(coalesce(array_to_string(e.b.o, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join stats s on s.conv_id is not distinct from c.conv_id
     left join ends e on e.conv_id is not distinct from c.conv_id"""
