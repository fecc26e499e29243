"""The k-d tree shards of ``documents`` in DuckDB SQL."""

from signalops.llm.merkle_sql import CRC32

SHARDS, SCALE = 8, 1 << 28


def _coordinate(c: str) -> str:
    return f"coalesce(('0x' || substr(md5({c}), 1, 7))::bigint, 0)"


def _depth(i: int) -> str:
    return f"""
n{i} as (select shard, k, sum(w) as total, max(x_source) - min(x_source) as ds, max(x_lang) - min(x_lang) as dl, max(x_size) - min(x_size) as dz
      from u{i} group by shard, k),
o{i} as (select u.*, total, case greatest(ds, dl, dz) when ds then x_source when dl then x_lang else x_size end as v from u{i} u join n{i} using (shard, k)),
b{i} as (select *, sum(w) over (partition by shard order by v, h, part) - w as before, (k + 1) // 2 as half from o{i}),
u{i + 1} as (select h, part, w, x_source, x_lang, x_size, case when (2 * before + w) * k < 2 * total * half then shard else shard + half end as shard,
      case when (2 * before + w) * k < 2 * total * half then half else greatest(k - half, 1) end as k from b{i})"""


SQL = f"""
with {CRC32},
bytes as (select doc_id, coalesce(text, '') as t, strlen(coalesce(text, '')) + 1 as size, md5(coalesce(text, '')) as h, source, lang from documents),
d as (select doc_id, size, h, source, lang,
             xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::bigint)),
                             lambda a, b: xor(a >> 8, crc_tbl[(xor(a, b) & 255) + 1])), 4294967295) as crc from bytes, crc_table),
g as (select h, sum(size) as w, count(*) as n, {_coordinate('min(source)')} as x_source, {_coordinate('min(lang)')} as x_lang, min(size) as size from d group by h),
lim as (select min(size) as lo, max(size) as hi, greatest(1, floor(sum(w)::double * 0.01::double / {SHARDS}))::bigint as limit_w from g),
g2 as (select h, w, n, x_source, x_lang, (size - lo) * {SCALE} // (hi - lo + 1) as x_size,
              case when w > limit_w and n > 1 then least(n, ceil(w / limit_w)::bigint) else 1 end as parts,
              w > limit_w and n > 1 as big from g, lim),
p as (select d.doc_id, d.size, d.crc, d.h, case when big then (row_number() over (partition by d.h order by d.doc_id) - 1) * parts // n else 0 end as part
      from d join g2 using (h)),
u0 as (select h, part, sum(p.size) as w, any_value(x_source) as x_source, any_value(x_lang) as x_lang, any_value(x_size) as x_size, 0 as shard, {SHARDS} as k
       from p join g2 using (h) group by h, part),
{_depth(0)},
{_depth(1)},
{_depth(2)}
select doc_id, p.size::bigint as size, crc as text_crc32, 'bytes' as law, shard::int as shard,
       row_number() over (partition by shard order by doc_id) - 1 as slot, null::int as grown_shard
from p join u3 using (h, part)"""
