"""The Merkle manifest of ``documents`` in DuckDB SQL."""

CRC32 = r"""
crc_table as (select list_transform(range(256), lambda i: list_reduce([i, 1, 1, 1, 1, 1, 1, 1, 1],
        lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as crc_tbl)"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII expression that is not null; needs crc_table in the from clause."""
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length({text}) + 1), lambda i: ascii(({text})[i])::bigint)), "
            "lambda a, b: xor(a >> 8, crc_tbl[(xor(a, b) & 255) + 1])), 4294967295)")


def _field(c: str) -> str:
    return f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


SQL = f"""
with recursive {CRC32},
d as (select doc_id, coalesce('=' || lang, '') as g, {_leaf('n_chars')} as leaf,
             case when {crc32("coalesce(doc_id::varchar, 'x')")} % 7 = 0 and doc_id is not null then {_leaf('n_chars + 1')} end as changed
      from documents, crc_table),
placed as (select *, row_number() over (partition by g order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by g) as n from d),
low as (select g, 0 as level, pos, leaf as node, n from placed
        union all
        select g, level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2 from low where n > 1 group by g, level, pos // 2),
subs as (select g, node as subroot, row_number() over (order by encode(g)) - 1 as pos, count(*) over () as n from low where n = 1),
high as (select 0 as level, pos, subroot as node, n from subs
         union all
         select level + 1, pos // 2, sha256(string_agg(node, '' order by pos)), (max(n) + 1) // 2 from high where n > 1 group by level, pos // 2),
low_steps as (select p.g, p.pos, i.level, case when p.pos >> i.level & 1 = 1 then 'l' else 'r' end as side, s.node
              from placed p join (select distinct g, level from low where n > 1) i using (g)
              left join low s on s.g = p.g and s.level = i.level and s.pos = xor(p.pos >> i.level, 1)),
high_steps as (select p.g, i.level, case when p.pos >> i.level & 1 = 1 then 'l' else 'r' end as side, s.node
               from subs p join (select distinct level from high where n > 1) i on true
               left join high s on s.level = i.level and s.pos = xor(p.pos >> i.level, 1)),
low_path as (select g, pos, list(side || coalesce(node, '') order by level) as path from low_steps group by g, pos),
high_path as (select g, list(side || coalesce(node, '') order by level) as path from high_steps group by g),
paths as (select p.doc_id, p.leaf, p.changed, s.subroot, list_concat(coalesce(l.path, []), coalesce(h.path, [])) as path
          from placed p join subs s using (g) left join low_path l on l.g = p.g and l.pos = p.pos left join high_path h on h.g = p.g),
done as (select doc_id, leaf, subroot, (select node from high where n = 1) as root,
                sha256(coalesce(list_aggregate(list_transform(path, lambda x: substr(x, 2)), 'string_agg', ''), '')) as proof_sha256,
                list_reduce(list_prepend(coalesce(changed, leaf), path),
                            lambda a, x: case when x[1] = 'l' then sha256(substr(x, 2) || a) else sha256(a || substr(x, 2)) end) as folded_root
         from paths)
select *, folded_root = root as verified from done"""
