"""The registered queries of the training-data operators, with SQL where it can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from signalops.llm import (cotrain, kdtree, kdtree_sql, langid, merkle, merkle_sql, mixing, pii, quality_rules, repair, repair_sql, secret_ledger,
                           simhash, tiling, tokens, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


QUALITY_SQL = r"""
with d as (select doc_id, coalesce(source, '') as host, coalesce(text, '') as text from documents),
w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') as w from d),
tri as (select doc_id, unnest(range(0, greatest(len(w) - 2, 0))) as p, w from w),
tri2 as (select doc_id, p, count(*) over (partition by doc_id, w[p + 1], w[p + 2], w[p + 3]) as c from tri),
rep as (select doc_id, count(distinct q) as n_repeat_words
        from (select doc_id, unnest([p, p + 1, p + 2]) as q from tri2 where c > 1) group by doc_id),
raw as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
dup as (select doc_id, count(*) - count(distinct line) as n_dup_lines from raw
        where regexp_matches(line, '[^ \t\x0B\f\r]') group by doc_id),
norm as (select doc_id, host, trim(unnest(string_split(regexp_replace(lower(text), '[ \t\x0B\f\r]+', ' ', 'g'), chr(10)))) as line from d),
norm2 as (select *, len(string_split(line, ' ')) as words from norm where line <> ''),
freq as (select host, line, min(doc_id) as first from norm2 group by host, line having count(distinct doc_id) > 20),
gone as (select n.doc_id, sum(words) as removed, count(*) as n_lines from norm2 n join freq f
         on n.host = f.host and n.line = f.line and n.doc_id <> f.first group by n.doc_id),
b as (select w.doc_id, len(w.w) as n_words, length(array_to_string(w.w, '')) as word_chars,
      length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
      coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
      coalesce(removed, 0) as removed, coalesce(n_lines, 0) as n_lines
      from w left join dup using (doc_id) left join rep using (doc_id) left join gone using (doc_id)),
v as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from b)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
       not base_failed and n_words - removed >= 50 and n_words - removed >= 0.5 * n_words as kept,
       n_lines::bigint as n_removed_lines, removed::bigint as n_removed_words
from v"""


@query("op2_line_frequency", QUALITY_SQL)
def op2(spark, sf_dir):
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query("op3_covering_simhash")
def op3(spark, sf_dir):
    return simhash.report(table(spark, sf_dir, "documents"))


@query("op4_range_coded_tokens")
def op4(spark, sf_dir):
    return tokens.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op6_raked_mixture")
def op6(spark, sf_dir):
    return mixing.report(table(spark, sf_dir, "documents"))


@query("op7_string_tiling")
def op7(spark, sf_dir):
    return tiling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op1_centroid_langid")
def op1(spark, sf_dir):
    return langid.report(table(spark, sf_dir, "documents"))


@query("op10_counterfactual_toxicity")
def op10(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_cotrained_quality")
def op8(spark, sf_dir):
    return cotrain.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_boosted_pii")
def op5(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


@query("op9_blob_ledger_secrets")
def op9(spark, sf_dir):
    return secret_ledger.report(table(spark, sf_dir, "documents"))


@query("op11_merkle_manifest", merkle_sql.SQL)
def op11(spark, sf_dir):
    return merkle.report(table(spark, sf_dir, "documents"))


@query("op12_auction_repair", repair_sql.SQL)
def op12(spark, sf_dir):
    return repair.report(table(spark, sf_dir, "conversations"))


@query("op13_kd_tree_shards", kdtree_sql.SQL)
def op13(spark, sf_dir):
    return kdtree.report(table(spark, sf_dir, "documents"))
