"""Secret scans over an incremental blob ledger, in SQL functions only.

Every text is a blob, addressed by its SHA-256. The ledger is a table of (blob, rule, version, spans) in the
shared folder. A scan computes the addresses of all rows, takes the (blob, rule-version) pairs that
the ledger lacks, runs just those rules over one text of each such blob, appends the findings, and
joins the ledger back to every path (row) that holds the blob. A second scan of the same history reads no
text patterns at all; a new rule version rescans blobs for that rule only.

Spans are leftmost non-overlapping matches for each rule. The first three rules are the base rules of the
result contract; the others add spans for well-known token formats.

Defined cases: null and empty texts are the blob of the empty text and have no spans; repeated rows and copies share
a blob; null ids are paths like any other; an empty table adds nothing; further columns are ignored. Appends are committed
by Spark's writer under a name of their own, so a lost scan leaves no partial rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from signalops.functions.lineage import cut, shared_folder
from signalops.llm import spans
from signalops.llm.text import text_or_empty

# Fixed values: (kind, version, pattern, condition on the match). Kinds are in the order of the contract.
RULES: tuple[tuple[str, int, str], ...] = (
    ("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", 1, r"AKIA[A-Z0-9]+"),
    ("hex", 1, r"[0-9a-f]{24,}"),
    ("key_block", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    ("vcs_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    ("chat_token", 1, r"xox[abprs]-[A-Za-z0-9-]{20,}"),
    ("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = ("assign", "access", "hex")
LEDGER = "blob string, rule string, version int, spans array<struct<start:int,stop:int>>"


def _holds(kind: str, pattern: str, m: Column) -> Column:
    if kind == "assign":
        return F.length(F.regexp_extract(m, pattern, 1)) >= 6
    if kind == "access":
        return F.length(m) >= 20
    return F.lit(True)


def matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans of one rule: array of (start, stop); matches that fail the rule's condition are dropped."""
    hits = F.filter(spans.found(text, pattern), lambda x: _holds(kind, pattern, x["match"]))
    return F.transform(hits, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop")))


def addresses(docs: DataFrame) -> DataFrame:
    """(doc_id, blob) of every row."""
    return docs.select("doc_id", F.sha2(text_or_empty().cast("binary"), 256).alias("blob"))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger so far; an unused path is an empty ledger."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(path)


def scan(docs: DataFrame, ledger: str, rules=RULES) -> DataFrame:
    """Scan what the ledger at path ``ledger`` lacks, append it, and return (doc_id, blob) with ``findings``.

    ``findings``: array of (kind, start, stop) of the row's blob under the given rule versions.
    """
    spark = docs.sparkSession
    where = cut(addresses(docs))
    seen = read_ledger(spark, ledger)
    done = seen.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("done"))
    wanted = F.array(*[F.lit(f"{k}:{v}") for k, v, _ in rules])
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    pending = (where.groupBy("blob").agg(F.min(key).alias("__key")).join(done, "blob", "left")
               .withColumn("todo", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))))
               .where(F.size("todo") > 0).select("blob", "__key", "todo"))
    pending = cut(pending)
    if not pending.isEmpty():
        # One text of each pending blob: the narrow side is the hash table, texts stream past unsorted.
        texts = docs.select(key.alias("__key"), text_or_empty().alias("text")).withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
        one = texts.join(pending.hint("shuffle_hash"), ["blob", "__key"])
        none = F.array().cast("array<struct<start:int,stop:int>>")
        rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(v).alias("version"),
                                  F.when(F.array_contains("todo", f"{k}:{v}"), matches(F.col("text"), k, p)).otherwise(none).alias("spans"),
                                  F.array_contains("todo", f"{k}:{v}").alias("ran")) for k, v, p in rules])
        (one.select("blob", F.explode(rows).alias("r")).where("r.ran").select("blob", "r.rule", "r.version", "r.spans")
         .dropDuplicates(["blob", "rule", "version"]).write.parquet(f"{ledger}/{uuid.uuid4().hex}"))
    current = " or ".join(f"(rule = '{k}' and version = {v})" for k, v, _ in rules)
    hits = (read_ledger(spark, ledger).where(current).where(F.size("spans") > 0)
            .select("blob", F.transform("spans", lambda s: F.struct(F.col("rule").alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("f"))
            .groupBy("blob").agg(F.flatten(F.collect_list("f")).alias("findings")))
    return where.join(cut(hits), "blob", "left").select("doc_id", "blob", F.coalesce("findings", F.array().cast(
        "array<struct<kind:string,start:int,stop:int>>")).alias("findings"))


def report(docs: DataFrame, ledger: str | None = None, rules=RULES) -> DataFrame:
    """Counts of the base rules, the hash of their spans, and all spans, for every document."""
    ledger = ledger or f"{shared_folder(docs.sparkSession)}/signalops/ledger-{uuid.uuid4().hex}"
    names = F.array(*[F.lit(k) for k, _, _ in rules])
    ordered = lambda items: F.transform(F.sort_array(F.transform(items, lambda x: F.struct(
        x["start"].alias("start"), F.array_position(names, x["kind"]).alias("o"), x["stop"].alias("stop"), x["kind"].alias("kind")))),
        lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop")))
    s = scan(docs, ledger, rules).withColumn("findings", ordered(F.col("findings")))
    base = F.filter("findings", lambda x: x["kind"].isin(*BASE))
    n = lambda k: F.size(F.filter("findings", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return s.select("doc_id", *[n(k) for k in BASE], F.sha2(spans.joined(base).cast("binary"), 256).alias("base_sha256"),
                    spans.joined(F.col("findings")).alias("spans"), "blob")
