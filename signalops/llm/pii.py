"""Personal data: candidate spans scored by gradient-boosted trees, in DataFrame functions only.

High-recall generators propose spans that may overlap: the base patterns before their checks, and looser
ones (spelt-out e-mail addresses, national telephone numbers, card numbers with other separators,
colon-separated network addresses). A candidate is described by format features (digits, separators, groups, length, check digit,
largest number) and context features (cue words before it, the characters on either side). All are small integers, so the
corpus's candidates reduce to a table of distinct descriptions with counts. The trees are fitted on the
descriptions of base candidates, labelled by whether the base checks hold, weighted by their counts; they never see the
generator, so they carry over to candidates of the looser ones. For each kind the lowest score with a precision
of ``PRECISION`` among labelled descriptions is the threshold. Selected spans that overlap no base span are added; base spans stay.

Defined cases: null and empty texts have no spans; copies of a text share their spans and are counted in
the fit; if either label is missing nothing is added; of overlapping added spans the one with the higher score, then the earlier
start, stays; repeated rows each get a row; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from signalops.functions.lineage import cut
from signalops.llm import spans
from signalops.llm.text import packed, text_or_empty

KINDS = ("email", "ip", "card", "phone")
PRECISION, TREES, DEPTH = 0.95, 12, 4
# Generators (kind, is base, pattern). Base patterns are those of the contract.
GENERATORS = (
    ("email", True, r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"[0-9](?:[\x20-]?[0-9])++"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, r"[A-Za-z0-9._%+-]++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(](?i:dot)[\])])\x20?[A-Za-z0-9-]++)++"),
    ("ip", False, r"(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}"),
    ("card", False, r"[0-9]{4}(?:[./_][0-9]{4}){2}[./_][0-9]{1,7}"),
    ("phone", False, r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"),
)
NEEDS = {"email": r"@|(?i)[\[(]at[\])]"}  # a text without this has no candidate of the kind
FEATURES = ("kind_no", "digits", "groups", "marks", "size", "letters", "check", "largest", "cue", "left", "right")


def digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether a text of digits passes the check-digit sum."""
    odd = lambda v: F.when(v > 4, v * 2 - 9).otherwise(v * 2)
    value = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, odd(value(i))).otherwise(value(i)))
    return (F.length(d) > 0) & (total % 10 == 0)


def parts_fit(m: Column) -> Column:
    """Every dotted part is at most 255."""
    short = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    return F.forall(short, lambda p: (F.length(p) <= 3) & (F.coalesce(F.left(p, F.lit(4)).try_cast("int"), F.lit(999)) <= 255))


def passes(kind: str, m: Column) -> Column:
    """The base check of a kind."""
    n = F.length(digits(m))
    return {"email": F.lit(True), "ip": parts_fit(m), "card": n.between(13, 19) & F.when(n.between(13, 19), luhn(digits(m))).otherwise(False),
            "phone": n.between(9, 15)}[kind]


def candidates(docs: DataFrame) -> DataFrame:
    """(content, kind, base, start, stop, match, before, after, ok) of every candidate span; content is the text's hash.

    Card candidates under 11 or over 21 digits are left out, as no kind has such a format.
    """
    t = docs.select(F.xxhash64(text_or_empty()).alias("content"), text_or_empty().alias("text"))
    has_digit = F.col("text").rlike("[0-9A-Fa-f]:[0-9A-Fa-f]|[0-9]")
    none = F.array().cast("array<struct<kind:string,base:boolean,start:int,stop:int,match:string,before:string,after:string,ok:boolean>>")

    def of(kind: str, base: bool, pattern: str) -> Column:
        s = spans.found(F.col("text"), pattern)
        if kind == "card":
            s = F.filter(s, lambda x: F.length(digits(x["match"])).between(11, 21))
        full = F.transform(s, lambda x: F.struct(F.lit(kind).alias("kind"), F.lit(base).alias("base"), *[x[c].alias(c) for c in
                                                 ("start", "stop", "match", "before", "after")], passes(kind, x["match"]).alias("ok")))
        gate = F.col("text").rlike(NEEDS[kind]) if kind in NEEDS else has_digit
        return F.when(gate, full).otherwise(none)

    return t.select("content", F.explode(F.concat(*[of(*g) for g in GENERATORS])).alias("c")).select("content", "c.*")


def described(c: DataFrame) -> DataFrame:
    """Add the features, all small integers."""
    m, d = F.col("match"), digits(F.col("match"))
    group = F.filter(F.split(m, r"[^0-9A-Za-z]+"), lambda x: x != "")
    side = lambda x: (F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"[A-Za-z]"), 2).when(x.rlike("[0-9]"), 3).otherwise(4))
    largest = F.array_max(F.transform(F.filter(F.split(m, r"[^0-9]+"), lambda x: x != ""), lambda x: F.least(F.length(x), F.lit(9)) * 2
                                      + (F.coalesce(F.left(x, F.lit(4)).try_cast("int"), F.lit(0)) > 255).cast("int")))
    cue = (F.when(F.col("before").rlike(r"(?i)mail|contact|write"), 1).when(F.col("before").rlike(r"(?i)call|phone|tel|fax|mobile"), 2)
           .when(F.col("before").rlike(r"(?i)card|visa|pay|account"), 3).when(F.col("before").rlike(r"(?i)\bip\b|host|server|address"), 4).otherwise(0))
    bucket = lambda x, top: F.least(x, F.lit(top)).cast("int")
    return (c.withColumn("kind_no", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int"))
            .withColumn("digits", bucket(F.length(d), 22)).withColumn("groups", bucket(F.size(group), 9))
            .withColumn("marks", bucket(F.length(m) - F.length(F.regexp_replace(m, r"[^0-9A-Za-z]", "")), 9))
            .withColumn("size", bucket(F.floor(F.length(m) / 4), 12))
            .withColumn("letters", bucket(F.length(F.regexp_replace(m, r"[^A-Za-z]+", "")), 5))
            .withColumn("check", F.when(F.length(d).between(12, 20), luhn(d)).otherwise(False).cast("int"))
            .withColumn("largest", F.coalesce(largest, F.lit(0)).cast("int"))
            .withColumn("cue", cue.cast("int")).withColumn("left", side(F.right("before", F.lit(1))).cast("int"))
            .withColumn("right", side(F.col("after")).cast("int")))


def scored(described_rows: DataFrame) -> DataFrame:
    """Distinct descriptions with their score and whether the kind's threshold selects them.

    The fit reads one row per description and label with its count as weight; its size is bounded by
    the number of descriptions, not of documents.
    """
    table = cut(described_rows.groupBy(*FEATURES).agg(
        F.sum((F.col("base") & F.col("ok")).cast("bigint")).alias("yes"), F.sum((F.col("base") & ~F.col("ok")).cast("bigint")).alias("no")))
    both = table.agg(F.sum("yes"), F.sum("no")).first()
    if not both[0] or not both[1]:
        return table.select(*FEATURES, F.lit(0.0).alias("score"), F.lit(False).alias("chosen"))
    wide = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(table)
    label = lambda y, c: wide.where(F.col(c) > 0).select("x", F.lit(float(y)).alias("label"), F.log1p(F.col(c).cast("double")).alias("w"))
    model = GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=5).fit(label(1, "yes").union(label(0, "no")))
    s = cut(model.transform(wide).select(*FEATURES, "yes", "no", F.round(vector_to_array("probability")[1], 9).alias("score")))
    above = W.partitionBy("kind_no").orderBy(F.col("score").desc()).rangeBetween(W.unboundedPreceding, W.currentRow)
    by = s.groupBy("kind_no", "score").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    precise = by.withColumn("p", F.sum("yes").over(above) / (F.sum("yes").over(above) + F.sum("no").over(above))).where(F.col("p") >= PRECISION)
    floor = precise.groupBy("kind_no").agg(F.min("score").alias("floor"))
    return s.join(floor, "kind_no", "left").select(*FEATURES, "score", F.coalesce(F.col("score") >= F.col("floor"), F.lit(False)).alias("chosen"))


def clash(x: Column, y: Column) -> Column:
    return (x["start"] < y["stop"]) & (y["start"] < x["stop"])


def apart(m: Column) -> Column:
    """Spans (score, kind_no, start, stop) taken best first, by score, start, kind and length, that overlap none taken before."""
    ranked = F.sort_array(F.transform(m, lambda x: F.struct((-x["score"]).alias("rank"), x["start"].alias("start"), x["kind_no"].alias("kind_no"),
                                                            (-x["stop"]).alias("end"), x["stop"].alias("stop"))))
    none = F.filter(ranked, lambda x: F.lit(False))
    return F.aggregate(ranked, none, lambda taken, x: F.when(F.exists(taken, lambda y: clash(x, y)), taken).otherwise(F.concat(taken, F.array(x))))


def spans_by_text(docs: DataFrame) -> DataFrame:
    """(content, base, extra): sorted spans (kind number, start, stop) of each text that has any."""
    c = cut(described(candidates(docs)).drop("match", "before", "after"))
    chosen = cut(scored(c).where("chosen").select(*FEATURES, "score"))
    base = c.where("base and ok").select("content", "base", F.lit(0.0).alias("score"), "kind_no", "start", "stop")
    more = c.where("not (base and ok)").join(chosen, list(FEATURES)).select("content", F.lit(False).alias("base"), "score", "kind_no", "start", "stop")
    all_ = base.union(more).groupBy("content").agg(F.collect_set(F.struct("base", "score", "kind_no", "start", "stop")).alias("s"))
    pick = lambda x: F.struct(x["kind_no"].alias("kind_no"), x["start"].alias("start"), x["stop"].alias("stop"))
    d = all_.select("content", F.filter("s", lambda x: x["base"]).alias("b"), F.filter("s", lambda x: ~x["base"]).alias("m"))
    d = d.withColumn("m", apart(F.filter("m", lambda x: ~F.exists("b", lambda y: clash(x, y)))))
    return d.select("content", F.sort_array(F.transform("b", pick)).alias("base"), F.sort_array(F.concat(F.transform("b", pick), F.transform("m", pick))).alias("every"))


def report(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, the hash of the base spans, and all spans, for every document."""
    found = cut(spans_by_text(docs))
    none = F.array().cast("array<struct<kind_no:int,start:int,stop:int>>")
    d = docs.select("doc_id", F.xxhash64(text_or_empty()).alias("content")).join(found, "content", "left")
    d = d.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("every", none).alias("every"))
    named = lambda s: spans.joined(F.transform(s, lambda x: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind_no"]).alias("kind"),
                                                                     x["start"].alias("start"), x["stop"].alias("stop"))))
    n = lambda i, k: F.size(F.filter("base", lambda x: x["kind_no"] == i)).cast("bigint").alias(f"n_{k}")
    return d.select("doc_id", *[n(i + 1, k) for i, k in enumerate(KINDS)], F.sha2(named(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    named(F.col("every")).alias("spans"))


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every span replaced by its kind in brackets, with their own columns."""
    found = cut(spans_by_text(docs)).select("content", "every")
    d = packed(docs, F.xxhash64(text_or_empty()).alias("content"), F.col("text").cast("string").alias("text")).join(found, "content", "left")
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    name = lambda x: F.element_at(F.array(*[F.lit(f"[{k}]") for k in KINDS]), x["kind_no"])
    by_start = F.array_sort(F.col("every"), lambda a, b: a["start"] - b["start"])
    walked = F.aggregate(by_start, state, lambda s, x: F.when(x["start"] < s["at"], s).otherwise(F.struct(
        x["stop"].alias("at"), F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), name(x)).alias("out"))),
        lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    text = F.when(F.col("every").isNull(), F.col("text")).otherwise(walked)
    return d.select(*[text.alias("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
