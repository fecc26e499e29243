import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from signalops.functions.lineage import cut
from signalops.llm import mixing, tiling
from tests.llm.test_quality_rules import verdicts
from tests.llm.test_simhash import plain_components, plain_fingerprint


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_against_a_plain_version(spark, documents, sf):
    got, docs = {}, documents
    for name, stage in p.STAGES:
        before, docs = docs, cut(stage(spark, docs, sf))
        got[name] = (before.collect(), docs)
        if name != "token_output":
            assert docs.columns == documents.columns and docs.count()
    rows, out = got["quality"]
    assert ids(out) == sorted(d for d, _, k in verdicts([(r["doc_id"], r["text"], r["source"]) for r in rows], 20) if k)
    rows, out = got["near_duplicates"]
    assert ids(out) == sorted(d for d, _, c in plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in rows]) if d == c)
    rows, out = got["decontamination"]
    bench = [b" ".join(r["text"].lower().encode().translate(tiling._BLANK).split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {r["doc_id"] for r in rows if any(b in b" ".join(r["text"].lower().encode().translate(tiling._BLANK).split()) for b in bench)}
    assert not whole & set(ids(out)) and len(ids(out)) >= 0.9 * (len(rows) - len(whole))
    rows, out = got["mixing"]
    drawn = mixing.report(spark.createDataFrame(rows, documents.schema))
    assert ids(out) == ids(drawn.where("sampled"))
    rows, out = got["token_output"]
    t, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        x = t.encode(r["text"], add_special_tokens=False).ids + [1]
        want.append((r["doc_id"], at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in out.collect()) == want
    assert sorted(tuple(r) for r in p.run(spark, sf).collect()) == want
