"""The registered queries and the pipeline's stages on the smallest tables, held against brute force or told labels."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import classes, slow_fingerprint, slow_roots

import corpus_pipeline
from packetloom.llm import queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def part(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def removed(rows):
    """doc_id to the bytes that stay and the number of removed runs, string by string."""
    first = {}
    raw = {k: (t or "").encode() for k, t in rows.items()}
    for k in sorted(raw):
        for i in range(len(raw[k]) - 49):
            first.setdefault(raw[k][i : i + 50], k)
    out = {}
    for k, b in raw.items():
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < k:
                gone[i + 1 : i + 51] = True
        out[k] = (bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]]), int((gone[1:] & ~gone[:-1]).sum()))
    return out


def test_language_of_texts_not_learnt_from(spark, texts):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, FOLDER).collect()}
    assert got.keys() == texts.keys() and all(r.held_out == (part(k, 4) == 2) and 0 <= r.score <= 1 for k, r in got.items())
    known = [k for k, r in got.items() if r.held_out and texts[k].lang and any(c.isalpha() for c in texts[k].text or "")]
    assert sum(got[k].lang_pred == texts[k].lang for k in known) >= 0.9 * len(known)


def test_toxicity_split_and_threshold(spark, texts):
    got = {r.doc_id: r for r in queries.op5_toxicity(spark, FOLDER).collect()}
    assert got.keys() == texts.keys() and all(r.held_out == (part(k, 3) == 1) and r.predicted == int(r.score >= 0.7) for k, r in got.items())


def test_simhash_components(spark, texts):
    got = {r.doc_id: r for r in queries.op4_simhash(spark, FOLDER).collect()}
    ids = sorted(texts)
    want = [slow_fingerprint(texts[k].text) for k in ids]
    assert [int(got[k].fingerprint, 16) for k in ids] == want
    assert [got[k].component_id for k in ids] == classes(want, ids)


def test_suffix_removal_of_documents(spark, texts):
    got = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, FOLDER).collect()}
    want = removed({k: r.text for k, r in texts.items()})
    assert got.keys() == want.keys()
    for k, (kept, spans) in want.items():
        n = len((texts[k].text or "").encode())
        assert (got[k].n_bytes, got[k].n_removed, got[k].n_spans, got[k].kept_sha256) == (n, n - len(kept), spans, hashlib.sha256(kept).hexdigest())


def test_stages_of_the_pipeline(spark, texts):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "leaks", "mixing"]
    # toxicity: what the operator calls toxic goes, all else stays as it is
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    judged = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    kept = stages["toxicity"](spark, docs, FOLDER)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and {r.doc_id: r.text for r in kept.collect()} == {k: r.text for k, r in texts.items() if not judged[k]}
    # near-duplicates: the least id of each class
    ids = sorted(texts)
    roots = slow_roots([texts[k].text for k in ids])
    assert sorted(r.doc_id for r in stages["near_duplicates"](spark, docs, FOLDER).collect()) == [k for k, root, at in zip(ids, roots, range(len(ids)), strict=True) if root == at]
    # repeats: the bytes that brute force leaves, as whole characters; nothing of a text, no row
    want = {k: b.decode("utf-8", "ignore") for k, (b, _) in removed({k: r.text for k, r in texts.items()}).items() if b or not texts[k].text}
    got = {r.doc_id: (r.text, r.n_chars, r.lang, r.source) for r in stages["repeats"](spark, docs, FOLDER).collect()}
    assert got == {k: (t, len(t), texts[k].lang, texts[k].source) for k, t in want.items()}
    # leaks: a planted item goes, the rest stays
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").orderBy("item_id").first().text
    clean = {r.doc_id for r in stages["leaks"](spark, docs, FOLDER).collect()}
    with_leak = docs.where(F.col("doc_id").isin(list(clean))).withColumn("text", F.when(F.col("doc_id") == min(clean), F.concat(F.lit(f"{item} "), "text")).otherwise(F.col("text")))
    assert {r.doc_id for r in stages["leaks"](spark, with_leak, FOLDER).collect()} == clean - {min(clean)}
    # mixing: copies of documents as they are, numbered by epoch from 0
    rows = stages["mixing"](spark, docs, FOLDER).collect()
    assert all(r.text == texts[r.doc_id].text and r.source == texts[r.doc_id].source and 0 <= r.place <= 1 for r in rows)
    epochs = {}
    for r in rows:
        epochs.setdefault(r.doc_id, []).append(r.epoch)
    assert all(sorted(x) == list(range(len(x))) for x in epochs.values())


def test_the_pipeline_keeps_what_its_stages_keep(spark, texts):
    got = corpus_pipeline.run(spark, FOLDER)
    assert got.columns == [*corpus_pipeline.COLUMNS, "epoch", "place"]
    rows = got.collect()
    assert rows and {r.doc_id for r in rows} <= texts.keys() and all((texts[r.doc_id].lang, texts[r.doc_id].source) == (r.lang, r.source) for r in rows)
