"""The pipeline: each stage works on what its predecessor kept."""

import zlib

import numpy as np
import public_tokenizers
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from taqlspark.llm import pii, quality, simhash
from taqlspark.session import stage


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, apply in corpus_pipeline.STAGES:
        before, docs = docs, stage(apply(spark, docs, DATA), f"test-{name}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns

    before, after = kept["quality"]
    model = quality.fit(before, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = quality.score(before, model, keep=["doc_id"]).where(f"score >= {quality.THRESHOLD}")
    assert {r[0] for r in want.select("doc_id").collect()} == {r[0] for r in after.select("doc_id").collect()}
    assert 0 < after.count() < before.count()

    before, after = kept["near_duplicates"]
    groups = {r["id"]: r["component_id"] for r in simhash.near_duplicates(before).collect()}
    assert sorted(r[0] for r in after.select("doc_id").collect()) == sorted(set(groups.values()))

    before, after = kept["personal_data"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in after.collect():
        base = pii.base_spans(texts[r["doc_id"]])
        assert r["n_chars"] == len(r["text"]) and not pii.base_spans(r["text"])
        assert base or r["text"] == texts[r["doc_id"]] or "<" in r["text"]

    before, after = kept["packing"]
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    ids = {r["doc_id"]: np.array([*plain.encode(r["text"], add_special_tokens=False).ids, 2], "<u4") for r in before.collect()}
    found = {}
    for r in after.orderBy("doc_id", "start").collect():
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        found[r["doc_id"]] = found.get(r["doc_id"], b"") + bytes(r["ids"])
    assert found == {i: x.tobytes() for i, x in ids.items()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, further columns with names that operators use, and no rows at all."""
    rows = [(i, t, "en", None, 1, 0.5, 7, "k") for i, t in [(1, ""), (2, None), (3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (4, "mail me@x.org now " * 3000), (None, None)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, id string")
    spark.createDataFrame([(3, 1, 0), (None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (docs, docs.limit(0)):
        for name, apply in corpus_pipeline.STAGES:
            out = apply(spark, frame, str(tmp_path))
            found = out.collect()
            if name != "packing":
                assert out.columns == docs.columns
            if name == "near_duplicates" and frame is docs:
                assert sorted(str(r["doc_id"]) for r in found) == ["1", "3", "4"]
            if name == "personal_data" and frame is docs:
                assert len(found) == len(rows) and max(len(r["text"] or "") for r in found) == len("mail <email> now " * 3000)
            if frame is not docs:
                assert found == []
