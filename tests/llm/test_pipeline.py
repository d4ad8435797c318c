"""The corpus pipeline, stage by stage, against what its operators say."""

import random
import zlib

import corpus_pipeline
import numpy as np
from tidewell import scratch
from tidewell.llm import quality_qda, registry

from test_operators import similar_by_force


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "private_data", "mixture", "packing"]
    good = stages["quality"](spark, docs, sf_dir).cache()
    want = {r.doc_id for r in quality_qda.classify(docs, labels).where("predicted = 1").collect()}
    assert good.columns == docs.columns and {r.doc_id for r in good.select("doc_id").collect()} == want
    single = stages["near_duplicates"](spark, good, sf_dir).cache()
    # Five words and a similarity of 0.8, by all pairs; the stage held op4's own groups (three words, two bits) before, which keep most edited copies.
    home = similar_by_force([(r.doc_id, r.text) for r in good.collect()])
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.select("doc_id").collect()) == sorted(set(home.values()))
    private = stages["private_data"](spark, single, sf_dir).cache()
    assert private.columns == docs.columns and private.count() == single.count() and private.where("n_chars <> length(text)").count() == 0
    assert private.where("text RLIKE '[A-Za-z0-9]@[A-Za-z0-9-]+[.][A-Za-z0-9]'").count() == 0
    mixed = stages["mixture"](spark, private, sf_dir)
    assert mixed.columns == docs.columns and mixed.count() > 0
    packed = stages["packing"](spark, mixed, sf_dir).collect()
    assert max(r.length for r in packed) <= 2048
    assert all(len(r.ids) == 2 * r.length and zlib.crc32(np.frombuffer(r.ids, dtype="<u2").astype("<u4").tobytes()) == r.ids_crc32 for r in packed)
    assert len({(r.item, r.piece) for r in packed}) == len(packed) and len({r.item for r in packed}) == mixed.count()


def test_registry_has_the_ten():
    assert [n.split("_")[0] for n in registry.queries()] == [f"op{k}" for k in range(1, 11)]


def test_odd_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, ties and a further column: no stage fails, and none of the good documents goes before the mixture draws."""
    r = random.Random(5)
    names = ["".join(r.choices("abcdefghij", k=r.randint(3, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(names) for _ in range(n)) + "."
    junk = lambda n: " ".join(r.choice(["$$$", "BUY", "!!", "|", "7"]) for _ in range(n))
    rows = [(k, prose(80 + k) if k % 2 else junk(60 + k), "en", "a", 1, "x") for k in range(80)]
    rows += [(100, None, None, None, None, None), (101, "", "en", "a", 0, "x"), (None, prose(90), None, "b", 2, "y"), (102, prose(40_000), "de", None, None, None), (1, rows[1][1], "en", "a", 1, "z"), (1, prose(99), "en", "a", 1, "w"), (103, " \n\t", "en", "a", 3, "x")]
    labels = [(k, k % 2, int(k % 10 == 0)) for k in range(80)] + [(None, 1, 0), (3, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string"
    for name, data in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        docs = spark.read.parquet(f"{d}/documents.parquet")
        counts = []
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = scratch.stored(stage(spark, docs, d), "test")
            counts.append(docs.count())
            ids = {r.doc_id for r in docs.select("doc_id").collect()}
            kept = ids if len(counts) == 3 else (kept if len(counts) > 3 else None)
            assert set(docs.columns) <= set(schema.replace(" long", "").replace(" string", "").split(", "))
        made = corpus_pipeline.run(spark, d).collect()
        if not data:
            assert counts == [0, 0, 0, 0] and made == []
            continue
        assert {k for k in range(80) if k % 2} <= kept and not kept & {k for k in range(80) if k % 2 == 0}
        assert {r.doc_id for r in made} == ids <= kept and (102 not in ids or sum(r.length for r in made if r.doc_id == 102) > 40_000)
