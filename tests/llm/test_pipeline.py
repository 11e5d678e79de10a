import importlib

import numpy as np

import corpus_pipeline
from quadrille.llm import queries

from .conftest import make


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(150):
        text = list(rng.choice(words, 80))
        toxic = i % 6 == 0
        if toxic:
            text[3] = text[30] = "vile"
        rows.append((i, " ".join(text), "en", f"s{i % 4 if i % 3 else 0}", 500))
        labels.append((i, 1, int(toxic)))
    clean = [r for r in rows if r[0] % 6]
    near = clean[2][1].split()
    near[20] = "swapped"
    rows += [(1000, clean[0][1], "en", "s0", 500), (1001, " ".join(near), "en", "s1", 500)]
    make(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    want = [
        {r[0] for r in clean} | {1000, 1001},
        ({r[0] for r in clean} | {1000, 1001}) - {clean[0][0]},
        ({r[0] for r in clean} | {1000}) - {clean[0][0]},
    ]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns, name
        assert {r["doc_id"] for r in docs.collect()} == ids, name
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path))
    assert mixed.columns == columns and {r["doc_id"] for r in mixed.collect()} == want[-1]
    packed = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(packed.doc_id) == want[-1]
    assert len(packed) == mixed.count()


def test_registered():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert {f"op{i}" for i in range(1, 11)} <= {n.split("_")[0] for n in names} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)


def test_an_operator_drops_what_another_left_in_its_worker():
    import pyarrow as pa

    from quadrille.llm._common import rows_of, worker_cache

    batch = pa.record_batch({"text": pa.array([b"a", b"b"])})
    worker_cache()["tokenizer", "x"] = 1
    assert list(rows_of(batch, keep=True)) == [b"a", b"b"] and ("tokenizer", "x") in worker_cache()
    assert list(rows_of(batch)) == [b"a", b"b"] and ("tokenizer", "x") not in worker_cache()
    assert "__name__" in worker_cache()
