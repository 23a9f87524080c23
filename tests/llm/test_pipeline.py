"""The pipeline: stages, their order and columns, and what they must do to planted rows."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from deskmill.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
        assert docs.columns == COLUMNS
        assert docs.filter(F.char_length("text") != F.col("n_chars")).isEmpty()
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    again = corpus_pipeline.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32")
    assert again.exceptAll(packed.select(again.columns)).isEmpty()


@pytest.fixture
def planted(spark, tmp_path):
    rng = random.Random(3)

    def prose(lines=6):
        return "\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(25)) + " done." for _ in range(lines))

    texts = [prose() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)]
    passage = " ".join(f"p{rng.randrange(500)}" for _ in range(60)) + "."
    rows += [(100 + i, texts[0]) for i in range(5)]
    rows += [(200 + i, prose() + "\n" + passage) for i in range(4)]
    rows += [(300, prose().upper()), (301, "short."), (302, None), (303, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path), dict(rows), passage


def test_planted_rows(spark, planted):
    sf_dir, texts, passage = planted
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(kept) == [*range(60), 200, 201, 202, 203]
    assert all(kept[i] == texts[i] for i in range(60))
    assert [passage in kept[200 + i] for i in range(4)] == [True, False, False, False]


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
