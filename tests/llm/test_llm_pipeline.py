"""The corpus pipeline against a plain Python version of its stages."""

from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing, quality, simhash
from tests_llm_brute import brute_component_keepers


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(60):
        words = [f"w{(i * 7 + k * k) % 97}x{(k * 13 + i) % 89}" for k in range(70)]
        text = " ".join(words) + "\nA line that many of the documents share word for word."
        rows.append((i, text if i % 9 else "too short", "en", f"s{i % 3}", len(text)))
    rows += [(100, rows[1][1], "en", "s1", 0), (101, None, "en", None, None), (102, "", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "source_mixing", "sentencepiece_encoding"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, steps[-1], "").write.parquet(path)
        steps.append(spark.read.parquet(path))
    good, lines, near, mixed, final = steps[1:]
    assert all(s.columns == docs.columns for s in (good, lines, near, mixed))
    kept = {r.doc_id for r in quality.query(docs).collect() if r.kept}
    assert {r.doc_id for r in good.collect()} == kept
    shared = "A line that many of the documents share word for word."
    assert lines.count() == good.count() and [r.doc_id for r in lines.filter(F.contains("text", F.lit(shared))).collect()] == [max(kept)]
    assert {r.doc_id for r in near.collect()} == brute_component_keepers([(r.doc_id, r.text) for r in lines.collect()])
    taken = {r.doc_id: r.taken // r.size for r in mixing.query(near).collect() if r.size}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: int(v) for k, v in taken.items() if v})
    assert final.count() == mixed.count() and final.filter("NOT round_trip").count() == 0


def test_run_and_empty_input(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    docs.limit(0).write.parquet(str(tmp_path / "none/documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    assert simhash.query(docs.limit(0)).count() == 0
