"""The pipeline on a small folder: each stage's decisions take effect, clean documents stay."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline


def test_stages(spark, tmp_path):
    word = lambda i, j: f"w{(i * 7919 + j * 104729) % 99991}"
    prose = lambda i: " ".join(word(i, j) for j in range(80))
    shared = "this very line is repeated in many of the documents here"
    key = "AKIA" + "Q7ZD2M4K8P3X9W5R"
    long = "".join("aB3dE5gH7jK9mN2pQ4rS6tV8wX"[(i * i + 7 * i) % 26] for i in range(10_000))
    rows = [(i, prose(i) + (f"\n{shared}" if i < 6 else "") + (f"\nuse {key} here" if i == 9 else f'\ntoken = "{long}" here' if i == 11 else ""), "en", "src/a", 0) for i in range(30)]
    rows += [(50, prose(20) + " one more", "en", "src/a", 0), (51, "BUY NOW " * 100, "en", "src/b", 0), (52, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"s{i}"))
        docs = spark.read.parquet(str(tmp_path / f"s{i}"))
        seen[name] = {r.doc_id: getattr(r, "text", None) for r in docs.collect()}
    assert set(seen["quality rules"]) == {*range(30), 50}
    assert [i for i, t in seen["line dedup"].items() if shared in t] == [5]
    assert set(seen["near dedup"]) == set(range(30))
    assert seen["secret scan"][11] == prose(11) + '\ntoken = "[SECRET]" here'
    assert key not in seen["secret scan"][9] and "[SECRET]" in seen["secret scan"][9]
    assert set(seen["packing"]) == set(range(30)) and corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None, "x"), (1, None, "en", "s", None, "y"), (1, "", "en", "s", 0, "y"), (2, "too short to keep", None, None, 17, None)]])
def test_stages_on_nothing(spark, tmp_path, rows):
    """Empty tables, and documents that the first stage rejects: every later stage gets an empty table. The extra column's name clashes with an operator's own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, word string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= len(rows), name
