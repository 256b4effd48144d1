"""The pipeline on a small table: each stage's decisions take effect, and the rest works without it."""

import os
import random
import subprocess
import sys

import pytest

pytest.importorskip("trailspark.llm")
pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402


def table(spark, path):
    rng = random.Random(1)
    words = {"en": ["the", "of", "and", "house", "river", "stone"], "xx": ["zork", "quex", "vant", "plim", "droz"]}
    text = lambda lang: " ".join(rng.choice(words[lang]) + rng.choice(words[lang]) for _ in range(60))
    rows = [(k, text(lang), lang, "s", 0) for k in range(120) for lang in [rng.choice(["en", "xx"])]]
    copy = rows[3][1]
    rows += [(200, copy.replace(" ", "  "), "en", "s", 0), (201, copy + " tail", "en", "s", 0), (202, None, "en", "s", 0), (203, "... 123", None, "s", 0), (204, text("en") + " mail a.b@c.de", "en", "s", 0), (205, text("xx"), None, None, None), (205, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = table(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    steps = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        steps.append(docs)
        if name != "best_fit_packing":
            assert docs.columns == columns
    ids = [{r["doc_id"] for r in s.collect()} for s in steps]
    assert ids[0] == {r[0] for r in rows} - {202, 203}
    assert ids[0] - ids[1] == {200} and ids[1] - ids[2] == {201} and ids[2] == ids[3] == ids[4]
    masked = next(r for r in steps[3].collect() if r["doc_id"] == 204)
    assert masked["text"].endswith("mail [EMAIL]") and masked["n_chars"] == len(masked["text"])
    empty = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        empty = out if "text" in out.columns else empty


def test_the_rest_imports_without_the_subpackage():
    code = "import sys\nsys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert 'counterparties' in q"
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-500:]
