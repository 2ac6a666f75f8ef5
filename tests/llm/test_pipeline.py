"""Pipeline: each stage on its own input, and the whole."""

import os
import shutil
import subprocess
import sys

import corpus_pipeline as C
from fixtura.llm.queries import MIX_EXPONENT
from pyspark.sql import functions as F


def test_stages_keep_columns_and_decide(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"score": F.lit("s"), "t1": F.lit(1), "n": F.lit(None).cast("int"), "slot": F.lit("old")})
    assert [n for n, _ in C.STAGES] == ["toxicity", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    sizes = [docs.count()]
    for name, stage in C.STAGES:
        out = C.stored(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns if name != "sharding" else set(docs.columns) < set(out.columns)
        if name in ("toxicity", "ngram_jaccard", "decontamination"):
            assert out.count() < sizes[-1] and out.exceptAll(docs).count() == 0
        docs = out
        sizes.append(docs.count())
    assert MIX_EXPONENT < 1 and sizes[-1] == sizes[-2] and sizes[1] > 0.8 * sizes[0]


def test_stages_take_odd_rows(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "word " * 20_000, None, "a", 5), (3, "plain text", "en", None, 9)]
    for _, stage in C.STAGES:
        assert stage(spark, spark.createDataFrame([], schema), sf_dir).count() == 0
    docs = spark.createDataFrame(rows, schema)
    for name, stage in C.STAGES[:3]:
        docs = C.stored(stage(spark, docs, sf_dir))
        assert docs.count() == (5 if name == "toxicity" else 4)


def test_copy_with_a_fifth_appended_goes(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    base = [f"word{i}" for i in range(400)]
    rows = [(1, " ".join(base), "en", "a", 0), (2, " ".join(base + [f"more{i}" for i in range(80)]), "en", "a", 0), (3, " ".join(base + [f"much{i}" for i in range(140)]), "en", "a", 0)]
    assert sorted(r.doc_id for r in C.keep_one_of_copies(spark, spark.createDataFrame(rows, schema), sf_dir).collect()) == [1, 3]


def test_rest_imports_without_the_corpus_part(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    for name in ("fixtura", "workload", "__spark_entry__.py"):
        copy = shutil.copytree if os.path.isdir(f"{root}/{name}") else shutil.copy
        copy(f"{root}/{name}", tmp_path / name)
    shutil.rmtree(tmp_path / "fixtura" / "llm")
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
