import pytest

from foliant.plans import catalog
from oracle import SF, connect, same


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    same(catalog.QUERIES[name](spark, SF), catalog.ORACLES[name], con)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_rest_does_not_import_llm():
    import pathlib

    for path in pathlib.Path(catalog.__file__).parents[1].rglob("*.py"):
        if "llm" not in path.parts:
            assert "foliant.llm" not in path.read_text()


def test_lsa_ranks_a_text_first_for_itself(spark):
    from foliant.operators import vector

    texts = ["red fox in snow", "red fox in woods", "blue whale in sea", "blue whale in ice", "green frog pond", "green frog leaf"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    vectors, index, idf, parts = vector.lsa(docs, "doc_id", "text", 4)
    asked = spark.createDataFrame([(0, vector.embed(["red fox"], index, idf, parts)[0].tolist())], "query_id bigint, embedding array<double>")
    assert {r.doc_id for r in vector.cosine_topk(vectors, asked, 2, "doc_id").collect()} == {0, 1}


def test_cosine_rejects_other_dimensions(spark):
    from pyspark.errors import PythonException

    from foliant.operators import vector

    rows = spark.createDataFrame([(1, [1.0, 0.0])], "vec_id bigint, embedding array<double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query_id bigint, embedding array<double>")
    with pytest.raises(PythonException):
        vector.cosine_topk(rows, asked, 1).collect()


@pytest.mark.parametrize("gone", [("llm", "corpus_pipeline.py"), ("llm",)])
def test_repository_works_without_its_llm_folders(tmp_path, gone):
    import pathlib
    import shutil
    import subprocess
    import sys

    root = pathlib.Path(catalog.__file__).parents[2]
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "spark-warehouse", *gone))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=copy, check=True, env={"PATH": "/usr/bin:/bin"})
