"""The entry module stands without the optional subpackage, and doesn't hide other import errors."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries())"


def copied(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/millrace", tmp_path / "millrace", ignore=lambda d, names: {"llm", "__pycache__"} & set(names))
    return tmp_path


def said(folder):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    return subprocess.run([sys.executable, "-c", SAY], cwd=folder, env=env, capture_output=True, text=True)


def test_without_the_optional_parts(tmp_path):
    out = said(copied(tmp_path))
    queries, sql, pipeline = out.stdout.split()
    assert int(queries) == int(sql) > 60 and pipeline == "False"


def test_broken_parts_are_not_hidden(tmp_path):
    folder = copied(tmp_path)
    (folder / "millrace/llm").mkdir()
    (folder / "millrace/llm/__init__.py").write_text("")
    (folder / "millrace/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    out = said(folder)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr


def test_short_lived_folders_end_with_their_block(spark):
    import os

    from millrace.workspace import scratch, short_lived

    kept = scratch(spark, "kept")
    spark.range(3).write.parquet(kept)
    with short_lived(spark):
        path = scratch(spark, "gone")
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not os.path.exists(path.removeprefix("file://")) and spark.read.parquet(kept).count() == 3
