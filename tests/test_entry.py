import importlib
import os
import subprocess
import sys

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    queries = entry.queries()
    assert set(entry.oracle_sql()) <= set(queries) and len(queries) > 100
    assert all(callable(q) for q in queries.values())


def test_entry_without_the_corpus_folders(tmp_path):
    for name in ("__spark_entry__.py", "faunaflow"):
        subprocess.run(["cp", "-r", f"{HERE}/{name}", str(tmp_path)], check=True)
    llm = tmp_path / "faunaflow" / "llm"
    if llm.exists():
        llm.rename(tmp_path / "gone")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'w1_trajectory' in q and not [k for k in q if k.startswith('op') or k == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": ""})


def test_flagship_runs(spark):
    if os.path.isdir("/root/testdata/sf0.001"):
        assert importlib.reload(entry).entry(spark).limit(1).count() == 1
