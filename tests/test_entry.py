"""The entry module still imports, and lists all other queries, without the part that can be left out."""

import json
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder):
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, capture_output=True, text=True, timeout=120,
                         env={**os.environ, "PYTHONPATH": str(folder)})
    assert out.returncode == 0, out.stderr
    return json.loads(out.stdout.splitlines()[-1])


def copied(folder, *left_out):
    skip = shutil.ignore_patterns("__pycache__", *left_out)
    shutil.copytree(os.path.join(ROOT, "gleaner"), folder / "gleaner", ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), folder)


def test_other_queries_stay_without_the_operators(tmp_path):
    from gleaner.catalog import QUERIES, SQL

    copied(tmp_path, "llm")
    assert listed(tmp_path) == [sorted(QUERIES), sorted(SQL)]


def test_other_queries_stay_with_an_empty_folder(tmp_path):
    from gleaner.catalog import QUERIES

    copied(tmp_path, "llm")
    (tmp_path / "gleaner" / "llm").mkdir()
    assert listed(tmp_path)[0] == sorted(QUERIES)
