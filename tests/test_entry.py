"""The entry module without the corpus operators, or without something that they import."""

import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q))"


def _counts(folder) -> list[int]:
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", ASK], cwd=folder, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def _copy(to):
    shutil.copytree(os.path.join(HOME, "strataloom"), to / "strataloom")
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(os.path.join(HOME, name)):
            shutil.copy(os.path.join(HOME, name), to / name)


def test_without_the_subpackage(tmp_path):
    _copy(tmp_path)
    shutil.rmtree(tmp_path / "strataloom" / "llm", ignore_errors=True)
    n, corpus = _counts(tmp_path)
    assert n > 70 and corpus == 0
    (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
    assert _counts(tmp_path) == [n, 0]


def test_without_a_library_of_the_subpackage(tmp_path):
    _copy(tmp_path)
    (tmp_path / "xxhash.py").write_text("raise ImportError('no xxhash here')\n")
    n, corpus = _counts(tmp_path)
    assert n > 70 and corpus == 0
