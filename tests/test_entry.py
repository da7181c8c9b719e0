"""The driver's entry points, also in a copy from which the operators for training data were taken out."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

from tests.conftest import ROOT

_SCRIPT = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sorted(k for k in e.queries() if k[:2] == 'op' or k == 'pipeline'))"


def _listed(root: str) -> list[str]:
    environ = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", _SCRIPT], cwd=root, env=environ, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split(maxsplit=2)


def _copy(to: str, *without: str) -> str:
    names = {"__spark_entry__.py", "logharbor", "corpus_pipeline.py"} - set(without)
    os.makedirs(to)
    for name in names & set(os.listdir(ROOT)):
        path = os.path.join(ROOT, name)
        if os.path.isdir(path):
            left_out = ("llm", "__pycache__") if "llm" in without else ("__pycache__",)
            shutil.copytree(path, os.path.join(to, name), ignore=shutil.ignore_patterns(*left_out))
        else:
            shutil.copy(path, to)
    return to


def test_without_the_training_data_operators(tmp_path):
    from logharbor.plans.catalog import ORACLES, QUERIES

    expected = [str(len(QUERIES)), str(len(ORACLES)), "[]"]
    for number, without in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        listed = _listed(_copy(str(tmp_path / str(number)), *without))
        assert [*listed[:2], listed[2].strip()] == expected


def test_every_query_with_sql_is_registered():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
