"""The driver's entry points, with and without the optional part."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from docquire.sources.storage import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "docquire"), tmp_path / "docquire", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'filter_eq' in q and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


class _Unset:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf, self.sparkContext = self, self
        self.master, self.chosen = master, None

    def get(self, *_):
        return None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_no_folder_of_one_machine_on_a_cluster():
    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(_Unset(master))
    for master in ("local", "local[*]", "local[8]", "local[4,2]"):
        assert shared_dir(_Unset(master))
