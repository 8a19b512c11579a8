"""The driver contract loads with and without the folders of the text operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _keys(folder):
    code = "import __spark_entry__ as e; print(*e.queries())"
    env = {**os.environ, "PYTHONPATH": str(folder)}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    return set(said.stdout.split())


@pytest.mark.parametrize("pipeline", [True, False])
def test_loads_without_the_text_folders(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "urbanframe"), tmp_path / "urbanframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")):
        shutil.copy(os.path.join(ROOT, "corpus_pipeline.py"), tmp_path)
    keys = _keys(tmp_path)
    assert len(keys) > 200 and "parcel_fos" in keys and "pipeline" not in keys
    assert not [k for k in keys if k.startswith("op") and k[2].isdigit()]
