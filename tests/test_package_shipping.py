"""The package reaches the tasks, and the text operators are an optional part."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def without_the_repository() -> dict[str, str]:
    """The environment, with other places of modules only."""
    places = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    kept = [p for p in places if p and not Path(p).resolve().is_relative_to(ROOT)]
    return os.environ | {"PYTHONPATH": os.pathsep.join(kept)}


def test_tasks_run_from_another_folder(tmp_path):
    env = without_the_repository()
    call = [sys.executable, str(ROOT / "tools/check_queries.py"), "/root/testdata/sf0.001", "iforest_summary"]
    done = subprocess.run(call, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "same" in done.stdout, done.stdout + done.stderr[-2000:]


def test_entry_without_the_text_operators(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in ("fixtures", "weekwatch"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    names = "import __spark_entry__ as e; print(len(e.queries()), *[q for q in e.queries() if q.startswith('op')])"
    env = without_the_repository()
    done = subprocess.run(
        [sys.executable, "-B", "-c", names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert len(done.stdout.split()) == 1 and int(done.stdout) >= 49
