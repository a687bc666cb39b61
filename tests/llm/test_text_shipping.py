"""The text operators run in tasks that do not have the package, and never go missing in silence."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent
PLACES = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not Path(p).resolve().is_relative_to(ROOT)]
ENV = os.environ | {"PYTHONPATH": os.pathsep.join(PLACES)}


def test_queries_run_from_another_folder(tmp_path):
    names = [
        "op1_toxicity", "op4_packing", "op7_exact_dedup", "op8_neighbours", "op9_ngram_join",
        "op11_alignment", "op12_warc", "op13_conversation_repair",
    ]
    call = [sys.executable, str(ROOT / "tools/check_queries.py"), "/root/testdata/sf0.001", *names]
    done = subprocess.run(call, cwd=tmp_path, env=ENV, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr[-2000:]


def test_a_missing_dependency_is_an_error(tmp_path):
    blocked = "import sys; sys.modules['xxhash'] = None; import __spark_entry__"
    env = ENV | {"PYTHONPATH": os.pathsep.join([str(ROOT), *PLACES])}
    done = subprocess.run([sys.executable, "-B", "-c", blocked], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode != 0 and "xxhash" in done.stderr
