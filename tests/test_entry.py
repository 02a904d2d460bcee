"""The entry module with and without the optional subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(folder: Path) -> list[str]:
    code = "import __spark_entry__ as e; print(','.join(sorted(e.queries()))); print(','.join(sorted(e.oracle_sql())))"
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})
    assert done.returncode == 0, done.stderr
    return [line.split(",") for line in done.stdout.strip().splitlines()[-2:]]


def test_queries_without_the_training_operators(tmp_path):
    for part in ("lumenfold", "__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / part).is_dir():
            shutil.copytree(ROOT / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / part).exists():
            shutil.copy(ROOT / part, tmp_path / part)
    for _ in range(2):  # the folders alone are gone, then the pipeline too
        queries, oracles = _names(tmp_path)
        assert "gmv_change" in queries and set(oracles) <= set(queries)
        assert not any(q.startswith("op") and q[2].isdigit() or q == "pipeline" for q in queries)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
