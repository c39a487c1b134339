"""The driver's entry points, with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SAY = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len([n for n in q if n[:2] != 'op' and n != 'pipeline']), len(q), set(s) <= set(q))"


def said(folder):
    out = subprocess.run([sys.executable, "-c", SAY], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_the_training_data_operators(tmp_path):
    for name in ("loomkv", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    engine, whole, fits = said(tmp_path)
    assert engine == whole and int(engine) >= 80 and fits == "True"
    if (ROOT / "loomkv" / "llm").exists():
        assert said(ROOT) == [engine, str(int(engine) + 10 + (ROOT / "corpus_pipeline.py").exists()), "True"]
