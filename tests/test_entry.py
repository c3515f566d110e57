"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_optional_package(tmp_path):
    """A copy without the folders of the ten operators still imports, with the pipeline's file there or not."""
    for name in ("corpusgraph", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'fused_hits' in q and set(o) <= set(q); assert not [n for n in q if n.startswith('op') or n == 'pipeline'], q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_optional_package():
    for folder, _, files in os.walk(os.path.join(ROOT, "corpusgraph")):
        if os.path.basename(folder) == "llm":
            continue
        for name in files:
            if name.endswith(".py"):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "llm" not in [word for line in f if line.lstrip().startswith(("import ", "from ")) for word in line.replace(".", " ").split()], name
