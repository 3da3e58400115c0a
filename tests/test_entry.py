import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names_at(folder):
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(set(o) - set(q)), 'pipeline' in q)"
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True)
    return run.stdout.split() if not run.returncode else run.stderr


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    for name in ("pointweave", "__spark_entry__.py"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    with_all = int(names_at(tmp_path)[0])
    if not (tmp_path / "pointweave/llm").exists():  # they were taken away already
        assert with_all > 60 and names_at(tmp_path)[1:] == ["0", "False"]
        return
    (tmp_path / "pointweave/llm/tables.py").write_text("import a_module_that_is_not_there\n")
    assert "a_module_that_is_not_there" in names_at(tmp_path)  # a broken dependency is no absent subpackage
    shutil.rmtree(tmp_path / "pointweave/llm")
    count, unknown, pipeline = names_at(tmp_path)
    assert int(count) == with_all - 14 and unknown == "0" and pipeline == "False"
