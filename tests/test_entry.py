import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_catalogue():
    from rulequarry.plans import catalogue

    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_without_the_optional_part(tmp_path):
    """The whole tree without corpus_pipeline.py and the two folders: the entry point imports, the other queries are there and the other tests are found."""
    left = {"rulequarry": {"llm"}, "tests": {"llm"}, "": {"corpus_pipeline.py", ".git"}}
    gone = lambda folder, names: {"__pycache__", ".pytest_cache"} | left.get(str(Path(folder).relative_to(ROOT)).replace(".", ""), set())
    copy = shutil.copytree(ROOT, tmp_path / "copy", ignore=gone)
    assert not (copy / "rulequarry/llm").exists() and not (copy / "tests/llm").exists() and not (copy / "corpus_pipeline.py").exists()
    run = lambda *args: subprocess.run([sys.executable, *args], cwd=copy, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(copy)})
    said = run("-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), [x for x in e.queries() if x.startswith('op')], len(e.oracle_sql()))")
    from rulequarry.plans import catalogue

    assert said.stdout.split("\n")[-2] == f"{len(catalogue.queries())} False [] {len(catalogue.oracle_sql())}", said.stderr
    said = run("-m", "pytest", "--collect-only", "-q", "tests")
    assert said.returncode == 0 and "test_chain_of_modules" in said.stdout, said.stdout
