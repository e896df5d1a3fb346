"""The driver's contract in a copy of the repository, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), sorted(e.oracle_sql().keys() - e.queries().keys()))"


def ask(at):
    run = subprocess.run([sys.executable, "-c", ASK], cwd=at, env={**os.environ, "PYTHONPATH": f"{at}:{os.environ.get('PYTHONPATH', '')}"}, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
    return run.stdout.split()


def copy_to(at, *without):
    shutil.copytree(ROOT, at, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache"))
    for name in without:
        shutil.rmtree(os.path.join(at, name), ignore_errors=True)
    return str(at)


def test_queries_without_the_subpackage(tmp_path):
    from segloom import catalogue

    bare = copy_to(tmp_path / "bare", "segloom/llm", "tests/llm")
    assert ask(bare) == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False", "[]"]
    os.remove(os.path.join(bare, "corpus_pipeline.py"))
    assert ask(bare) == [str(len(catalogue.QUERIES)), str(len(catalogue.ORACLES)), "False", "[]"]


def test_other_missing_modules_are_errors(tmp_path):
    at = copy_to(tmp_path / "broken", "segloom/sources", "segloom/llm")
    run = subprocess.run([sys.executable, "-c", ASK], cwd=at, env={**os.environ, "PYTHONPATH": at}, capture_output=True, text=True, timeout=120)
    assert run.returncode != 0 and "segloom.sources" in run.stderr


def test_nothing_else_imports_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "segloom")):
        if "llm" not in folder.split(os.sep):
            for name in names:
                if name.endswith(".py"):
                    assert "segloom.llm" not in open(os.path.join(folder, name), encoding="utf-8").read(), name
