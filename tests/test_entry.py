import subprocess
import sys


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in ("corpus_pipeline", "skarn.llm") or name.startswith("skarn.llm."):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)


def test_without_the_corpus_folders(tmp_path):
    """The repository without corpus_pipeline.py and both llm folders."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=copy)
    subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], check=True, cwd=copy)
