"""The entry file with and without the parts that may be absent."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
ASK = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'tfidf' in q; print(sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q))"


def ask(folder):
    return subprocess.run([sys.executable, "-c", ASK], cwd=folder, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("absent", [("paperloom/llm", "corpus_pipeline.py"), ("paperloom/llm",)])
def test_entry_without_the_training_text_part(tmp_path, absent):
    skipped = {str(ROOT / a) for a in absent} | {str(ROOT / ".git")}
    shutil.copytree(ROOT, tmp_path / "copy", ignore=lambda folder, names: [n for n in names if str(Path(folder) / n) in skipped or n == "__pycache__"])
    done = ask(tmp_path / "copy")
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0"


def test_a_broken_part_is_not_hidden(tmp_path):
    shutil.copytree(ROOT / "paperloom", tmp_path / "paperloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "paperloom" / "llm").mkdir()
    (tmp_path / "paperloom" / "llm" / "__init__.py").write_text("import a_package_that_is_missing\n")
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = ask(tmp_path)
    assert done.returncode and "a_package_that_is_missing" in done.stderr
