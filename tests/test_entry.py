"""The entry module: its names agree, and it works without the llm folders."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_query(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_imports_without_llm(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q); e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env=env)


def test_nothing_else_imports_llm():
    for top, _, names in os.walk(os.path.join(REPO, "brindle")):
        if os.path.basename(top) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(top, name)) as f:
                    assert "brindle.llm" not in f.read(), name
