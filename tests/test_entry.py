"""The driver's contract."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["antecedent", "events", "support", "confidence"] and got.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_llm_folders(tmp_path):
    for name in ("__spark_entry__.py", "tiltmine"):
        source = os.path.join(HOME, name)
        shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__")) if os.path.isdir(source) else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'why_slow' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    env = {**os.environ, "PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_llm_folders():
    for folder, _, files in os.walk(os.path.join(HOME, "tiltmine")):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(os.path.join(folder, f)) as text:
                    assert "tiltmine.llm" not in text.read(), f
