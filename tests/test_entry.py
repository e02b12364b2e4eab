import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_returns_rows(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "percent" in df.columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_imports_without_the_training_data_operators(tmp_path):
    for name in ("quire", "__spark_entry__.py", "bench.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "quire" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'a15_drift_report' in q and not any(n.startswith('op') for n in q) and 'pipeline' not in q; e.oracle_sql(); import bench"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120).returncode == 0


def test_nothing_else_imports_the_training_data_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "quire")):
        if os.path.basename(folder) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                assert "quire.llm" not in open(os.path.join(folder, name)).read()
