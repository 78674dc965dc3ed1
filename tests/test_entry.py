"""The driver contract, with and without the optional subpackage, and the SQL oracles."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("files", [("__spark_entry__.py", "corpus_pipeline.py", "urlrisk"), ("__spark_entry__.py", "urlrisk")])
def test_imports_without_the_optional_parts(tmp_path, files):
    """With the subpackage deleted, whether the pipeline's file is still there or not."""
    for name in files:
        src = REPO / name
        if src.is_dir():
            shutil.copytree(src, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif src.exists():
            shutil.copy(src, tmp_path / name)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'verify_urls' in q and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q); print(len(q))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 50


def test_other_import_errors_are_raised(tmp_path):
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    shutil.copytree(REPO / "urlrisk", tmp_path / "urlrisk", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "urlrisk/llm").mkdir()
    (tmp_path / "urlrisk/llm/registry.py").write_text("import a_module_that_is_nowhere")
    out = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "a_module_that_is_nowhere" in out.stderr


@pytest.mark.skipif(not DATA.exists(), reason="needs the generated tables")
@pytest.mark.parametrize("name", ["verify_urls", "registered_domain", "typosquat", "ioc_candidates", "campaign_rollup", "extract_urls"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = entry.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    want = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == cols
    rows = sorted(([r[names.index(c)] for c in cols] for r in want.fetchall()), key=str)
    assert sorted(([r[c] for c in cols] for r in df.collect()), key=str) == rows
