import subprocess
import sys
import textwrap
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["cell", "value"] and df.count() == 720


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_works_without_the_llm_subpackage(tmp_path):
    """As after a deletion of the subpackage and of the pipeline."""
    (tmp_path / "meshlark").mkdir()
    for p in (ROOT / "meshlark").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "meshlark" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = f"import sys; sys.path.insert(0, {str(tmp_path)!r}); import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op1_') for k in e.queries()))"
    # the link's target folder must not come first on the path
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.returncode == 0, out.stderr
    n, has = out.stdout.split()[-2:]
    assert int(n) > 100 and has == "False"
