import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_llm_folders(tmp_path):
    """The rest imports and registers its queries when those folders and the pipeline are gone."""
    for p in ROOT.iterdir():
        if p.name not in ("brindle", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "brindle").mkdir()
    for p in (ROOT / "brindle").iterdir():
        if p.name != "llm":
            (tmp_path / "brindle" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lit_eq' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_nothing_else_imports_llm():
    for p in (ROOT / "brindle").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"(import|from)\b.*\bllm\b", p.read_text())
