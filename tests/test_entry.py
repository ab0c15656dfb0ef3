"""The driver's contract, with and without the corpus subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__
from pagewright import registry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    names = __spark_entry__.queries()
    assert set(registry.QUERIES) <= set(names) and set(__spark_entry__.oracle_sql()) <= set(names)
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "text_md5", "n_blocks"] and df.count() > 0


@pytest.mark.parametrize("left", ["nothing", "pipeline", "broken"])
def test_without_the_corpus_subpackage(tmp_path, left):
    """Without both, without the folder alone, and with a package missing that it needs."""
    for name in ("__spark_entry__.py", "pagewright"):
        source = ROOT / name
        (shutil.copytree if source.is_dir() else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "pagewright" / "llm", ignore_errors=True)
    if left != "nothing":
        (tmp_path / "corpus_pipeline.py").write_text("from pagewright.llm import registry\n")
    if left == "broken":
        (tmp_path / "pagewright" / "llm").mkdir()
        (tmp_path / "pagewright" / "llm" / "__init__.py").write_text("import no_such_package\n")
    code = "import __spark_entry__ as e; q = e.queries(); assert 'doc_text' in q and 'pipeline' not in q and not any(n.startswith('op') and n[2].isdigit() for n in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
