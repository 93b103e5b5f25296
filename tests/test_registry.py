"""What the driver reads: the flagship query and the registries, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as registry
from seqlake.plans import queries as kv

ROOT = Path(__file__).resolve().parent.parent


def test_flagship_query(spark):
    frame = registry.entry(spark)
    assert frame.columns == ["key", "value", "seq"] and frame.count() == 4


def test_registries_agree():
    assert set(kv.queries()) == set(kv.oracle_sql())
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(kv.queries()) <= set(registry.queries())


def test_the_engine_stands_alone():
    """Without seqlake.llm and corpus_pipeline all other queries are there."""
    code = (
        "import sys; sys.modules['seqlake.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; from seqlake.plans import queries as kv\n"
        "import seqlake.store, seqlake.shell, seqlake.sources.binary, seqlake.streaming.ingest\n"
        "assert set(e.queries()) == set(kv.queries()) == set(e.oracle_sql())"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
    assert not [p for p in (ROOT / "seqlake").rglob("*.py") if "llm" not in p.parts and "seqlake.llm" in p.read_text()]
