"""Every registered query beside its SQL twin, and the entry points."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

from chaffsieve.plans import registry
from tests.conftest import SMALL, same

registry.load()
REPO = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_matches_sql(spark, duck, name):
    same(registry.QUERIES[name](spark, SMALL), duck.sql(registry.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def test_entry_without_the_training_data_part(tmp_path):
    """The entry module imports where the subpackage and the pipeline are gone."""
    for name in ("chaffsieve", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(REPO / name) if name.endswith(".py") else None
    (tmp_path / "chaffsieve").mkdir()
    for p in (REPO / "chaffsieve").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "chaffsieve" / p.name).symlink_to(p)
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((REPO / "__spark_entry__.py").read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and 'flagship' in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": "/tmp"})
