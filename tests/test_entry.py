"""The driver's contract."""

from __future__ import annotations

import subprocess
import sys

import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_name_registered_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_stands_without_the_corpus_operators(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name == 'segline.llm' or name.startswith('segline.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'pipeline' not in e.queries() and 't1_dedup_last' in e.queries() and e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=entry.__file__.rsplit("/", 1)[0])
