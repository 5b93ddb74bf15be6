"""Registered queries of the llm part on the small tables, the pipeline's stages on their own input, and the guard."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest
from oracle_check import compare, connect

import __spark_entry__ as entry
import corpus_pipeline
from txnwatch.llm import queries

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
COLUMNS = {
    "op1_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op4_licenses": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
    "op5_urls": {"page_id", "host", "path", "rule", "verdict"},
    "op6_neighbours": {"query_id", "rank", "vec_id", "score"},
    "op7_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_sharding": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    "op11_manifest": {"doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"},
    "op12_alignment": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13_quality": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, sf_dir, name):
    assert set(queries.QUERIES[name](spark, sf_dir).columns) >= COLUMNS[name]


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql_twin(spark, sf_dir, name):
    assert compare(entry.queries()[name](spark, sf_dir), connect(sf_dir), entry.oracle_sql()[name]) is None


def test_pipeline_stages_keep_columns(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, n = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns and 0.7 * n < docs.count() <= n
        n = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == n


def test_entry_without_the_part():
    code = ("import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries();"
            "assert 'pipeline' not in q and not any(k.startswith('op1_') for k in q) and len(q) > 50")
    code = code.replace("sys.modules['corpus_pipeline'] = None", "import importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n"
                        "    def find_spec(self, name, *a):\n        if name == 'corpus_pipeline' or name.startswith('txnwatch.llm'):\n"
                        "            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\n")
    subprocess.run([sys.executable, "-c", code.replace("; import __spark", "\nimport __spark")], cwd=ROOT, check=True)
