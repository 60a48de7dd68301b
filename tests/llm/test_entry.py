"""What the entry and the bench name."""

import re

import __spark_entry__
import bench
import corpus_pipeline


def test_bench_takes_all_dealt_queries():
    dealt = {n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)}
    assert len(dealt) == 14 and dealt <= set(bench.HEADLINE)


def test_sql_is_given_for_known_queries_only():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources", "byte-level BPE"]
