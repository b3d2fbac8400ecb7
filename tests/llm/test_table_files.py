"""Files of written tables and sets of crowded members in the search for near-duplicates."""

from __future__ import annotations

import os
from collections import Counter

from taskmill.llm import common, near_dup
from tests.llm.test_crowded import classes, crowd


def test_tables_of_few_rows_have_few_files(spark, monkeypatch):
    """A file costs more than its rows: 64 shuffle partitions, 6 files of a table of 1,000 rows at most."""
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "COMMON", 4)
    files, first = {}, common.written

    def written(df, name, *args):
        out = first(df, name, *args)
        files[name] = max(files.get(name, 0), sum(x.endswith(".parquet") for x in os.listdir(out.written_path.removeprefix("file://"))))
        return out

    monkeypatch.setattr(near_dup, "written", written)
    rows = crowd("common passages")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert Counter((r.doc_id, r.class_id) for r in got.collect()) == classes(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    bounded = {"near-nodes", "near-shared", "near-buckets", "near-pivots", "near-stars", "near-sets", "near-links", "parts", "near-open", "near-crowd", "near-rated", "near-named", "near-classes"}
    assert bounded <= set(files)
    assert all(files[name] <= max(6, spark.sparkContext.defaultParallelism) for name in bounded - {"parts"}), files
