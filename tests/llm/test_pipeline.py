"""corpus_pipeline: each stage against a plain version, and odd inputs through all of them."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import plain_classes

import corpus_pipeline as pipeline
from taskmill.llm import mixing, quality, queries

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = {"score": "double", "copies": "long", "low": "long", "before": "long", "rate": "long", "u": "long", "size": "long", "taken": "long", "_mix_at": "long", "_copy": "int", "_nd_key": "string", "_dc_key": "string", "class_id": "long", "part": "int", "label": "string"}


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Documents with rows that are odd: nulls, empty and long texts, copies, clashing columns."""
    d = str(tmp_path_factory.mktemp("world"))
    docs = queries.table(spark, SF, "documents").select(*[c.split()[0] for c in SCHEMA.split(", ")])
    item = queries.table(spark, SF, "benchmark").first().text
    odd = [(None, None, None, None, None), (None, "x", None, None, 1), (9001, "", "en", None, 0), (9002, "word " * 30_000, "en", "big", 150_000), (9003, f"before {item} after", "en", "src1", 9), (9004, f"before {item} after", "en", "src1", 9), (9005, None, "en", "src1", 0)]
    rows = docs.union(spark.createDataFrame(odd, SCHEMA)).union(docs.limit(5))
    for name, kind in EXTRA.items():
        rows = rows.withColumn(name, F.lit(1).cast(kind))
    rows.repartition(5).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        queries.table(spark, SF, t).write.parquet(f"{d}/{t}.parquet")
    return d


def key(r):
    return (r.doc_id, r.text, r.source)


def test_stages(spark, world):
    """Every stage's decisions, redone in plain Python on what the one before kept."""
    docs = queries.table(spark, world, "documents")
    before = docs.collect()
    weights = quality.train(docs, queries.table(spark, world, "labels"))
    for name, stage in pipeline.STAGES:
        docs = pipeline.written(stage(spark, docs, world), f"test-{name}")
        after = docs.collect()
        if name != "token_output":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")] + list(EXTRA)
            assert all(float(r[c]) == 1 for r in after for c in EXTRA)
        if name == "quality_classifier":
            scored = quality.score(queries.table(spark, world, "documents").select("doc_id", "text", "source"), weights)
            want = Counter(key(r) for r in scored.filter(F.col("score") >= quality.THRESHOLD).collect())
            assert Counter(map(key, after)) == want and len(after) < len(before)
        elif name == "minhash_near_dedup":
            classes = plain_classes([(r.doc_id, r.text, None) for r in before])
            assert Counter(r.doc_id for r in after if r.doc_id is not None) == Counter({c for _, c in classes if c is not None})
            assert set(map(key, after)) <= set(map(key, before)) and sum(r.doc_id is None for r in after) <= 2
        elif name == "benchmark_decontamination":
            import re

            words = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
            runs = lambda t: {tuple(w[i : i + 5]) for w in [words(t)] for i in range(len(w) - 4)}
            items = [runs(r.text) for r in queries.table(spark, world, "benchmark").collect()]
            clean = [r for r in before if not any(len(i & runs(r.text)) >= 0.8 * len(i) - 1e-9 for i in items)]
            assert Counter(map(key, after)) == Counter(map(key, clean)) and len(clean) < len(before)
        elif name == "source_mixing":
            size, taken = defaultdict(int), defaultdict(int)
            count = lambda t: len((t or "").split())
            for r in before:
                size[r.source] += count(r.text)
            for r in after:
                taken[r.source] += count(r.text)
            assert max(Counter(map(key, after)).values()) <= 2 * max(Counter(map(key, before)).values())
            goals = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(size.items()), "source string, source_size long")).collect()}
            most = max(count(r.text) for r in before)
            assert all(abs(taken[s] - goals[s]) <= 2 * most for s in goals) and set(map(key, after)) <= set(map(key, before))
        else:
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(queries.tokenizer_path())
            want, at = Counter(), 0
            ids = lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 2]
            for r in before:
                x = ids(r.text)
                want[r.doc_id, len(x), zlib.crc32(np.array(x, "<u4").tobytes())] += 1
                at += len(x)
            assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in after) == want
            placed = sorted(after, key=lambda r: r.start)
            assert [r.start for r in placed] == np.cumsum([0, *[r.n_tokens for r in placed]])[:-1].tolist() and at == sum(r.n_tokens for r in placed)
            known = [r.doc_id for r in placed if r.doc_id is not None]
            assert known == sorted(known)
        before = after


def test_runs_agree(spark, world):
    rows = [Counter(map(tuple, pipeline.run(spark, world).collect())) for _ in range(2)]
    assert rows[0] == rows[1] and rows[0]


def test_empty_tables(spark, world, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        queries.table(spark, world, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
