"""The quality classifier against plain versions of its features, its updates and its scores."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from taskmill.llm import common, quality, queries

TEXTS = ["The cat sat. The cat sat on a MAT 12 times!", "", "  \n", "Spam spam spam spam BUY now 99% off!!! buy", "één wörd", "a", "x y x y x y x z", "Ab1-cd2 " * 40]


def plain_features(text):
    """Name of n-gram: square root of its count, over the length of them all."""
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    shape = lambda w: re.sub(r"(.)\1*", r"\1", re.sub(r"[a-z]|[^\x00-\x7f]", "a", re.sub(r"[A-Z]", "A", re.sub(r"[0-9]", "0", w))))
    shapes = [shape(w) for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    n = Counter(("w", w) for w in words) + Counter(("s", s) for s in shapes)
    for lag in (1, 2, 3):
        n[("again", lag)] += sum(a == b for a, b in zip(words, words[lag:], strict=False))
    n += Counter(("ww", *x) for x in zip(words, words[1:], strict=False)) + Counter(("ss", *x) for x in zip(shapes, shapes[1:], strict=False))
    n += Counter(("sss", *x) for x in zip(shapes, shapes[1:], shapes[2:], strict=False))
    n = +n
    length = math.sqrt(sum(n.values()))
    return {k: math.sqrt(v) / length for k, v in n.items()}


def hashed(texts):
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    row, at, value = quality.features(np.frombuffer(b"".join(raw), np.uint8), offs)
    out = [defaultdict(float) for _ in texts]
    for r, a, v in zip(row.tolist(), at.tolist(), value.tolist(), strict=True):
        out[r][a] += v
    return out


def test_features_equal_plain_ones():
    plain, mine = [plain_features(t) for t in TEXTS], hashed(TEXTS)
    for p, m in zip(plain, mine, strict=True):
        assert np.allclose(sorted(p.values()), sorted(m.values()))
    for i in range(len(TEXTS)):
        for j in range(i):  # texts share just the n-grams that they share by name
            dot = lambda x, y: sum(v * y[k] for k, v in x.items() if k in y)
            assert dot(plain[i], plain[j]) == pytest.approx(dot(mine[i], mine[j]))


def test_updates_equal_plain_ones():
    rng = np.random.default_rng(4)
    model = quality.FTRL(bits=6)
    alpha, beta, l1, l2 = model.alpha, model.beta, model.l1, model.l2
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(300):
        at = rng.choice(64, int(rng.integers(0, 9)), replace=False)
        value, label = rng.random(len(at)), int(rng.random() < 0.4)
        x = dict(zip(at.tolist(), value.tolist(), strict=True)) | {64: 1.0}

        def weight(i):
            return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

        w = {i: weight(i) for i in x}
        p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in x.items())))
        for i, v in x.items():
            g = (p - label) * v
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i], n[i] = z[i] + g - sigma * w[i], n[i] + g * g
        model.update(at, value, label)
    assert np.allclose(model.z, [z[i] for i in range(65)]) and np.allclose(model.weights(), [weight(i) for i in range(65)])


def test_scores_equal_plain_ones(spark):
    rng = np.random.default_rng(5)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.score for r in quality.score(df, weights).collect()}
    for i, x in enumerate([*hashed(TEXTS), {}]):
        assert got[i] == pytest.approx(1 / (1 + math.exp(-(sum(weights[a] * v for a, v in x.items()) + weights[-1]))), rel=1e-5)


def test_held_out_labels_are_never_learnt(spark):
    """Labels of held-out rows may be anything: the weights stay."""
    sf = "/root/testdata/sf0.001"
    d, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one = quality.train(d, labels)
    assert one.any() and (one == quality.train(d, turned)).all()


def test_accepted_keeps_all_columns(spark):
    d = queries.table(spark, "/root/testdata/sf0.001", "documents").withColumn("score", F.col("doc_id") * 2.5).withColumn("_quality_text", F.lit("mine")).withColumn("_Quality_Score", F.lit(7))
    labels = queries.table(spark, "/root/testdata/sf0.001", "labels")
    kept = quality.accepted(d, labels)
    assert kept.columns == d.columns
    rows = kept.collect()
    assert 0 < len(rows) <= d.count() and all((r.score, r._quality_text, r._Quality_Score) == (r.doc_id * 2.5, "mine", 7) for r in rows)
    weights = quality.train(d, labels)
    assert {r.doc_id for r in rows} == {r.doc_id for r in quality.score(d.select("doc_id", "text"), weights).filter(F.col("score") >= quality.THRESHOLD).collect()}


def test_a_row_without_an_id_is_not_held_out(spark, tmp_path):
    d = queries.table(spark, "/root/testdata/sf0.001", "documents")
    d.limit(30).union(d.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).write.parquet(f"{tmp_path}/documents.parquet")
    queries.table(spark, "/root/testdata/sf0.001", "labels").write.parquet(f"{tmp_path}/labels.parquet")
    rows = queries.op2_quality(spark, str(tmp_path)).collect()
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False] and len(rows) == 32


def test_names_that_are_free(spark):
    df = spark.createDataFrame([(1, 2)], "x int, _X int")
    assert common.free_name(df, "x") == "__x" and common.free_name(df, "y") == "y"
