"""Near-duplicates in buckets that are too large for one task."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from taskmill.llm import near_dup, quality


def shingles(text: str) -> set:
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def classes(rows) -> Counter:
    """By all pairs of texts."""
    head = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]

    def root(i):
        while head[i] != i:
            i = head[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            x, y = root(i), root(j)
            if x != y:
                shared = len(a & b)
                if shared >= 0.8 * (len(a) + len(b) - shared) - 1e-9:
                    head[max(x, y)] = min(x, y)
    return Counter((i, root(i)) for i, _ in rows)


def crowd(kind: str, n: int = 150) -> list[tuple[int, str]]:
    """Texts of one template: apart from each other, about as alike as the threshold, or
    made of passages that all share, so that nearly every shingle is common."""
    rng = np.random.default_rng(len(kind))
    template = [f"t{x}" for x in range(200)]
    passages = [[f"p{k}x{x}" for x in range(40)] for k in range(8)]
    rows = []
    for i in range(n):
        if kind == "apart":
            text = template + [f"own{i}x{x}" for x in range(30 + i % 3)]
        elif kind == "threshold":
            text = template[: 196 - i % 4] + [f"own{i % 60}y{i % 5}x{x}" for x in range(20 + int(rng.integers(0, 8)))]
        else:
            text = [w for k in sorted(rng.choice(8, 6, replace=False)) for w in passages[k][: 40 - int(rng.integers(0, 5))]]
        rows.append((i, " ".join(text)))
    return rows


@pytest.mark.parametrize("kind", ["apart", "threshold", "common passages"])
def test_crowded_buckets_lose_no_link(spark, monkeypatch, kind):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "COMMON", 4)
    rows = crowd(kind)
    seen = []
    first = near_dup.rated

    def rated(*args):
        out = first(*args)
        seen.append(out.agg({"dense": "max"}).first()[0])
        return out

    monkeypatch.setattr(near_dup, "rated", rated)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == classes(rows)
    if kind == "apart":
        assert seen  # the members stay apart, by rare shingles


def test_blocks_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 10_000)
    rows = crowd("threshold", 60)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter((r.doc_id, r.class_id) for r in got.collect()) == classes(rows)


@pytest.mark.parametrize("similarity", [0.6, 0.8, 0.9])
def test_pairs_of_rare_shingles_and_dense_members_hold_all_links(spark, monkeypatch, similarity):
    monkeypatch.setattr(near_dup, "COMMON", 3)
    rng = np.random.default_rng(9)
    pool = [np.sort(rng.choice(10**6, 60, replace=False)) for _ in range(10)]
    sets = [np.unique(np.concatenate([rng.choice(pool[i % 10], int(rng.integers(45, 61)), replace=False), rng.integers(0, 10**6, int(rng.integers(0, 14)))])).astype(np.int64) for i in range(80)]
    frame = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in enumerate(sets)], "nid long, comp long, set binary")
    known = near_dup.rated(frame, similarity).cache()
    pairs = {(r.a, r.b) for r in near_dup.sharing(known, similarity).collect()}
    role = {r.nid: r for r in known.select("nid", "dense", "near").collect()}
    for i in range(80):
        for j in range(i):
            if near_dup.alike(sets[j].view(np.uint64), sets[i].view(np.uint64), similarity):
                low, high = sorted((i, j), key=lambda x: (len(sets[x]), x))
                assert (j, i) in pairs or role[low].dense and role[high].near


def test_training_rows_in_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"{'good' if i % 2 else 'bad'}{x}" for x in rng.integers(0, 30, int(rng.integers(0, 200))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    whole = quality.train(docs, labels)
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert whole.any() and (quality.train(docs, labels) == whole).all()
    # As many updates as rows in each epoch, in order of the hash of their ids.
    order = [r.doc_id for r in docs.selectExpr("doc_id", "xxhash64(doc_id) AS h", "crc32(CAST(doc_id AS STRING)) % 5 AS fold").filter("fold != 0").orderBy("h", "doc_id").collect()]
    model = quality.FTRL()
    text = dict(rows)
    for _ in range(2):
        for i in order:
            raw = text[i].encode()
            _, at, value = quality.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            model.update(at, value.astype(np.float32).astype(np.float64), i % 2)
    assert np.array_equal(model.weights().astype("<f4"), whole)
