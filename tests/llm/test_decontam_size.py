from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from taskmill.llm import decontam
from taskmill.llm.common import text_of

WORDS = [f"w{i}" for i in range(4000)]


def held(text: str, item: str) -> tuple[int, int]:
    a, b = text.split(), item.split()
    k = min(5, len(b))
    cut = lambda x: {tuple(x[i : i + k]) for i in range(len(x) - k + 1)}
    return len(cut(b) & cut(a)), len(cut(b))


def test_text_with_very_many_items(spark):
    """One long text that holds hundreds of items, whole or with a word changed, some of them twice."""
    rng = np.random.default_rng(4)
    items = [" ".join(rng.choice(WORDS, rng.integers(6, 40))) for _ in range(700)]
    parts = []
    for i, item in enumerate(items[:600]):
        words = item.split()
        if i % 3 == 1:
            words[len(words) // 2] = "other"
        parts += [" ".join(words), *([item] if i % 50 == 0 else []), "between"]
    long = " ".join(parts)
    rows = [(1, long), (2, long), (3, items[650]), (None, "x " + items[0] + " y"), (4, None), (5, " ".join(WORDS))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "ikey": F.lit(2)})
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained_items(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect())
    want = Counter()
    for i, text in rows:
        for j, item in enumerate(items):
            k, n = held(text or "", item)
            if k >= np.ceil(0.8 * n - 1e-9):
                want[i, j, k, n] += 1
    assert got == want and sum(1 for r in want if r[0] == 1) > 400


def test_short_items_do_not_widen_other_lookups(spark):
    """Bounds are kept for each length of runs: items of a word or two change no lookup of runs of five."""
    rng = np.random.default_rng(5)
    items = [(i, " ".join(rng.choice(WORDS, 30))) for i in range(40)]
    text = spark.createDataFrame([(1, " ".join(rng.choice(WORDS, 3000)))], "tkey long, text string")
    keyed = decontam.with_shingles(text, text_of(text), "all", [1, 2, 5])
    runs = []
    for more in ([], [(100 + i, w) for i, w in enumerate(("w1", "w2 w3", "zzz", "q r"))]):
        item = decontam.sketches(spark.createDataFrame(items + more, "item_id long, text string"), 5, 0.8)
        runs.append(decontam.lookups(keyed, item, [5]).count())
        assert decontam.lookups(keyed, item, [1, 2]).count() > 0 or not more
    assert runs[0] == runs[1] < 0.75 * 2996
