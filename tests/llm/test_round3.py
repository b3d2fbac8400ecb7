import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from taskmill.llm import packing, queries, sort_means, spelling

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, id long, word string, n long, side int, sequence_id long"


def docs(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, -1, "x", -1, 5, 7) for i, t in rows], DOC)


@pytest.mark.parametrize("name", ["op11_spelling", "op13_clusters"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(got.columns)
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.fetchall())


# ---------------------------------------------------------------- spelling variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abé", min_size=2, max_size=7), max_size=40, unique=True), st.text("abé", min_size=2, max_size=7))
def test_automaton_finds_one_error(words, asked):
    words = sorted(words)
    auto = spelling.Automaton(words)
    assert auto.size[auto.start] == len(words)
    for cut in range(len(asked) + 1):
        got = {words[i] for i in auto.one_error(asked[:cut], asked[cut:])}
        rest = len(asked[:cut])
        assert got == {w for w in words if w[:rest] == asked[:rest] and near(w[rest:], asked[rest:])}


def test_automaton_is_minimal():
    auto = spelling.Automaton(sorted(a + b for a in ("", "x", "yy") for b in ("ing", "ings", "ed")))
    reach = set()
    state = [(s, e, tuple((k, t) for k, (t, _) in a.items())) for s, (e, a) in enumerate(zip(auto.ends, auto.arcs, strict=True))]
    for _, end, arcs in state:
        assert (end, arcs) not in reach
        reach.add((end, arcs))


def brute_groups(counts: dict[str, int]) -> dict[str, tuple]:
    form, out = {}, {}
    for w, n in counts.items():
        others = [x for x in counts if near(w, x)]
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
        out[w] = len(others)
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = form[w], root, counts[w], out[w], counts.get(form[w])
    return out


@pytest.mark.parametrize("entries", [spelling.ENTRIES, 7])
def test_spelling_groups_with_hot_halves(spark, entries, monkeypatch):
    """Words that share a half by the hundred, in groups that are parted or not."""
    rng = np.random.default_rng(5)
    words = {"ma" + "".join(rng.choice(list("abcü"), rng.integers(3, 6))) for _ in range(250)} | {"".join(rng.choice(list("ab"), rng.integers(3, 6))) + "tion" for _ in range(60)} | {"a" * k for k in (5, 6, 7)}
    counts = {w: int(n) for w, n in zip(sorted(words), rng.zipf(1.3, len(words)).clip(1, 5000) + 2, strict=True)}
    monkeypatch.setattr(spelling, "ENTRIES", entries)
    asked = spelling.near_words(spark.createDataFrame(list(counts.items()), "word string, n long"), entries)
    want = brute_groups(counts)
    assert {r.word: r.n_near for r in asked.collect()} == {w: v[3] for w, v in want.items() if v[3]}
    if entries == 7:
        monkeypatch.setattr(spelling.near_words, "__defaults__", (7,))
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
    assert got == want


def test_words_of_odd_texts(spark):
    long = "b" * 30_000
    rows = [(1, None), (2, ""), (None, "Wörter wörter WÖRTER"), (3, f"{long} {long} {long}c {long} {long}c {long}c"), (4, "hello hello Hello hallo"), (4, "hello hello Hello hallo"), (5, "ab cd ÀÉÿ×÷ ÀÉÿ×÷ ÀÉÿ×÷ word1word")]

    def plain(rows):
        n = Counter()
        import re

        for i, t in rows:
            for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
                run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                if h % 97 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                n[run] += 1
        return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}

    for more in ([], [(i, "hello hallo hello") for i in range(300)]):
        got = {r.word: r.n for r in spelling.word_counts(docs(spark, rows + more)).collect()}
        assert got == plain(rows + more)
        grouped = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_table(docs(spark, rows + more)).collect()}
        assert grouped == brute_groups(got)
    assert spelling.group_table(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- packing


def check_packed(rows, ids_of, capacity, segments, loss_of=None, loss=None):
    """Every id in one piece, limits held, offsets without gaps; the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == {i for i, x in ids_of.items() if len(x)}
    for i, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.example_tokens == len(ids_of[i])
            assert np.frombuffer(r.ids, "<u4").tolist() == ids_of[i][at : at + r.length]
            at += r.length
        assert at == len(ids_of[i])
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and len(pieces) <= segments
        if loss_of:
            assert sum(sum(loss_of[r.id][r.start : r.start + r.length]) for r in pieces) <= loss
        total += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / max(1, total)


def test_packing_of_documents(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    odd = [(1, None), (2, ""), (3, " \n\t\r\x0b\x0c   "), (4, "word " * 30_000), (5, "It's a B'ob́ ÉÀ ΣΑΣ ﬁ １２ x́ ́y\n\n<|endoftext|>z <|start of|> 😀👍🏽 \x00\x1c\x85"), (6, "a" * 9000), (None, "no id")]
    rows = odd + [(10 + i, "some words of a text " * (i * 37 % 300)) for i in range(400)]
    model = Tokenizer.from_file(path)
    want = {i: [*e.ids, 1] for (i, _), e in zip(rows, model.encode_batch([t or "" for _, t in rows], add_special_tokens=False), strict=True)}
    for block, parts in ((packing.BLOCK_TOKENS, 1), (20_000, 3)):
        got = packing.pack_texts(docs(spark, rows).repartition(parts), path, block=block).collect()
        assert check_packed(got, want, 2048, packing.SEGMENTS) < 0.008
    twice = packing.pack_texts(docs(spark, [(1, "same text")] * 3), path).collect()
    assert sum(r.start == 0 for r in twice) == 3 and sum(r.length for r in twice) == 9 and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack_texts(docs(spark, []), path).count() == 0
    digest = packing.pack_table(docs(spark, rows), path).filter("doc_id = 4").orderBy("start").collect()
    assert [r.ids_crc32 for r in digest] == [zlib.crc32(np.array(want[4][r.start : r.start + r.length], "<u4").tobytes()) for r in digest]


def test_pieces_encode_as_whole_texts(spark):
    path = queries.tokenizer_path("word_bpe_49k.json")
    model, ours = Tokenizer.from_file(path), packing.SpaceEncoder(path)
    assert ours.parted and ours.fine
    rng = np.random.default_rng(9)
    marks = ["́", "̧", "Σ", "σ", "İ", "ß", "'s", "'", " ", " ", "\n", "\t", "\r", " ", " ", "\x0b", "\x1d", "​", "é", "e", "가", "ᆨ", "Å", "1", "٣", "½", "!", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "a", "B", "the", "ﬀ", "𝔸", "̈́", "क़"]
    texts = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(30_000)]
    import pyarrow as pa

    for lo, ids, counts in ours.runs(pa.array(texts)):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            assert ids[a:b].tolist() == model.encode(texts[lo + k], add_special_tokens=False).ids


@pytest.mark.parametrize("cut", [True, False])
def test_packing_of_instructions(spark, cut):
    """Limits on segments and on loss-bearing tokens that bind, too."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(600):
        n = int(rng.choice([1, 3, 20, 90, 400]) * rng.integers(1, 4))
        at = rng.integers(0, n + 1)
        rows.append((i, rng.integers(0, 50_000, n).tolist(), [bool(k >= at) for k in range(n)]))
    rows += [(600, None, None), (601, [], []), (602, [7] * 3000, [True] * 3000), (603, [8] * 700, None), (604, [9] * 5, [None] * 5)]
    loss_of = {i: [bool(v) for v in (m if m is not None else [True] * len(x or []))] for i, x, m in rows}
    frame = spark.createDataFrame(rows, "id long, ids array<bigint>, loss array<boolean>").repartition(2)
    got = packing.pack_examples(frame, packing.Packer(512, 8, 200, cut)).collect()
    check_packed(got, {i: x or [] for i, x, _ in rows}, 512, 8, loss_of, 200)
    if not cut:
        pieces = Counter(r.id for r in got)
        assert all(pieces[i] == 1 for i, x, _ in rows if x and len(x) <= 512 and sum(loss_of[i]) <= 200)
        # Hardly more sequences than first fit of the same pieces, longest first.
        needs = [np.array([r.length, 1, sum(loss_of[r.id][r.start : r.start + r.length])]) for r in got]
        bins = []
        for need in sorted(needs, key=lambda x: -x[0]):
            room = next((b for b in bins if (need <= b).all()), None)
            if room is None:
                bins.append(room := np.array([512, 8, 200]))
            room -= need
        assert len({r.sequence_id for r in got}) <= len(bins) * 1.05 + 2
    with pytest.raises(ValueError):
        packing.Packer(0)


# ---------------------------------------------------------------- clusters


def brute_clusters(rows, k, rounds):
    kept = [(i, np.floor(np.array(v, float) * 256).astype(np.int64)) for i, v in rows]
    first = sorted((x for x in kept if x[0] is not None), key=lambda x: (hashlib.sha256(f"2:{x[0]}".encode()).hexdigest(), x[1].tolist()))[:k]
    centre = np.array([v for _, v in first])
    points = np.array([v for _, v in kept])
    for r in range(rounds + 1):
        far = ((points[:, None] - centre[None]) ** 2).sum(2)
        near = far.argmin(1)
        if r < rounds:
            centre = np.array([points[near == c].sum(0) // (near == c).sum() if (near == c).any() else centre[c] for c in range(len(centre))])
    return Counter((i, int(c), int(d[c])) for (i, _), c, d in zip(kept, near, far, strict=True)), int(far.min(1).sum())


@pytest.mark.parametrize("kind", ["blobs", "ties"])
def test_sort_means(spark, kind):
    rng = np.random.default_rng(1)
    if kind == "blobs":
        points = (rng.normal(0, 40, (9, 8))[rng.integers(0, 9, 500)] + rng.normal(0, 1, (500, 8))).tolist()
    else:  # a coarse grid: equal distances, repeated rows, empty clusters
        points = (rng.integers(-1, 2, (300, 8)) / 2).tolist()
    rows = [(i // 2 if i % 50 == 0 else i, v) for i, v in enumerate(points)] + [(None, points[0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sort_means.sort_means(sort_means.whole_vectors(frame, size=8), 12, 4).collect()
    want, inertia = brute_clusters(rows, 12, 4)
    assert Counter((r.id, r.cluster, r.distance) for r in got) == want and {r.inertia for r in got} == {inertia}
    for r in got:
        assert r.cluster_inertia == sum(x.distance for x in got if x.cluster == r.cluster)


def test_assign_scans_less_and_finds_the_same():
    rng = np.random.default_rng(2)
    centre = rng.integers(-50, 50, (30, 6))
    rows = rng.integers(-60, 60, (2000, 6))
    far = ((rows[:, None] - centre[None]) ** 2).sum(2)
    for before in (np.zeros(2000, np.int64), far.argmin(1), rng.integers(0, 30, 2000)):
        near, least = sort_means.assign(rows, before, centre)
        assert (near == far.argmin(1)).all() and (least == far.min(1)).all()


def test_clusters_of_odd_tables(spark):
    kind = "vec_id long, embedding array<float>, label int, cluster int, distance long"
    good = [0.5] * 64
    rows = [(1, good), (2, None), (3, []), (4, [None] * 64), (5, [float("nan")] + good[1:]), (6, [float("inf")] + good[1:]), (7, good[1:]), (8, good + [1.0]), (9, [3e38] + good[1:]), (None, good), (1, good), (10, [-0.001] * 64)]
    made = spark.createDataFrame([(i, v, None, 9, -1) for i, v in rows], kind)
    got = sort_means.cluster_table(made).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0) for r in got) == [(False, 1), (False, 1), (False, 10), (True, 0)]
    assert all(r.distance == 0 and r.inertia == 0 for r in got)
    assert sort_means.cluster_table(made.limit(0)).count() == 0
    assert sort_means.cluster_table(made.filter("vec_id IS NULL")).count() == 0
    assert sort_means.whole_vectors(made).filter("id = 10").select(F.element_at("vector", 1)).first()[0] == -1
