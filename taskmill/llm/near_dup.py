"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taskmill.llm.common import drop_written, few, free_name, mix, shingles, string_parts, text_of, word_hashes, written

REGISTERS, ROWS, WORDS, SIMILARITY = 64, 4, 5, 0.8
#: Members of a bucket, and bytes of their shingles, that one task compares with each other; what
#: is larger is crowded.
BLOCK, BLOCK_BYTES = 512, 16 << 20
#: Further pivots that the members of crowded buckets are verified against.
PIVOTS = 2
#: Shingles of more members of crowded buckets than this are common, the others rare.
COMMON = 32
#: Shingles of a bucket's members that are looked up at once.
LOOKUP = 1 << 21
#: Rows with signatures, and with shingles that are to be compared, of a task at most, about.
SIGNED, COMPARED = 1 << 15, 1 << 11
_KEY_BITS = 48


def shingle_sets(data, offs, words: int):
    """(row, 48-bit shingle) of each distinct shingle of each row, in order."""
    h, row = shingles(*word_hashes(data, offs), words)
    key = np.sort((row.astype(np.uint64) << np.uint64(_KEY_BITS)) | (h >> np.uint64(64 - _KEY_BITS)))
    if not len(key):
        return np.zeros(0, np.int64), key
    key = key[np.append(True, key[1:] != key[:-1])]
    return (key >> np.uint64(_KEY_BITS)).astype(np.int64), key & np.uint64((1 << _KEY_BITS) - 1)


def prob_minhash(row, key, weight, n_rows: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, an array of n_rows x registers.

    Each element is a Poisson process whose rate is its weight; each arrival picks a
    register, which keeps the element that reached it first. An element ends once its next
    arrival is later than every register's, so that most end after one or two. The share of
    registers in which two signatures agree estimates their probability Jaccard similarity,
    which at equal weights is the Jaccard similarity of the sets. Rows without elements keep
    zeros.
    """
    best = np.full(n_rows * registers, np.inf)
    sig = np.zeros(n_rows * registers, np.uint32)
    t = np.zeros(len(row))
    state = mix(key + np.uint64(0x632BE59BD9B4E019))
    latest = np.full(n_rows, np.inf)
    while len(row):
        state = state + np.uint64(0x9E3779B97F4A7C15)
        x = mix(state)
        uniform = ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        t = t - np.log(uniform) / weight
        live = t < latest[row]
        if not live.all():
            row, key, weight, state, t, x = row[live], key[live], weight[live], state[live], t[live], x[live]
        slot = row * registers + (mix(x ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(best, slot, t)
        won = best[slot] == t
        sig[slot[won]] = (key[won] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = np.unique(row)
        latest[rows] = best.reshape(n_rows, registers)[rows].max(1)
    return sig.reshape(n_rows, registers)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each band of `rows` registers, different for different bands."""
    n, m = sig.shape
    x = np.tile(np.arange(m // rows, dtype=np.uint64) + np.uint64(1), (n, 1))
    for j in range(rows):
        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + sig[:, j::rows].astype(np.uint64))
    return x.view(np.int64)


def _signer(registers: int, rows: int, words: int):
    def sign(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("_text"))
            for lo, data, offs in string_parts(text):
                n = len(offs) - 1
                row, key = shingle_sets(data, offs, words)
                # Equal weights: bands then agree by the similarity that is verified.
                sig = prob_minhash(row, key, np.ones(len(row)), n, registers)
                has = np.bincount(row, minlength=n) > 0
                bands = band_keys(sig, rows)
                width = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, n),
                        pa.array([s.tobytes() if ok else None for s, ok in zip(sig, has, strict=True)], pa.binary()),
                        pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(np.where(has, width, 0))]).astype(np.int32), bands[has].reshape(-1)),
                    ],
                    ["_tid", "sig", "bands"],
                )

    return sign


def _shingler(words: int):
    def cut(batches):
        for batch in batches:
            for lo, data, offs in string_parts(batch.column(1)):
                n = len(offs) - 1
                row, key = shingle_sets(data, offs, words)
                edges = np.searchsorted(row, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array([key[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["nid", "set"])

    return cut


def alike(p: np.ndarray, q: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the threshold."""
    if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
        return False
    both = np.concatenate([p, q])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(p) + len(q) - shared) - 1e-9


def _verifier(similarity: float):
    def check(batches):
        for batch in batches:
            x, y = batch.column(2), batch.column(3)
            keep = pa.array([i for i in range(batch.num_rows) if alike(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), similarity)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], ["a", "b"])

    return check


def overlaps(sets: list, left: np.ndarray, right: np.ndarray):
    """Yield (i, js, count) for each i of left and each run js of right, whose sets have about
    LOOKUP elements; count(i) tells how many elements i shares with each of js."""
    run = np.cumsum([len(sets[j]) for j in right]) // LOOKUP
    for r in np.unique(run):
        js = right[run == r]
        known, flat = np.unique(np.concatenate([sets[j] for j in js]), return_inverse=True)
        flat = flat.reshape(-1).astype(np.int32)
        starts = np.cumsum([0, *(len(sets[j]) for j in js[:-1])])

        def count(i, known=known, flat=flat, starts=starts):
            held = np.zeros(len(known), np.uint8)
            at = np.minimum(np.searchsorted(known, sets[i]), len(known) - 1)
            held[at[known[at] == sets[i]]] = 1
            return np.add.reduceat(held[flat], starts, dtype=np.int64)

        for i in left:
            yield i, js, count


def _comparer(similarity: float, rows: int):
    """Links between members of a bucket that are in different components.

    Emits a link only if it joins what no link before it has joined, so that there are fewer
    links than members. A pair that shares an earlier band is left to that band's bucket.
    All other pairs are verified by their shingles.
    """

    def compare(key, table):
        nid, comp = table.column("nid").to_numpy(), table.column("comp").to_numpy()
        part, one, two = table.column("part").to_numpy(), key[1].as_py(), key[2].as_py()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(len(nid), -1)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        size = np.array([len(x) for x in sets])
        bands = band_keys(sig, rows)
        before = bands[:, : int(np.argmax(bands[0] == key[0].as_py()))]
        root = np.unique(comp, return_inverse=True)[1]
        left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
        a, b = [], []
        for i, js, count in overlaps(sets, left, right):
            open_ = root[js] != root[i]
            if one == two:
                open_ &= nid[js] > nid[i]
            open_ &= np.minimum(size[js], size[i]) >= similarity * np.maximum(size[js], size[i]) - 1e-9
            open_[open_] = ~(before[js[open_]] == before[i]).any(1)
            if not open_.any():
                continue
            shared = count(i)
            for j in js[open_ & (shared >= similarity * (size[js] + size[i] - shared) - 1e-9)]:
                if root[j] != root[i]:
                    a.append(nid[i])
                    b.append(nid[j])
                    root[root == root[j]] = root[i]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return compare


def _lister(batches):
    """Shingles of members as lists of longs."""
    for batch in batches:
        for lo, data, offs in string_parts(batch.column(2)):
            n = len(offs) - 1
            keys = pa.ListArray.from_arrays((offs >> 3).astype(np.int32), np.frombuffer(data.tobytes(), np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), keys], ["nid", "comp", "keys"])


def rated(members: DataFrame, similarity: float, rows: int | None = None) -> DataFrame:
    """What rare shingles tell of members (nid, comp, set): nid, comp, size, their rare shingles that
    others have too (rarest first), how many of those to look up, and whether dense or near.

    Let o = 2s / (1 + s) x the size, the least overlap with an equal or larger set at similarity s, and
    o' = s x the size, that with an equal or smaller one. A set with fewer than o common
    shingles shares a rare one with any larger set that it is alike to. In order of rarity, and
    with k = o (or o') less the common ones, at least 1, two alike sets that share a rare
    shingle share one of all but the last k - 1. Only a dense set (o common ones at least)
    can be alike without a rare one, to a near one (o' at least). Members that share no shingle are left out. rows: the shingles of all members.
    """
    items = members.select("nid", "comp", "set").mapInArrow(_lister, "nid bigint, comp bigint, keys array<bigint>").select("nid", "comp", F.size("keys").alias("size"), F.explode("keys").alias("key"))
    often = written(items.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-often", rows and rows // 2)
    known = items.join(often, "key").groupBy("nid", "comp", "size").agg(F.count_if(F.col("n") > COMMON).alias("common"), F.sort_array(F.collect_list(F.when(F.col("n") <= COMMON, F.struct("n", "key")))).alias("rare"))
    least = {"low": 2 * similarity / (1 + similarity), "high": similarity}
    for role, share in least.items():
        need = F.ceil(share * F.col("size") - 1e-6) - F.col("common")
        kept = F.col("size") - F.col("common") - F.greatest(need, F.lit(1)) + 1
        alone = F.col("size") - F.col("common") - F.size("rare")  # the rarest: no other member has them
        known = known.withColumn(f"{role}_take", F.greatest(kept - alone, F.lit(0)).cast("int")).withColumn("dense" if role == "low" else "near", need <= 0)
    return known.withColumn("rare", F.transform("rare", lambda r: r["key"]))


def sharing(known: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of rated() members of different components, of sizes that allow it, that share
    one of the rare shingles to look up: COMMON members at most have one, whatever their number."""

    def looked_up(role: str) -> DataFrame:
        return known.select(F.struct("size", "nid").alias(role), F.col("comp").alias(f"{role}_comp"), F.explode(F.slice("rare", F.lit(1), F.col(f"{role}_take"))).alias("key"))

    pairs = looked_up("low").join(looked_up("high"), "key").filter("low_comp != high_comp AND low < high").filter(F.col("low.size") >= similarity * F.col("high.size") - 1e-6)
    return pairs.select(F.least("low.nid", "high.nid").alias("a"), F.greatest("low.nid", "high.nid").alias("b")).distinct()


def _stars(edges: DataFrame) -> tuple[bool, int]:
    """Whether every u of edges (u, v) has one v, which is no u itself; the number of edges."""
    roles = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("into")).union(edges.select(F.col("v").alias("x"), F.lit(0), F.lit(1)))
    nodes = roles.groupBy("x").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    most, count = nodes.agg(F.max(F.col("out") + F.when(F.col("out") > 0, F.col("into")).otherwise(0)), F.sum("out")).first()
    return most in (None, 1), count or 0


def components(links: DataFrame, name: str = "parts", rows: int | None = None) -> DataFrame:
    """(node, comp) of every node of links (a, b): comp is the smallest node that it reaches.

    Alternates large-star and small-star contraction until only stars are left; each round is
    a written table, so no lineage grows and nothing is gathered on the driver but two numbers.
    What is joined is written first: then Spark may split a node that has most of the edges.
    rows: the most links that there can be.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name, rows)
    while not (found := _stars(edges))[0]:
        count = found[1]
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-least", 2 * count)
        # One row at most for each edge, so that repeats can wait for the end of the round.
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-low", count)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        edges = written(small, name, 2 * count)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def joined(comp: DataFrame, links: DataFrame, name: str = "parts", rows: int | None = None) -> DataFrame:
    """components() of the links behind comp and of further links together.

    Only what the further links join is contracted: its nodes are the components so far.
    """
    for end in ("a", "b"):
        links = links.join(comp.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp")), end, "left")
    over = components(links.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")), name, rows)
    over = over.select(F.col("node").alias("old"), F.col("comp").alias("new"))
    ours = comp.join(over, comp["comp"] == over["old"], "left").select("node", F.coalesce("new", "comp").alias("comp"))
    return ours.union(over.join(comp, over["old"] == comp["node"], "left_anti").select("old", "new"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = WORDS, registers: int = REGISTERS, rows: int = ROWS, id_col: str = "doc_id") -> DataFrame:
    """One row per row of docs: its id, text_id (of equal texts), class_id and keep_text.

    Rows are in a class if a chain of links joins them; a link stands between equal texts and
    between texts whose sets of `words`-word shingles have a Jaccard similarity of at least
    `similarity`. class_id is the smallest id in the class (null if all are null),
    keep_text whether the row's text is the class's first (see first_of_classes).

    Equal texts are one node (by 128-bit digest). Each node gets a ProbMinHash signature of its
    distinct shingles, all of weight 1, so that a register agrees with the probability of the
    Jaccard similarity, however often a shingle is repeated in one text; and a key for each
    band of `rows` registers. Within a
    bucket, every member is first verified against the bucket's pivot, the member that shares
    buckets with most others: a row per member and band, whatever the bucket's size. Buckets
    whose members are then in one component, or that have two members, need no more. In others of up
    to BLOCK members and BLOCK_BYTES of shingles, members of different components are all verified
    with each other by one task. Members of larger ones are verified against PIVOTS more
    pivots; then pairs that share a rare shingle are (see rated); and what could be alike without
    one, dense and near members, in blocks of bounded size. No bucket is capped and no link
    of a bucket's members is left out. Joins of texts and shingles are by shuffle at every size.
    What is known of each bucket or class (a narrow row) is a table of its own before it is joined
    to the members, so that adaptive execution can split a hot one over many tasks. The number of rows of docs
    and that of members of shared buckets bound these tables, and so their files (see written).

    Words are runs of letters, digits and characters beyond ASCII, in lower case (A-Z). A
    text of fewer words has one shingle of all its words; a text without words is linked
    only to equal texts. A null text counts as the empty text. Null ids are allowed; repeated
    rows are copies. Other columns don't matter.
    """
    rows_in = docs.select(F.col(id_col).alias("id"), F.md5(text_of(docs)).alias("_tid"), text_of(docs).alias("_text"))
    total = docs.count()
    signed = rows_in.select("_tid", "_text", "id").drop("id").mapInArrow(_signer(registers, rows, words), "_tid string, sig binary, bands array<bigint>")
    nodes = signed.groupBy("_tid").agg(F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()), "near-nodes", total, SIGNED)
    every = nodes.select("nid", F.explode("bands").alias("bkey"))
    shared = written(every.groupBy("bkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "near-shared", total * (registers // rows))
    entries = written(every.join(shared, "bkey"), "near-buckets", total * (registers // rows))
    most = entries.count()
    degree = entries.groupBy("nid").agg(F.sum("n").alias("degree"))
    ranked = entries.join(degree, "nid").groupBy("bkey").agg(F.max(F.struct("degree", (-F.col("nid")).alias("minus"))).alias("top"))
    pivots = written(ranked.select("bkey", (-F.col("top.minus")).alias("pivot")), "near-pivots", most)
    stars = entries.join(pivots, "bkey").filter("nid != pivot").select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).distinct()
    stars = written(stars, "near-stars", most)

    wanted = nodes.select("_tid", "nid").join(entries.select("nid").distinct(), "nid", "left_semi")
    # Copies of a text are one row before they are shuffled.
    texts = rows_in.groupBy("_tid").agg(F.first("_text").alias("_text")).join(written(wanted, "near-wanted", most).hint("merge"), "_tid")
    texts = few(texts.select("nid", "_text"), total, COMPARED)
    sets = written(texts.mapInArrow(_shingler(words), "nid bigint, set binary").withColumn("bytes", F.octet_length("set")), "near-sets")

    def verified(pairs: DataFrame, name: str, sets: DataFrame, count: int) -> DataFrame:
        """The alike ones of pairs (a, b); count: the most that pairs or sets can have."""
        one, two = sets.select(F.col("nid").alias("a"), F.col("set").alias("x")), sets.select(F.col("nid").alias("b"), F.col("set").alias("y"))
        both = pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "x", "y")
        return written(few(both, count, COMPARED).mapInArrow(_verifier(similarity), "a bigint, b bigint"), name)

    links = verified(stars, "near-links", sets, most)
    comp = components(links, rows=most)

    def still_open(comp: DataFrame) -> DataFrame:
        """(bkey, nid, comp, parts) of the buckets whose members are in several components."""
        left = entries.join(comp, entries["nid"] == comp["node"], "left").select("bkey", "nid", F.coalesce("comp", "nid").alias("comp"))
        size = left.join(sets.select("nid", "bytes"), "nid").groupBy("bkey").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
        keys = size.filter("lo != hi AND n > 2").select("bkey", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("parts"))
        return written(left.join(written(keys, "near-open-keys", most), "bkey"), "near-open", most)

    def compared(members: DataFrame) -> DataFrame:
        """Links of members (bkey, nid, comp, sig, set, part, one, two, left, right), by blocks."""
        return members.groupBy("bkey", "one", "two", "left", "right").applyInArrow(_comparer(similarity, rows), "a bigint, b bigint")

    opened = still_open(comp)
    crowded = opened.filter("parts > 1")
    # What is known of crowded members is a table of its own, so that their steps don't shuffle all sets.
    ids = written(crowded.select("nid").distinct(), "near-crowd-ids", most)
    held = ids.count()
    if held:
        few_sets = sets.join(ids, "nid", "left_semi").join(nodes.select("nid", "sig").join(ids, "nid", "left_semi"), "nid")
        few_sets = written(few(few_sets, total, COMPARED), "near-crowd")
    for again in range(PIVOTS):
        if crowded.isEmpty():
            break
        pivot = crowded.groupBy("bkey").agg(F.min(F.struct(F.xxhash64("nid", F.lit(again)).alias("h"), "nid", "comp")).alias("p"))
        pivot = written(pivot.select("bkey", F.col("p.nid").alias("pivot"), F.col("p.comp").alias("pivot_comp")), "near-pivots", most)
        pairs = crowded.join(pivot, "bkey").filter("comp != pivot_comp").select(F.least("nid", "pivot").alias("a"), F.greatest("nid", "pivot").alias("b")).distinct()
        comp = written(joined(comp, verified(written(pairs, "near-stars", most), "near-links", few_sets, most), rows=most), "near-comp", 2 * most)
        opened = still_open(comp)
        crowded = opened.filter("parts > 1")
    none = F.lit(0)
    alone = opened.filter("parts = 1").select("bkey", "nid", "comp", none.alias("part"), none.alias("one"), none.alias("two"), none.alias("left"), none.alias("right"))
    more = few(compared(alone.join(nodes.select("nid", "sig"), "nid").join(sets.select("nid", "set").hint("merge"), "nid")), most, COMPARED)
    if held and not crowded.isEmpty():
        members = crowded.select("nid", "comp").distinct().join(few_sets, "nid")
        count, size = members.agg(F.count(F.lit(1)), F.sum("bytes")).first()
        members = members.select("nid", "comp", "set")
        known = written(rated(few(members, held, COMPARED), similarity, size // 8), "near-rated", count, COMPARED)
        pairs = written(sharing(known, similarity), "near-sharing")
        more = more.union(verified(pairs, "near-links", few_sets, max(held, pairs.count())))
        # Dense members (part 0) against near ones (part 1), a block of either to a task.
        roles = known.select("nid", F.explode(F.filter(F.array(F.when(F.col("dense"), 0), F.when(F.col("near"), 1)), lambda r: r.isNotNull())).alias("part"))
        cast = crowded.join(roles, "nid").select("bkey", "nid", "comp", "part", "parts")
        share = cast.join(few_sets.select("nid", "bytes"), "nid").groupBy("bkey", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
        blocks = share.groupBy("bkey").agg(F.max(F.when(F.col("part") == 0, F.col("blocks"))).alias("lefts"), F.max(F.when(F.col("part") == 1, F.col("blocks"))).alias("rights"))
        cast = cast.join(written(blocks.filter("lefts IS NOT NULL"), "near-blocks", most), "bkey")
        own = F.pmod(F.xxhash64("nid"), F.when(F.col("part") == 0, F.col("lefts")).otherwise(F.col("rights"))).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.when(F.col("part") == 0, F.col("rights")).otherwise(F.col("lefts")) - 1))
        cast = cast.withColumn("own", own).withColumn("other", other)
        left, right = F.when(F.col("part") == 0, F.col("own")).otherwise(F.col("other")), F.when(F.col("part") == 0, F.col("other")).otherwise(F.col("own"))
        cast = cast.select("bkey", "nid", "comp", "part", F.lit(0).alias("one"), F.lit(1).alias("two"), left.alias("left"), right.alias("right"))
        more = more.union(compared(cast.join(few_sets.select("nid", "sig", "set"), "nid")))
    comp = joined(comp, written(more, "near-links2"))
    drop_written(entries, stars, sets, opened)  # the wide tables that only verification reads

    by_text = rows_in.groupBy("_tid").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    named = by_text.join(nodes.select("_tid", "nid"), "_tid").join(comp, F.col("nid") == comp["node"], "left")
    named = written(named.select("_tid", "first_id", F.coalesce("comp", "nid").alias("comp")), "near-named", total)
    # The class's first text: the smallest id, ids before null, ties to the smaller digest.
    first = written(named.groupBy("comp").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), F.col("first_id").alias("class_id"), F.col("_tid").alias("keep"))).alias("f")), "near-first", total)
    classes = named.join(first, "comp").select("_tid", F.col("f.class_id").alias("class_id"), (F.col("f.keep") == F.col("_tid")).alias("keep_text"))
    classes = written(classes, "near-classes", total)
    drop_written(nodes)
    narrow = docs.select(F.col(id_col), F.md5(text_of(docs)).alias("_tid"))
    return narrow.join(classes, "_tid").select(id_col, F.col("_tid").alias("text_id"), "class_id", "keep_text")


def first_of_classes(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs with one row of each near-duplicate class: the one whose id is class_id.

    Repeated rows (same id and text) are kept once; of rows with null ids, one of the text
    that comes first.
    """
    found = near_duplicates(docs, id_col=id_col, **options).filter(F.col("keep_text") & F.col(id_col).eqNullSafe(F.col("class_id")))
    chosen = found.groupBy("text_id", "class_id").agg(F.count(F.lit(1)).alias("_nd_copies"))
    chosen = written(chosen.select(F.col("text_id").alias("_nd_text"), F.col("class_id").alias("_nd_class"), "_nd_copies"), "near-chosen")
    text, class_, copies = (free_name(docs, f"_nd_{x}") for x in ("text", "class", "copies"))
    chosen = chosen.toDF(text, class_, copies)
    key = free_name(docs, "_nd_key")
    keyed = docs.withColumn(key, F.md5(text_of(docs)))
    kept = keyed.join(chosen, (F.col(key) == F.col(text)) & keyed[id_col].eqNullSafe(chosen[class_]))
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = kept.filter(F.col(copies) == 1).select(*names)
    again = kept.filter(F.col(copies) > 1).dropDuplicates([key, id_col]).select(*names)
    return once.unionByName(again)
