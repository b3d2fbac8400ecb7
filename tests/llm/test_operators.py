import hashlib
import io
import os
import zipfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from taskmill.llm import ann, common, decontam, eod_scan, license_scan, mixing, near_dup, pii, quality, queries, token_codec, warc_zip

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, class_id long, copies long, size long, key string, label string"


def docs(spark, rows):
    """documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, None, s, None, None, -1, None, None, None, None) for i, t, s in rows], DOC)


ODD = [(1, None, None), (2, "", "a"), (3, " \n\t ", "a"), (None, "x", None), (4, "word " * 30_000, "b"), (5, "same text of seven words it is", "b"), (5, "same text of seven words it is", "b"), (6, "same text of seven words it is", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return docs(spark, []).cache()


@pytest.mark.parametrize("name", ["op1_mix_sources", "op5_warc", "op8_license_scan", "op9_decontaminate"])
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*names).collect()
    key = lambda r: tuple(round(x, 9) if isinstance(x, float) else x for x in r)
    assert Counter(map(key, got)) == Counter(map(key, want.fetchall()))


def test_mixing(spark, odd, none):
    out = mixing.mix_sources(mixing.sized(odd, "size"), "size").collect()
    assert len(out) == len(ODD) and all(r.taken <= 2 * r.size and r.taken == r.copies * r.size for r in out)
    assert mixing.mix_sources(mixing.sized(none, "size"), "size").count() == 0
    rows = [(i, "w " * (i * 7919 % 40 + 1), f"s{min(i % 5, 2)}" if i % 7 else None) for i in range(3000)]
    got = [mixing.mix_sources(mixing.sized(docs(spark, rows).repartition(n), "size"), "size").collect() for n in (3, 5)]
    assert Counter((r.doc_id, r.taken) for r in got[0]) == Counter((r.doc_id, r.taken) for r in got[1])
    by = defaultdict(list)
    for r in got[0]:
        by[r.source].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 2 * 40 and rs[0].target <= 2 * rs[0].source_size
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * sum(r.size for r in got[0])) < 1e-3
    again = mixing.repeated(mixing.mix_sources(mixing.sized(docs(spark, rows), "size"), "size"), ["doc_id"])
    assert again.count() == sum(r.copies for r in got[0])


def test_quality(spark, odd, none):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    weights = quality.train(d, labels)
    held = quality.score(d, weights).join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string")) % 5 == 0).select("score", "quality").collect()
    good, bad = [r.score for r in held if r.quality], [r.score for r in held if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert (np.array(good) >= 0.3).mean() > 0.98
    got = quality.score(odd, weights)
    assert got.count() == len(ODD) and got.filter("score BETWEEN 0 AND 1").count() == len(ODD) and sorted(got.columns) == sorted(odd.columns)
    assert quality.score(none, weights).count() == 0
    assert not quality.train(none, labels).any() and not quality.train(odd, labels.limit(0)).any()


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    import re

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or kind == "card" and 16 <= len(d) <= 19 and pii.luhn(d.encode()) or kind == "phone" and 8 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii(spark, odd, none):
    rng = np.random.default_rng(3)
    bits = ["a@b.c", "é", "1.2.3.4", "999.1.1.1", "+1 (555) 010-9999", "4111 1111 1111 1111", "4111-1111-1111-1112", "@", ".", "+", "1", " ", "-", "x@y@z.de", "0", "a.b", "\n", "ü+49 30 1234567"]
    texts = ["".join(rng.choice(bits, rng.integers(1, 12))) for _ in range(400)] + ["9" * 50_000, "1.1" * 9000, "a@" * 9000, "+1" * 5000]
    rows = {r.doc_id: r for r in pii.find_pii(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    for i, t in enumerate(texts):
        want = plain_spans(t)
        assert rows[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), t[:80]
        assert set(want) <= set(rows[i].spans.split(",")) and rows[i].n_email == sum(w.startswith("email") for w in want)
    assert pii.find_pii(odd).count() == len(ODD) and pii.find_pii(none).count() == 0
    t = 'my token = "473a0a5afa59a0df9c0d8d3cd5867fe7054a91c7" and a 2024-01-02 date'
    row = pii.find_pii(docs(spark, [(1, t, None), (2, "plain words at the house. No one.", None)])).orderBy("doc_id").collect()
    assert row[0].spans.startswith("secret:") and row[1].spans == ""
    assert all(r.n_spans == len([x for x in r.spans.split(",") if x]) and r.n_secret == r.spans.count("secret:") for r in [*rows.values(), *row]) and row[0].n_secret == 1
    assert "<secret>" in pii.redacted(docs(spark, [(1, t, None)])).first().text


def test_added_spans_have_no_caps_or_gates(spark):
    key = "qWzXvTnRkLpMbGfHdJsCyUeIoAqWzXvT"
    local, label = "ab12" * 30, "cd34" * 20
    texts = [f"my secret key: {key} as above", f"write to {local} at {label} dot org today", "host fe:dc:ba:fe:ca:fd:ab:ef up", "plain words of a clean document, with none"]
    rows = {r.doc_id: r.spans for r in pii.find_pii(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert rows[0] == f"secret:15:{15 + len(key)}" and rows[3] == ""
    # Proposed whole, whatever the score.
    assert (0, 9, 9 + len(local) + 4 + len(label) + 8) in pii.candidates(texts[1].encode()) and any(k == 1 for k, *_ in pii.candidates(texts[2].encode()))


def test_added_spans_recall_and_precision():
    """Spans planted in sentences, from another seed than the training's: against what was planted."""
    trees, limits = pii.model()
    rng = np.random.default_rng(99)
    hit, wrong, good = Counter(), Counter(), Counter()
    for kind, span, before, after, label in pii._examples(rng, 1500):
        text = b"some words. " + before + span + after + b" and more."
        lo = 12 + len(before)
        base, every = pii.find_spans(text, trees, limits)
        found = any(a < lo + len(span) and b > lo for _, a, b in every)
        good[kind] += label
        hit[kind] += label and found
        wrong[kind] += not label and any(a < lo + len(span) and b > lo for _, a, b in every[len(base) :])
    assert all(hit[k] >= 0.85 * good[k] for k in range(5)), (hit, good)
    assert sum(hit.values()) >= 0.9 * sum(good.values()) and sum(wrong.values()) <= 0.05 * sum(hit.values()), (hit, wrong, good)


def test_long_secrets_are_spanned_whole(spark):
    key = "".join(hashlib.sha256(str(i).encode()).hexdigest() for i in range(20))
    d = docs(spark, [(1, f'my token = "{key}" ends', None)])
    assert f"secret:12:{12 + len(key)}" in pii.find_pii(d).first().spans.split(",")
    assert pii.redacted(d).first().text == 'my token = "<secret>" ends'


def encoded(encoder, texts):
    out = []
    for _, ids, counts in encoder.runs(pa.array(texts, pa.string())):
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("plain", [True, False])
def test_pieces_are_encoded_as_whole_texts(plain):
    """Cuts change no ids: against the library on whole texts, with small runs and a small memory."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    model.encode_special_tokens = plain
    rng = np.random.default_rng(8)
    bits = ["a", "b", "word", "Z", "é", "ß", "×", "÷", "ɐ", "ﬁ", "中", "слово", "한", "हि", "́", "😀", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x85", "\xa0", "　", "​", "\x1c", "\x1f", "\0", "\x7f", "'", "'s", "'re", "'ll", "''", '"', ",", ".", "(", ")", "…", "“", "1", "23", "½", "५", "-", "_", "<|endoftext|>", "<|", "|>"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(5000)] + ["", "word " * 3000, "x" * 9000]
    want = [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]
    mine = common.Encoder(queries.tokenizer_path(), most=2000, run_bytes=3000, plain=plain)
    assert encoded(mine, texts) == want == encoded(mine, texts)


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(Exception, match="do not fit"):
        eod_scan.token_counts(docs(spark, [(1, "a", None)]), queries.tokenizer_path(), kind="u1").count()


def test_tokens(spark, odd, none, tmp_path):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    texts = [*["", " ", "a  b", "a\n b \n", "it 's", "é\x85 b.", "<|endoftext|> a", "words, words; and 12 more!"], *[r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(40).collect()]]
    plain = [model.encode(t, add_special_tokens=False).ids for t in texts]
    mine = common.Encoder(path)
    assert encoded(mine, texts) == plain == encoded(mine, texts)
    d = docs(spark, [(100 - i, t, None) for i, t in enumerate(texts)] + [(None, None, None)]).repartition(4)
    at, want = 0, {}
    for i, ids in [(None, [])] + [(100 - i, plain[i]) for i in reversed(range(len(texts)))]:
        want[i] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_codec.round_trip(d, path).collect()} == want
    counts = eod_scan.token_counts(d, path)
    assert {r.doc_id: r.n_tokens for r in counts.collect()} == {k: v[1] - 1 for k, v in want.items()}
    assert token_codec.round_trip(none, path).count() == 0 == eod_scan.token_counts(none, path).count()
    assert token_codec.round_trip(odd, path).count() == len(ODD) == eod_scan.token_counts(odd, path).count()


def test_token_files_hold_what_the_library_encodes(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path())
    e = "<|endoftext|>"
    texts = [f"a {e} b", e, f"{e} a", f"a{e}b, c{e}.", f"x  {e}  y\n{e}\n", f"{e}{e} {e}", f"({e}) '{e}' |{e}> ", "<|endoftext |> <|endof text|>", "plain words, as ever", ""] + [f"w{i} {e}{'.' * (i % 3)} w{i}{e} w" for i in range(50)]
    plain = [model.encode(t, add_special_tokens=False).ids for t in texts]
    assert plain[0] == [64, 220, 50256, 275]
    d = docs(spark, [(i, t, None) for i, t in enumerate(texts)])
    d.write.parquet(f"{tmp_path}/documents.parquet")
    at, want = 0, {}
    for i, ids in enumerate(plain):
        want[i] = (at, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes()))
        at += len(ids) + 1
    for out in (queries.op6_token_files(spark, str(tmp_path)), corpus_pipeline.token_output(spark, d, str(tmp_path))):
        assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in out.collect()} == want
    # op4's separator is that id: a text that names it stays one document.
    counts = {r.doc_id: r.n_tokens for r in queries.op4_token_counts(spark, str(tmp_path)).collect()}
    assert counts[0] == 9 and len(counts) == len(texts)


@pytest.mark.parametrize("block", [1, 3, 7, 1000])
def test_flat_files(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    want = {}
    for k, ids in enumerate([rng.integers(0, 4, 200), np.zeros(5, int), np.array([], int), np.array([3, 3]), np.array([3, 1])]):
        (tmp_path / f"{k}.ids").write_bytes(ids.astype("<u2").tobytes())
        start, n = 0, 0
        for e in [*np.flatnonzero(ids == 3).tolist(), len(ids)]:
            if e < len(ids) or start < e:
                want[f"{k}.ids", n] = (start, e - start, e < len(ids))
                start, n = e + 1, n + 1
    paths = spark.createDataFrame([(str(tmp_path / f"{k}.ids"),) for k in range(5)], "path string")
    got = {(os.path.basename(r.path), r.ordinal): (r.start, r.n_tokens, r.ended) for r in eod_scan.scan_flat(paths, 3, block_ids=block).collect()}
    assert got == want


def test_codec():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 70_000), np.zeros(300, int), np.arange(2000) % 7, np.array([4_000_000]), np.array([0])):
        block = token_codec.encode_block(ids)
        assert (token_codec.decode_block(block) == ids).all()
        broken = bytearray(block)
        broken[8 + len(broken) // 2] ^= 1
        with pytest.raises((ValueError, IndexError)):
            token_codec.decode_block(bytes(broken))
    assert len(token_codec.encode_block(np.arange(200_000) % 50)) < 40_000
    with pytest.raises(ValueError):
        token_codec.encode_block(np.array([token_codec.MOST_VOCABULARY]))


def test_warc(spark):
    big = "x" * 200
    rows = [(3, "http://a b\r\n", big), (1, None, big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (None, "u", big), (6, "é", "ü" * 5000), (1, "again", big)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    paths = warc_zip.write_packages(pages, package_bytes=1)
    got = warc_zip.read_packages(paths, payloads=True).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter([(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "response", None), (5, "response", None), (None, "revisit", 1), (6, "response", None), (1, "response", None)])
    assert {r.payload_bytes for r in got if r.page_id == 6} == {10_000} and all(hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    assert warc_zip.round_trip(pages.limit(0)).count() == 0


def test_zip64_directory():
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z, z.open("archive/a.warc", "w", force_zip64=True) as f:
        f.write(b"abc" * 10)
    # ZIP64 end records, as an archive of many members has them.
    data = raw.getvalue()
    end = data.rfind(b"PK\x05\x06")
    import struct

    count, length, at = struct.unpack_from("<HII", data, end + 10)
    wide = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, length, at) + struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    data = data[:end] + wide + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    f = io.BytesIO(data)
    place, size = warc_zip.stored_at(f, warc_zip.zip_members(f, len(data))["archive/a.warc"])
    assert warc_zip.read_at(f, place, size) == b"abc" * 10


def plain_classes(rows, words=5, similarity=0.8):
    import re

    def cut(t):
        w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()

    sets, head = [cut(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (rows[i][1] or "") == (rows[j][1] or "") or a and b and len(a & b) >= similarity * len(a | b):
                old, new = head[i], head[j]
                head = [new if h == old else h for h in head]
    least = defaultdict(list)
    for (d, _, _), h in zip(rows, head, strict=True):
        if d is not None:
            least[h].append(d)
    return Counter((d, min(least[h], default=None)) for (d, _, _), h in zip(rows, head, strict=True))


def test_near_duplicates(spark, none):
    rng = np.random.default_rng(5)
    rows = [(1000 + i if i is not None else None, t, s) for i, t, s in ODD]
    for k in range(12):
        w = [f"w{x}" for x in rng.integers(0, 500, 120)]
        rows.append((20 * k, " ".join(w), None))
        for j in range(1, 8):
            v = list(w)
            for p in rng.integers(0, 120, j):
                v[p] = f"z{rng.integers(0, 99)}"
            rows.append((20 * k + j, " ".join(v), None))
    d = docs(spark, rows).repartition(4)
    found = near_dup.near_duplicates(d)
    assert Counter((r.doc_id, r.class_id) for r in found.collect()) == plain_classes(rows)
    kept = near_dup.first_of_classes(d)
    assert kept.columns == d.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter(c for c in {c for _, c in plain_classes(rows) if c is not None}) + Counter({None: 1})
    assert near_dup.near_duplicates(none).count() == 0


def test_near_duplicates_of_repeated_shingles(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(24):
        w = [f"w{x}" for x in rng.integers(0, 10**6, 204)]
        blocks = [[f"z{x}" for x in rng.integers(0, 10**6, 44)] for _ in range(2)]
        rows.append((10 * k, " ".join(w), None))
        # 200 shingles shared, 48 added: alike however often the block is repeated.
        rows += [(10 * k + 1 + j, " ".join(w + b * times), None) for j, (b, times) in enumerate(zip(blocks, (20, 100), strict=True))]
    got = Counter((r.doc_id, r.class_id) for r in near_dup.near_duplicates(docs(spark, rows).repartition(4)).collect())
    assert got == plain_classes(rows) == Counter((10 * k + j, 10 * k) for k in range(24) for j in range(3))


@pytest.mark.parametrize("lookup", [100, 1 << 21])
def test_every_pair_of_a_bucket_is_verified(monkeypatch, lookup):
    monkeypatch.setattr(near_dup, "LOOKUP", lookup)
    rng = np.random.default_rng(3)
    heads = [rng.integers(0, 1 << 40, 50).astype(np.uint64) for _ in range(8)]
    sets = [np.unique(np.append(heads[i % 8][: 50 - i % 3], rng.integers(0, 1 << 40, i % 7).astype(np.uint64))) for i in range(40)]
    # Only the first band agrees, so that by signatures no pair would be alike.
    sig = np.arange(40 * 64, dtype=np.uint32).reshape(40, 64)
    sig[:, :4] = 5
    bands = near_dup.band_keys(sig, 4)
    assert len(set(bands[:, 0].tolist())) == 1
    table = pa.table({"nid": pa.array(range(40), pa.int64()), "comp": pa.array(range(40), pa.int64()), "sig": [s.tobytes() for s in sig], "set": [s.tobytes() for s in sets], "part": [0] * 40})
    links = near_dup._comparer(0.8, 4)((pa.scalar(int(bands[0, 0])), pa.scalar(0), pa.scalar(0)), table).to_pylist()

    def classes(pairs):
        head = list(range(40))
        for i, j in pairs:
            head = [min(head[i], head[j]) if h in (head[i], head[j]) else h for h in head]
        return head

    assert classes([(x["a"], x["b"]) for x in links]) == classes([(i, j) for j in range(40) for i in range(j) if near_dup.alike(sets[i], sets[j], 0.8)])


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)] + [(200, x) for x in range(201, 230)]
    got = {r.node: r.comp for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 230)}


@pytest.mark.parametrize("seed", [1, 2])
def test_further_links_join_components(spark, seed):
    rng = np.random.default_rng(seed)
    links = rng.integers(0, 60, (70, 2)).tolist()
    first, further = links[:40], links[40:]
    root = list(range(60))
    for a, b in links:
        root = [min(root[a], root[b]) if r in (root[a], root[b]) else r for r in root]
    frame = lambda x: spark.createDataFrame(x, "a long, b long")
    for one, two in ((first, further), (links, []), ([], links)):
        got = [(r.node, r.comp) for r in near_dup.joined(near_dup.components(frame(one)), frame(two)).collect()]
        named = dict(got)
        assert len(got) == len(named) and all(root[n] == c for n, c in got)
        assert all(n in named for n in range(60) if root.count(root[n]) > 1)


def test_license(spark, odd, none):
    rows = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [(1, "CC  by, cc-BY\nx", None), (2, "accc by", None), (3, "Licensed under the Apache License, Version 2.0.", None), (4, None, None)])).collect()}
    assert (rows[1].n_base, rows[1].first_word, rows[1].last_word, rows[1].base_labels, rows[1].score) == (2, 0, 2, "cc-by", 1.0)
    assert rows[2].n_base == 0 and rows[2].first_word is None and rows[3].labels == "apache-2.0" and rows[3].score == 1.0
    assert (rows[4].n_words, rows[4].labels, rows[4].score) == (0, "", 0.0)
    assert license_scan.license_scan(odd).count() == len(ODD) and license_scan.license_scan(none).count() == 0


def test_license_places_behind_wide_characters(spark):
    row = license_scan.license_scan(docs(spark, [(1, "ab <3 \U0001f600 and \U0001f600\U0001f600, all rights reserved\n\U0001f600 cc by", None), (2, "ab \U0001f600 all rights reserved", None)])).orderBy("doc_id").collect()
    assert [(r.first_word, r.last_word, r.n_base) for r in row] == [(5, 9, 2), (2, 2, 1)]


def test_license_notices_wrap(spark):
    mit = "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that"
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\r\n * License, v. 2.0. If a copy"
    apart = "Redistribution and use in source and binary forms\n" + "other words here\n" * 20 + "with or without modification are permitted"
    texts = [mit, bsd, mpl, "x\n" * 300 + bsd.replace(" ", "\n"), apart, bsd.replace("\n", " ")]
    rows = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [rows[i].labels for i in range(6)] == ["mit", "bsd", "mpl-2.0", "bsd", "", "bsd"]
    assert [rows[i].score for i in (0, 1, 2, 4)] == [1.0, 1.0, 1.0, 0.0]


def test_license_blocks_are_short(spark):
    """Words of a notice that are strewn over a line are no notice; words put in or lost are allowed for."""
    texts = ["He was released under bail and the MIT dean lost his license", "this was released " + "x " * 40 + "under the mit license", "Released, under the (so-called) MIT\n * License", "licensed under the terms of the Apache License, Version 2.0", "released under the mit", "K released under the MIT license \u212a", "released under the " * 5000 + "mit license"]
    rows = {r.doc_id: r for r in license_scan.license_scan(docs(spark, [(i, t, None) for i, t in enumerate(texts)])).collect()}
    assert [rows[i].labels for i in range(7)] == ["", "", "mit", "apache-2.0", "", "mit", "mit"]


def test_license_equals_its_sql(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = sorted({w for _, t in license_scan.TEMPLATES for w in t.split()})
    texts = []
    for i in range(120):
        _, notice = license_scan.TEMPLATES[i % len(license_scan.TEMPLATES)]
        w = notice.split()
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(w)))
            w[at : at + int(rng.integers(0, 2))] = [str(rng.choice(words))] * int(rng.integers(0, 3))
        fill = [str(x) for x in rng.choice(words, int(rng.integers(0, 40)))]
        texts.append(" ".join(fill + w + fill[::-1]).replace(" the ", "\nThe ").replace(" cc ", " \U0001f600 CC-"))
    docs(spark, [(i, t, None) for i, t in enumerate([*texts, None, "", " ,"])]).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.op8_sql())
    names = [c[0] for c in want.description]
    got = queries.op8_license_scan(spark, str(tmp_path)).select(*names).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall()) and len({r.labels for r in got}) > 8


def test_decontamination(spark, odd, none):
    item = " ".join(f"q{i}" for i in range(30))
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too few words"), (None, item), (4, "same text of seven words it is")], "item_id long, text string")
    d = docs(spark, [(10, "x " * 5000 + item.upper() + " y" * 5000, None), (11, " ".join(item.split()[:20]), None), (12, None, None)]).union(odd)
    got = Counter((r.doc_id, r.item_id, r.containment) for r in decontam.contained_items(d, bench).collect())
    assert got == Counter({(10, 1, 1.0): 1, (10, None, 1.0): 1, (5, 4, 1.0): 2, (6, 4, 1.0): 1})
    left = decontam.without_items(d, bench)
    assert left.count() == d.count() - 4 and left.columns == d.columns
    assert decontam.contained_items(none, bench).count() == 0 == decontam.contained_items(d, bench.limit(0)).count()


def test_short_items_are_found(spark, tmp_path):
    """Items of one to four words, by one shingle of all their words; equal to the SQL."""
    bench = spark.createDataFrame([(1, "Who wrote Hamlet?"), (2, "four words of item"), (3, "  ,. "), (4, ""), (5, "seldom"), (6, "and a longer item of more than five words")], "item_id long, text string")
    d = docs(spark, [(10, "so, who WROTE hamlet - he asked", None), (11, "four words of items", None), (12, "here are four words: of item. Four words of item", None), (13, "seldom", None), (14, "seldoms", None), (15, "", None), (16, "who wrote", None), (17, "and a longer item of more than five words, who wrote hamlet", None)])
    got = Counter((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.contained_items(d, bench).collect())
    assert got == Counter([(10, 1, 1, 1), (12, 2, 1, 1), (13, 5, 1, 1), (17, 1, 1, 1), (17, 6, 5, 5)])
    con = duckdb.connect()
    for name, df in (("documents", d), ("benchmark", bench)):
        df.write.parquet(f"{tmp_path}/{name}")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
    sql = con.execute(f"SELECT doc_id, item_id, n_shared, n_item FROM ({queries.OP9_SQL})").fetchall()
    assert Counter(sql) == got


def test_nearest(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=(900, 16)), np.ones((300, 16))])
    rows = [(i, x.tolist(), None) for i, x in enumerate(v)] + [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [1.0, None], 1), (None, [1.0] * 16, 1), (2400, [1.0, 2.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in ann.search_table(df).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 1200, 100))
    hit = 0
    for q, rs in got.items():
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for i in np.lexsort((np.arange(len(v)), dist)) if i != q][:10]
        rs.sort()
        assert [x[0] for x in rs] == list(range(1, 11)) and all(abs(s - dist[i]) < 1e-9 for _, i, s in rs)
        hit += len(set(want) & {i for _, i, _ in rs})
        assert q < 900 or [i for _, i, _ in rs] == want
    assert hit >= 0.9 * 10 * len(got)
    assert ann.search_table(df.limit(0)).count() == 0


def test_the_stopping_test_leaves_rows_unverified():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(6000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    matrix, limit = ann.projection(64, ann.DIMENSIONS), ann.chi_square_point(ann.CONFIDENCE, ann.DIMENSIONS)
    tree = ann.KdTree(v @ matrix)
    held, vectors, ids = ann.KdTree.load(tree.dump(v, np.arange(len(v))))
    hit = seen = 0
    for q in range(0, 6000, 100):
        best, verified = ann.search(vectors, ids, held, v[q] @ matrix, v[q], q, 10, limit)
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        hit += len({i for _, i in best} & set([i for i in np.argsort(dist) if i != q][:10]))
        seen += verified
    assert hit >= 0.9 * 600 and seen < 0.6 * 60 * 6000


def test_cells_and_visits(spark, monkeypatch):
    """Many small shards, salted cells and a vector that a third of the rows hold: equal to one tree."""
    monkeypatch.setattr(ann, "SHARD", 60)
    rng = np.random.default_rng(9)
    v = np.concatenate([rng.normal(size=(600, 6)) + 8 * rng.integers(0, 3, (600, 1)), np.tile(rng.normal(size=6), (300, 1)), 1e-9 * rng.normal(size=(200, 6)) + 5])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    rows = ann.valid_vectors(df)
    index = ann.Index(rows)
    assert index.trees.count() > 8 and index.trees.agg(F.sum("n")).first()[0] == 600 + 11 + 200
    got = defaultdict(list)
    for r in index.nearest(rows.filter("vec_id % 100 = 0"), confidence=1 - 1e-12).collect():
        got[r.query_id].append((r.rank, r.vec_id))
    for q in range(0, 1100, 100):
        dist = np.sqrt(((v - v[q]) ** 2).sum(1))
        assert sorted(got[q]) == list(enumerate([i for i in np.lexsort((np.arange(len(v)), dist)) if i != q][:10], 1))


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(400, 8))
    # Those near the queries stand 30 times; one id has two vectors.
    rows = [(i, x.tolist()) for i, x in enumerate(v) for _ in range(30 if i < 40 else 1)] + [(7, v[100].tolist()), (200, v[200].tolist())]
    for q in (0, 100, 200, 300):
        rows += [(1000 + q + j + 1, (v[q] + 0.01 * j).tolist()) for j in range(3) for _ in range(25)]
    at, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = defaultdict(list)
    for r in ann.search_table(df, confidence=1 - 1e-12).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300}
    for q, rs in got.items():
        least: dict[int, float] = {}
        for i, d in zip(at.tolist(), np.sqrt(((x - v[q]) ** 2).sum(1)).tolist(), strict=True):
            if i != q:
                least[i] = min(d, least.get(i, d))
        want = sorted((d, i) for i, d in least.items())[:10]
        assert [(k, i) for k, i, _ in sorted(rs)] == [(k, i) for k, (_, i) in enumerate(want, 1)]
        assert np.allclose([s for *_, s in sorted(rs)], [d for d, _ in want])
