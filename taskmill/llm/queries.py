"""The queries op1 to op13 over whole tables, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taskmill.llm import ann, decontam, eod_scan, license_scan, mixing, near_dup, packing, pii, quality, sort_means, spelling, token_codec, warc_zip
from taskmill.llm.common import written

END_OF_TEXT = 50256


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, so that the texts are read once: the sort by ranges looks at its keys twice.
    docs = written(mixing.sized(table(spark, sf_dir, "documents"), "size").select("doc_id", "source", "size"), "sizes")
    return mixing.mix_sources(docs, "size").select("doc_id", "size", "source_size", "target", "taken")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    # A row without an id has no remainder: it is not held out, and no label names it.
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return quality.score(docs, weights).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eod_scan.token_counts(table(spark, sf_dir, "documents"), tokenizer_path(), END_OF_TEXT)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.round_trip(table(spark, sf_dir, "documents"), tokenizer_path(), plain=False)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_id")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_table(table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_table(table(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_table(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sort_means.cluster_table(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_quality, op3_pii, op4_token_counts, op5_warc, op6_token_files, op7_near_duplicates, op8_license_scan, op9_decontaminate, op10_nearest, op11_spelling, op12_packing, op13_clusters)}


# ---------------------------------------------------------------- SQL (DuckDB)

_WORDS = "string_split(trim(regexp_replace({}, '[^0-9a-z\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g')), ' ')"
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][(place % 3 + 1)::INT] AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS spent,
    sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight,
    1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT AS pot FROM w),
f AS (SELECT *, cap * left_weight <= (pot - spent) * weight AS filled FROM l),
o AS (SELECT max(left_weight) AS lw, arg_max(spent, left_weight) AS sp FROM f WHERE NOT filled),
t AS (SELECT source, source_size, CASE WHEN filled THEN cap ELSE least(cap, (pot - sp) * weight / lw) END AS target FROM f LEFT JOIN o ON true),
k AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate, ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 6))::BIGINT AS u FROM t),
n AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.rate, k.u, (row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS FIRST) - 1)::BIGINT AS rank FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, ((((rank + 1) * rate + u) >> 24) - ((rank * rate + u) >> 24)) * size AS taken FROM n
"""

OP5_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND head IS NOT NULL AND head IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND head IS DISTINCT FROM page_id THEN head END AS refers_to FROM g
"""

OP7_SQL = rf"""
WITH RECURSIVE t AS (SELECT md5(coalesce(text, '')) AS tid, min(doc_id) AS id, {_WORDS.format(f"any_value({_LOWERED})")} AS w FROM documents GROUP BY 1),
s AS (SELECT DISTINCT tid, unnest(CASE WHEN w = [''] THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS h FROM t),
n AS (SELECT tid, count(*) AS n FROM s GROUP BY tid),
c AS (SELECT a.tid AS a, b.tid AS b, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.tid <> b.tid GROUP BY 1, 2),
p AS (SELECT c.a, c.b FROM c JOIN n x ON x.tid = c.a JOIN n y ON y.tid = c.b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9),
r AS (SELECT tid AS a, tid AS b FROM t UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
m AS (SELECT r.a, min(t.id) AS class_id FROM r JOIN t ON t.tid = r.b GROUP BY r.a)
SELECT doc_id, class_id FROM documents d JOIN m ON m.a = md5(coalesce(d.text, ''))
"""


def op8_sql(templates=license_scan.TEMPLATES, containment: float = license_scan.CONTAINMENT) -> str:
    made = license_scan.compared_templates(templates, containment)
    quoted = ", ".join(f"({t['id']}, '{t['label']}', {t['n']}, {t['tokens']}, {t['needed']}::VARCHAR[], {t['barred']}::VARCHAR[], {t['pairs']}::VARCHAR[])" for t in made)
    phrases = " UNION ALL ".join(f"SELECT '{label}' AS label, {p.split()} AS p" for p, label in license_scan.PHRASES.items())
    # A block is a run of `span` words that begins with one of the template's words; a pair ends in it.
    windows = " UNION ALL ".join(
        f"SELECT rid, label, n, kind, count(DISTINCT item) FILTER (kind <= 1) OVER w AS k, count(DISTINCT item) FILTER (kind = 1) OVER w AS k_needed, count(DISTINCT item) FILTER (kind = 2) OVER w AS k_barred,"
        f" count(DISTINCT item) FILTER (kind = 3) OVER p AS k_pairs, {t['need']} AS need, {len(t['needed'])} AS need_needed, {t['need_pairs']} AS need_pairs FROM places WHERE tid = {t['id']}"
        f" WINDOW w AS (PARTITION BY rid ORDER BY place RANGE BETWEEN CURRENT ROW AND {t['span'] - 1} FOLLOWING), p AS (PARTITION BY rid ORDER BY place RANGE BETWEEN CURRENT ROW AND {max(t['span'] - 2, 0)} FOLLOWING)"
        for t in made
    )
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_LOWERED} AS t FROM documents),
w AS (SELECT *, CASE WHEN trim(regexp_replace(t, '[^0-9a-z\x{{80}}-\x{{10FFFF}}]+', ' ', 'g')) = '' THEN [] ELSE {_WORDS.format("t")} END AS w FROM d),
ph AS ({phrases}),
hits AS (SELECT rid, label, unnest(list_filter(range(0, len(w)), lambda i: w[(i + 1):(i + len(p))] = p)) AS place FROM w, ph),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM hits GROUP BY rid),
tm(tid, label, n, toks, needed, barred, pairs) AS (VALUES {quoted}),
tok AS (SELECT tid, label, n, word AS item, CASE WHEN list_contains(needed, word) THEN 1 ELSE 0 END AS kind FROM (SELECT *, unnest(toks) AS word FROM tm)
    UNION ALL SELECT tid, label, n, unnest(barred), 2 FROM tm UNION ALL SELECT tid, label, n, unnest(pairs), 3 FROM tm),
each AS (SELECT rid, unnest(w) AS item, generate_subscripts(w, 1) AS place FROM w
    UNION ALL SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), unnest(range(1, len(w))) FROM w),
places AS (SELECT rid, tid, label, n, item, kind, place FROM each JOIN tok USING (item)),
blocks AS ({windows}),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(k / n) AS best FROM blocks
    WHERE kind <= 1 AND k >= need AND k_needed = need_needed AND k_barred = 0 AND k_pairs >= need_pairs GROUP BY rid)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
    CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


_SHINGLES = "CASE WHEN w = [''] THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END"
OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM documents),
b AS (SELECT row_number() OVER () AS iid, item_id, {_WORDS.format("lower(coalesce(text, ''))")} AS w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) AS k FROM b),
ds AS (SELECT DISTINCT rid, doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS h FROM d, k WHERE len(w) >= k AND w <> ['']),
bs AS (SELECT DISTINCT iid, item_id, unnest({_SHINGLES}) AS h FROM b),
n AS (SELECT iid, count(*) AS n FROM bs GROUP BY iid)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item, (count(*) / any_value(n))::DOUBLE AS containment
FROM ds JOIN bs USING (h) JOIN n USING (iid) GROUP BY rid, doc_id, iid, item_id HAVING count(*) >= ceil(0.8 * any_value(n) - 1e-9)
"""


# The checksum by its table, which its polynomial gives.
OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0,0,0,0,0,0,0,0]::BIGINT[]), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k FROM r WHERE len(run) >= 5 GROUP BY 1, 2),
b AS (SELECT *, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM g),
h AS (SELECT b.*, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(x) + 1, 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) AS h FROM b, crc),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS word, k FROM h),
n AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE len(word) >= 5 GROUP BY word HAVING sum(k) >= 3),
v AS (SELECT word, n, i, left(word, i::INT - 1) || substr(word, i::INT + 1) AS less FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM n)),
p AS (SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
      UNION SELECT v.word, n.word, n.n FROM v JOIN n ON v.less = n.word UNION SELECT n.word, v.word, v.n FROM v JOIN n ON v.less = n.word),
q AS (SELECT word, count(*) AS n_near, min({'m': -m, 'w': other}) AS best FROM p GROUP BY word),
f AS (SELECT n.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 2 * n THEN best.w END AS form, CASE WHEN -best.m >= 2 * n THEN -best.m END::BIGINT AS form_n FROM n LEFT JOIN q USING (word)),
s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON f.word = s.root WHERE f.form IS NOT NULL),
e AS (SELECT s.word, s.root FROM s JOIN f ON f.word = s.root WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN e USING (word)
"""


def op13_sql(clusters: int = sort_means.CLUSTERS, rounds: int = sort_means.ROUNDS, seed: str = sort_means.SEED) -> str:
    """Each round compares all vectors with all centroids."""
    nearest = """a{i} AS (SELECT id, vec_id, v, min({{'d': list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'c': cluster}}) AS m FROM whole, c{i} GROUP BY id, vec_id, v)"""
    moved = """s{i} AS (SELECT m.c AS cluster, x, sum(y)::HUGEINT AS t, count(*) AS n FROM (SELECT m, unnest(v) AS y, generate_subscripts(v, 1) AS x FROM a{i}) GROUP BY 1, 2),
c{j} AS (SELECT cluster, coalesce(any_value(n.c), any_value(c{i}.c)) AS c FROM c{i} LEFT JOIN (SELECT cluster, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY x) AS c FROM s{i} GROUP BY 1) AS n USING (cluster) GROUP BY cluster)"""
    steps = ",\n".join(f"{nearest.format(i=i)},\n{moved.format(i=i, j=i + 1)}" for i in range(rounds))
    return f"""
WITH whole AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM whole WHERE vec_id IS NOT NULL QUALIFY cluster < {clusters}),
{steps},
{nearest.format(i=rounds)},
told AS (SELECT cluster, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM c{rounds})
SELECT vec_id, m.c::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN told ON told.cluster = m.c
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op5_warc": OP5_SQL, "op7_near_duplicates": OP7_SQL, "op8_license_scan": op8_sql(), "op9_decontaminate": OP9_SQL, "op11_spelling": OP11_SQL, "op13_clusters": op13_sql()}
