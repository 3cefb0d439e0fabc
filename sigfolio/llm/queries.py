"""One registered query per operator, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigfolio.llm import (ann, bpe, decontaminate, html_extract, licenses, merkle, prefix_trie, resample, shard_pack, simhash,
                          suffix_dedup, token_files, toxicity)
from sigfolio.llm.common import table
from sigfolio.session import scratch_path

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def tokenizer_file() -> str:
    """``SIGFOLIO_TOKENIZER`` or the installed public 50k byte-level file."""
    if path := os.environ.get("SIGFOLIO_TOKENIZER"):
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text."""
    return bpe.encode_decode(docs, tokenizer_file()).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op1_bpe_roundtrip")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


@query("op7_shard_pack")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_pack.assign(table(spark, sf_dir, "documents"), shards=24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


@query("op9_html_extract")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (toxicity.fold() == 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4).select(
        "doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w
      FROM benchmark WHERE item_id IS NOT NULL),
-- two substitutions in 13 tokens leave one of the runs 0-3, 4-7, 8-11 whole
dg AS (SELECT doc_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] AS g
       FROM (SELECT doc_id, w, unnest(range(len(w) - 3)) AS p FROM d WHERE len(w) >= 13)),
bg AS (SELECT item_id, p, w[p + 1] || ' ' || w[p + 2] || ' ' || w[p + 3] || ' ' || w[p + 4] AS g
       FROM (SELECT item_id, w, unnest(range(len(w) - 3)) AS p FROM b WHERE len(w) >= 13)),
c AS (SELECT DISTINCT doc_id, item_id, dg.p - o AS s, bg.p - o AS t FROM dg JOIN bg USING (g), (VALUES (0), (4), (8)) AS v(o)
      WHERE dg.p >= o AND bg.p >= o),
m AS (SELECT c.doc_id, c.item_id, c.s FROM c JOIN d USING (doc_id) JOIN b USING (item_id)
      WHERE s + 13 <= len(d.w) AND t + 13 <= len(b.w)
        AND list_sum(list_transform(range(13), lambda k: CASE WHEN d.w[s + k + 1] = b.w[t + k + 1] THEN 1 ELSE 0 END)) >= 11),
-- items of 5 to 12 tokens: all of them, word for word
t AS (SELECT item_id, array_to_string(w, ' ') AS g, len(w) AS n FROM b WHERE len(w) BETWEEN 5 AND 12),
q AS (SELECT p.doc_id, t.item_id, s FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM t) WHERE len(w) >= n) AS p
      JOIN t ON t.n = p.n AND t.g = array_to_string(w[s + 1:s + p.n], ' ')),
i AS (SELECT doc_id, item_id, count(DISTINCT s) AS n, min(s) AS s FROM (SELECT * FROM m UNION ALL SELECT * FROM q) GROUP BY ALL),
r AS (SELECT doc_id, count(*) AS n_items, sum(n) AS n_windows, min(item_id) AS first_item, min(s) AS first_token FROM i GROUP BY ALL)
SELECT documents.doc_id, r.doc_id IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items,
       CAST(coalesce(n_windows, 0) AS BIGINT) AS n_windows, first_item, CAST(first_token AS INTEGER) AS first_token
FROM documents LEFT JOIN r ON documents.doc_id = r.doc_id
"""


@query("op6_decontaminate", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, 2 * s + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS s FROM d WHERE len(h) >= 100)),
f AS (SELECT x, min(doc_id) AS m FROM w GROUP BY x),
c AS (SELECT doc_id, s, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM w JOIN f USING (x) WHERE m < doc_id),
g AS (SELECT doc_id, s, sum(CASE WHEN gap <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM c),
i AS (SELECT doc_id, k, min(s) AS a, max(s) + 50 AS b FROM g GROUP BY doc_id, k),
p AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS e FROM i),
r AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone, max(b) AS e, string_agg(substr(h, 2 * p.e + 1, 2 * (a - p.e)), '' ORDER BY k) AS head
      FROM p JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(r.e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN r ON d.doc_id = r.doc_id
"""


@query("op3_suffix_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_ann")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def archive(spark: SparkSession, sf_dir: str, damaged: bool = False) -> DataFrame:
    """Stand-in archive of the pages: one record per page in files of 256
    pages, with its offset; the replica has some records altered, cut short
    or lost.  Only gives rows (file, offset, payload)."""
    page = F.col("page_id")
    payload = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), F.coalesce("url", F.lit("")),
                       F.lit("\r\n\r\n"), F.coalesce("html", F.lit("")), F.lit("\r\n\r\n"))
    rows = (table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("part-"), F.floor(page / 256).cast("string")).alias("file"), payload.alias("payload"))
            .withColumn("size", F.octet_length("payload").cast("long")))
    before = Window.partitionBy("file").orderBy("page_id")
    rows = rows.withColumn("offset", F.sum("size").over(before) - F.col("size"))
    if damaged:
        altered = F.concat(F.substring("payload", 1, 100), F.lit("X"), F.expr("substring(payload, 102)"))
        rows = rows.filter(page % 101 != 7).withColumn(
            "payload", F.when(page % 97 == 5, altered).when(page % 103 == 9, F.substring("payload", 1, 200)).otherwise(F.col("payload")))
    return rows.select("file", "offset", "payload")


def merkle_sql() -> str:
    levels = []
    for side in ("p", "q"):
        levels.append(f"""{side}0 AS (SELECT file, "offset" >> {merkle.LEVELS[0]} AS node, sha256(string_agg("offset" || ':' || length || ':' || hash || ':1', ',' ORDER BY "offset")) AS hash
  FROM {side} GROUP BY ALL)""")
        for k, (low, high) in enumerate(zip(merkle.LEVELS, merkle.LEVELS[1:])):
            levels.append(f"{side}{k + 1} AS (SELECT file, node >> {high - low} AS node, sha256(string_agg(node || ':' || hash, ',' ORDER BY node)) AS hash FROM {side}{k} GROUP BY ALL)")
    top = len(merkle.LEVELS) - 1
    return f"""
WITH r AS (SELECT page_id, 'part-' || CAST(page_id // 256 AS VARCHAR) AS file,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
  || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS payload FROM pages),
o AS (SELECT *, CAST(sum(strlen(payload)) OVER (PARTITION BY file ORDER BY page_id) - strlen(payload) AS BIGINT) AS "offset" FROM r),
d AS (SELECT file, "offset", CASE WHEN page_id % 97 = 5 THEN substr(payload, 1, 100) || 'X' || substr(payload, 102)
  WHEN page_id % 103 = 9 THEN substr(payload, 1, 200) ELSE payload END AS payload FROM o WHERE page_id % 101 <> 7),
p AS (SELECT file, "offset", CAST(strlen(payload) AS BIGINT) AS length, sha256(payload) AS hash FROM o),
q AS (SELECT file, "offset", CAST(strlen(payload) AS BIGINT) AS length, sha256(payload) AS hash FROM d),
{("," + chr(10)).join(levels)}
SELECT p.file, p."offset", p.length, p.hash AS expected, q.hash AS actual, CASE WHEN q.hash IS NULL THEN 'missing' ELSE 'altered' END AS status,
       p{top}.hash AS primary_root, q{top}.hash AS replica_root
FROM p LEFT JOIN q ON p.file = q.file AND p."offset" = q."offset" LEFT JOIN p{top} ON p.file = p{top}.file LEFT JOIN q{top} ON p.file = q{top}.file
WHERE p.hash IS DISTINCT FROM q.hash
"""


@query("op4_warc_merkle", merkle_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.audit(archive(spark, sf_dir), archive(spark, sf_dir, damaged=True))


def license_sql() -> str:
    whole, line, text = (licenses.duckdb_form(x) for x in ("coalesce(text, '')", "line", "text"))
    return f"""
WITH k AS (SELECT known, min(license) AS license FROM (
  SELECT sha256(form) AS known, license FROM (SELECT license, {text} AS form FROM ({licenses.duckdb_known()}) AS v(license, text)) WHERE form <> ''
  UNION ALL SELECT known, license FROM ({licenses.duckdb_digests()}) AS w(license, known)) GROUP BY 1),
d AS (SELECT doc_id, {whole} AS form FROM documents),
l AS (SELECT doc_id, {line} AS form FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
n AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n, string_agg(license, ',' ORDER BY license) AS names
      FROM (SELECT doc_id, license, count(*) AS n FROM l JOIN k ON sha256(l.form) = k.known WHERE l.form <> '' GROUP BY ALL) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, license,
       coalesce(n.n, 0) AS n_license_lines, coalesce(names, '') AS line_licenses
FROM d LEFT JOIN k ON sha256(form) = k.known AND form <> '' LEFT JOIN n ON d.doc_id = n.doc_id
"""


@query("op5_license_scan", license_sql())
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


#: Unsigned CRC-32 in SQL: a table of 256 values from the reflected
#: polynomial, then one step per byte of a list ``b``.
CRC_TABLE = """SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t"""
CRC_OF = "xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295)"


OP13_SQL = f"""
WITH tab AS ({CRC_TABLE}),
o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
t AS (SELECT c, strlen(text) AS n_bytes, dg, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, dg) - 1 AS i
      FROM (SELECT *, sha256(strlen(role) || ':' || role || text) AS dg FROM o)),
v AS (SELECT c, c - c % 5 AS base, ({CRC_OF}) % 9 AS h
      FROM (SELECT c, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT) AS b FROM (SELECT DISTINCT c FROM t)), tab),
r AS (SELECT v.c, 0 AS own, i, dg, n_bytes FROM v JOIN t ON t.c = v.base AND i < h
      UNION ALL SELECT v.c, 1, i, dg, n_bytes FROM v JOIN t ON t.c = v.c AND i >= h),
p AS (SELECT c, n_bytes, row_number() OVER w AS d, sha256(string_agg(dg, '') OVER (PARTITION BY c ORDER BY own, i ROWS UNBOUNDED PRECEDING)) AS k
      FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i)),
q AS (SELECT c, 0 AS n_bytes, 0 AS d, '' AS k FROM v UNION ALL SELECT c, n_bytes, d, k FROM p),
l AS (SELECT c, max(d) AS top FROM q GROUP BY c),
n AS (SELECT k, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(n_bytes) AS saved,
             string_agg(CASE WHEN d = top THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends FROM q JOIN l USING (c) GROUP BY k),
e AS (SELECT n.k, u.k AS up, m.conv_id AS parent FROM n JOIN q AS u ON u.c = n.conv_id AND u.d = n.depth - 1 JOIN n AS m ON m.k = u.k),
f AS (SELECT up AS k, count(*) AS n_children FROM e GROUP BY up),
s AS (SELECT q.k, count(*) FILTER (WHERE f.k IS NULL) AS n_leaves, sum(n.saved) AS saved_tokens
      FROM n JOIN q ON q.c = n.conv_id AND q.d <= n.depth LEFT JOIN f ON f.k = n.k GROUP BY q.k)
SELECT n.conv_id, CAST(depth AS BIGINT) AS depth, e.parent AS parent_conv_id, n_convs, coalesce(f.n_children, 0) AS n_children, n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM n LEFT JOIN e ON e.k = n.k LEFT JOIN f ON f.k = n.k JOIN s ON s.k = n.k
"""


@query("op13_prefix_trie", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.mixed(prefix_trie.number_turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.trie(turns, convs).drop("turn_bytes")


OP11_SQL = f"""
WITH tab AS ({CRC_TABLE}),
w AS (SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
      FROM (SELECT 0 AS src, doc_id AS id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark)),
g AS (SELECT src, id, f, count(*) AS n FROM (
        SELECT src, id, unnest(w) AS f FROM w
        UNION ALL SELECT src, id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w) GROUP BY ALL),
c AS (SELECT f, ({CRC_OF}) % 10000 AS bucket
      FROM (SELECT f, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT) AS b
            FROM (SELECT DISTINCT f FROM g)), tab),
k AS (SELECT bucket, sum(CASE WHEN src = 0 THEN n ELSE 0 END)::DOUBLE AS s, sum(CASE WHEN src = 1 THEN n ELSE 0 END)::DOUBLE AS t FROM g JOIN c USING (f) GROUP BY bucket),
x AS (SELECT bucket, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM k) + 10000) / ((s + 1) * ((SELECT sum(t) FROM k) + 10000)))) AS gain FROM k),
m AS (SELECT id, sum(n) AS n_features, floor(sum(n * gain) / sum(n)) AS weight FROM g JOIN c USING (f) JOIN x USING (bucket) WHERE src = 0 GROUP BY id),
d AS (SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             ('0x' || substr(sha256('7:' || id), 1, 8))::BIGINT AS h FROM w LEFT JOIN m USING (id) WHERE src = 0),
y AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS score FROM d),
z AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS r, count(*) OVER (PARTITION BY n_words >= 20) AS n FROM y)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score,
       CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank, CAST(n_words AS BIGINT) AS n_words FROM z
"""


@query("op11_importance_resample", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, min_words=20, seed=7).select(
        "doc_id", "n_features", "weight", "score", "rank", "n_words")


@query("op12_token_files")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    index = token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_file(), end_id=0)
    return (token_files.read(index, folder).join(token_files.starts(index), "part")
            .select("doc_id", (F.col("base") + F.col("at")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                    F.crc32("ids").alias("ids_crc32")))
