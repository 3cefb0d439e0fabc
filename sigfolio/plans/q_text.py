"""Filing-text job queries: header, sections, paragraphs, keywords, passages,
normalisation, dates and hashes -- over ``documents`` / ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from sigfolio.functions import text as X
from sigfolio.functions.dates import compact_date
from sigfolio.operators import clean as C
from sigfolio.plans import bindings as B
from sigfolio.plans.oracle import with_views
from sigfolio.plans.registry import query

# Keywords that occur in the driver's documents (the finance list does not).
DOC_KEYWORDS = ["the", "and", "de", "und"]
NL = "chr(10)"

# ---------------------------------------------------------------- DuckDB side


def d_section(col: str, pattern: str) -> str:
    lens = f"list_transform(regexp_extract_all({col}, '(?is){pattern}', 2), lambda b: length(b))"
    return (f"CASE WHEN coalesce(list_max({lens}), 0) > 0 THEN "
            f"regexp_extract_all({col}, '(?is){pattern}', 0)[list_position({lens}, list_max({lens}))] END")


def d_header(name: str) -> str:
    return f"nullif(regexp_extract(content, '{X.HEADER_PATTERNS[name]}', 1), '')"


def d_paras(col: str, delim: str = f"{NL} || {NL}") -> str:
    t = rf"regexp_replace({col}, '(?m)^[A-Z\s]+\n', {NL}, 'g')"
    parts = f"CASE WHEN strpos({t}, '{X.TOC_MARKER}') > 0 THEN string_split({t}, '{X.TOC_MARKER}') ELSE string_split({t}, {delim}) END"
    return rf"list_filter(list_transform({parts}, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


def d_counts(paras: str, kws) -> str:
    terms = " + ".join(f"(length(lower(p)) - length(replace(lower(p), '{k.lower()}', ''))) // {len(k)}" for k in kws)
    return f"list_transform({paras}, lambda p: CAST({terms} AS BIGINT))"


def d_start(counts: str, k: int) -> str:
    sums = f"list_transform(range(0, len({counts}) - {k} + 1), lambda i: list_sum({counts}[i + 1:i + {k}]))"
    return f"CASE WHEN len({counts}) >= {k} THEN CAST(list_position({sums}, list_max({sums})) - 1 AS INTEGER) ELSE 0 END"


def d_passage(paras: str, start: str, k: int) -> str:
    j = f"array_to_string({paras}[{start} + 1:{start} + {k}], '. ' || {NL} || ' ')"
    return f"replace(replace({j}, 's ' || {NL} || {NL}, ''), {NL} || {NL} || 'Ta', '')"


def d_top_passages(src: str, key: str, cols, kws, k: int, delim: str = f"{NL} || {NL}") -> str:
    """CTE chain over ``src`` producing ``tp`` with column per input col."""
    p = ", ".join(f"{d_paras(c, delim)} AS {c}_p, {c} IS NULL AS {c}_null" for c in cols)
    n = ", ".join(f"{c}_p, {c}_null, {d_counts(c + '_p', kws)} AS {c}_n" for c in cols)
    s = ", ".join(f"{c}_p, {c}_null, {d_start(c + '_n', k)} AS {c}_s" for c in cols)
    t = ", ".join(f"CASE WHEN {c}_null THEN NULL ELSE {d_passage(c + '_p', c + '_s', k)} END AS {c}" for c in cols)
    return (f", tp1 AS (SELECT {key}, {p} FROM {src})"
            f", tp2 AS (SELECT {key}, {n} FROM tp1)"
            f", tp3 AS (SELECT {key}, {s} FROM tp2)"
            f", tp AS (SELECT {key}, {t} FROM tp3)")


# ---------------------------------------------------------------- queries

@query("filing_header", with_views("filing_texts") + "SELECT doc_id, " + ", ".join(
    f"coalesce({d_header(k)}, '{X.UNKNOWN}') AS {k}" for k in X.HEADER_PATTERNS) + " FROM filing_texts")
def q_filing_header(spark, sf):
    f = B.filing_texts(spark, sf)
    h = X.filing_header("content")
    return f.select("doc_id", *[v.alias(k) for k, v in h.items()])


@query("compact_date", with_views("filing_texts") + f"""
SELECT doc_id, d AS filing_date, strftime(d, '%Y-%m') AS ym FROM (
  SELECT doc_id, try_strptime({d_header('date')}, '%Y%m%d')::DATE AS d
  FROM filing_texts)""")
def q_compact_date(spark, sf):
    f = B.filing_texts(spark, sf)
    d = X.filing_header("content")["date"]
    return f.select("doc_id", compact_date(d).alias("filing_date"), compact_date(d, "yyyy-MM").alias("ym"))


P_TAG = r"(<p>)(.*?)(</p>)"


@query("extract_section", f"""
SELECT page_id, length(section) AS n_chars, md5(section) AS section_md5 FROM (
  SELECT page_id, {d_section('html', P_TAG)} AS section FROM pages)""")
def q_extract_section(spark, sf):
    p = B.table(spark, sf, "pages")
    s = p.select("page_id", X.extract_section("html", P_TAG).alias("section"))
    return s.select("page_id", F.length("section").cast("long").alias("n_chars"), F.md5("section").alias("section_md5"))


def sections_ctes(patterns: dict, k: int) -> str:
    """CTEs up to ``tp``: the best passages of every item of each filing."""
    sec = ", ".join(f"{d_section('content', p)} AS {c}" for c, p in patterns.items())
    return (with_views("filing_texts") + f", sec AS (SELECT doc_id, {sec} FROM filing_texts)"
            + d_top_passages("sec", "doc_id", list(patterns), X.FILING_KEYWORDS, k))


def section_columns(patterns: dict) -> str:
    return ", ".join(f"length({c}) AS {c}_len, md5({c}) AS {c}_md5" for c in patterns)


def _sections_sql(patterns: dict, k: int) -> str:
    return sections_ctes(patterns, k) + f" SELECT doc_id, {section_columns(patterns)} FROM tp"


def text_partitions(spark) -> int:
    """Tasks that share the CPU-heavy text work, whatever the input's files."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _sections(spark, sf, patterns: dict, k: int):
    df = B.filing_texts(spark, sf).repartition(text_partitions(spark), "doc_id")
    for c, p in patterns.items():
        df = df.withColumn(c, X.extract_section("content", p))
    for c in patterns:
        df = X.with_top_passages(df, c, c, X.FILING_KEYWORDS, k)
    out = []
    for c in patterns:
        out += [F.length(c).cast("long").alias(f"{c}_len"), F.md5(c).alias(f"{c}_md5")]
    return df.select("doc_id", *out)


@query("sections_10k", _sections_sql(X.SECTIONS_10K, X.RUN_LENGTH_10K))
def q_sections_10k(spark, sf):
    return _sections(spark, sf, X.SECTIONS_10K, X.RUN_LENGTH_10K)


@query("sections_10q", _sections_sql(X.SECTIONS_10Q, X.RUN_LENGTH_10Q))
def q_sections_10q(spark, sf):
    return _sections(spark, sf, X.SECTIONS_10Q, X.RUN_LENGTH_10Q)


def _has_text_sql() -> str:
    sec = ", ".join(f"{d_section('content', p)} AS {c}" for c, p in X.SECTIONS_10Q.items())
    cond = " OR ".join(f"{c} IS NOT NULL" for c in X.SECTIONS_10Q)
    return (with_views("filing_texts") + f", sec AS (SELECT doc_id, {sec} FROM filing_texts)"
            + f" SELECT doc_id FROM sec WHERE {cond}")


@query("filter_has_text", _has_text_sql())
def q_has_text(spark, sf):
    df = B.filing_texts(spark, sf)
    for c, p in X.SECTIONS_10Q.items():
        df = df.withColumn(c, X.extract_section("content", p))
    return df.filter(C.has_text(*X.SECTIONS_10Q)).select("doc_id")


DOC_DELIM = NL


@query("split_paragraphs", f"""
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paras, md5(array_to_string(p, chr(1))) AS paras_md5 FROM (
  SELECT doc_id, {d_paras('text', DOC_DELIM)} AS p FROM documents)""")
def q_split(spark, sf):
    d = B.table(spark, sf, "documents")
    p = d.select("doc_id", X.split_paragraphs("text", "\n").alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n_paras"), F.md5(F.array_join("p", "\u0001")).alias("paras_md5"))


@query("keyword_counts", f"""
SELECT doc_id, array_to_string(c, ',') AS counts, CAST(list_sum(c) AS BIGINT) AS total FROM (
  SELECT doc_id, {d_counts(d_paras('text', DOC_DELIM), DOC_KEYWORDS)} AS c FROM documents)""")
def q_keyword_counts(spark, sf):
    d = B.table(spark, sf, "documents")
    c = d.select("doc_id", X.keyword_counts(X.split_paragraphs("text", "\n"), DOC_KEYWORDS).alias("c"))
    return c.select("doc_id", F.array_join("c", ",").alias("counts"),
                    F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("max_keyword_window", f"""
SELECT doc_id, {d_start('c', 2)} AS start FROM (
  SELECT doc_id, {d_counts(d_paras('text', DOC_DELIM), DOC_KEYWORDS)} AS c FROM documents)""")
def q_max_window(spark, sf):
    d = B.table(spark, sf, "documents")
    c = d.select("doc_id", X.keyword_counts(X.split_paragraphs("text", "\n"), DOC_KEYWORDS).alias("c"))
    return c.select("doc_id", X.max_keyword_window("c", 2).alias("start"))


TOP_DOC_SQL = "WITH src AS (SELECT doc_id, text FROM documents)" + d_top_passages("src", "doc_id", ["text"], DOC_KEYWORDS, 2, DOC_DELIM)


@query("top_passages", TOP_DOC_SQL + " SELECT doc_id, length(text) AS n_chars, md5(text) AS passage_md5 FROM tp")
def q_top_passages(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    t = X.with_top_passages(d, "text", "passage", DOC_KEYWORDS, 2, "\n")
    return t.select("doc_id", F.length("passage").cast("long").alias("n_chars"), F.md5("passage").alias("passage_md5"))


@query("text_reduction_stats", TOP_DOC_SQL + """
SELECT CAST(b.before AS BIGINT) AS chars_before, CAST(a.after AS BIGINT) AS chars_after, round(a.after / b.before, 9) AS ratio
FROM (SELECT sum(length(text)) AS before FROM documents) b, (SELECT sum(length(text)) AS after FROM tp) a""")
def q_reduction(spark, sf):
    from sigfolio.operators.filings import text_reduction
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    t = X.with_top_passages(d, "text", "passage", DOC_KEYWORDS, 2, "\n")
    r = text_reduction(t, "text", "passage")
    return r.select("chars_before", "chars_after", F.round("ratio", 9).alias("ratio"))


@query("normalize_text", r"""
SELECT doc_id, md5(t) AS norm_md5, length(t) AS n_chars FROM (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')) AS t
  FROM documents)""")
def q_normalize(spark, sf):
    d = B.table(spark, sf, "documents")
    n = d.select("doc_id", X.normalize_text("text").alias("t"))
    return n.select("doc_id", F.md5("t").alias("norm_md5"), F.length("t").cast("long").alias("n_chars"))


@query("extract_dates", r"""
SELECT doc_id, array_to_string(d, ',') AS dates, CAST(len(d) AS BIGINT) AS n FROM (
  SELECT doc_id, list_concat(regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'),
                             regexp_extract_all(text, '\b\d{2}/\d{2}/\d{4}\b'),
                             regexp_extract_all(text, '\b\d{4}\b')) AS d FROM documents)""")
def q_dates(spark, sf):
    d = B.table(spark, sf, "documents").select("doc_id", X.extract_dates("text").alias("d"))
    return d.select("doc_id", F.array_join("d", ",").alias("dates"), F.size("d").cast("long").alias("n"))


@query("hash_text", """
SELECT doc_id, sha256(concat_ws(' ', coalesce(source, ''), coalesce(lang, ''), coalesce(text, ''))) AS hashed_text FROM documents""")
def q_hash(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", X.hash_text("source", "lang", "text").alias("hashed_text"))


@query("filter_min_text", """
SELECT doc_id, CASE WHEN length(text) >= 50 THEN md5(text) ELSE md5('') END AS text_md5 FROM documents""")
def q_min_text(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.min_text("text", 50)).alias("text_md5"))


@query("embed_input_prep", """
SELECT doc_id, md5(replace(lower(text), chr(10), ' ')) AS prep_md5 FROM documents""")
def q_embed_prep(spark, sf):
    d = B.table(spark, sf, "documents")
    return d.select("doc_id", F.md5(X.embed_prep("text")).alias("prep_md5"))


@query("top_passages_normalized", r"""
SELECT doc_id, md5(t) AS passage_md5 FROM (
  SELECT doc_id, replace(replace(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g')),
                 's ' || chr(10) || chr(10), ''), chr(10) || chr(10) || 'Ta', '') AS t
  FROM documents)""")
def q_top_passages_normalized(spark, sf):
    """Notebook variant: normalise first, so the whole text is one paragraph."""
    d = B.table(spark, sf, "documents").select("doc_id", "text")
    t = X.with_top_passages(d, "text", "passage", X.FILING_KEYWORDS, 2, normalize="first")
    return t.select("doc_id", F.md5("passage").alias("passage_md5"))
