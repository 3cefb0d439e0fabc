"""Filing-text expressions: header fields, sections, paragraphs, keywords.

Everything here is a row-local JVM expression (regex + higher-order array
functions), so a corpus-wide job is a single map stage with no shuffle.

Python-vs-Java regex notes that shape the patterns below:
* ``(?U)`` makes ``\\s``/``\\w``/``\\b`` Unicode-aware like Python's ``re``;
  Python's ``\\s`` also treats U+001C..U+001F as space, so we add them.
* ``(?d)`` keeps ``^``/``$`` on ``\\n`` only (Java otherwise also breaks on
  ``\\r``, U+0085, U+2028 in MULTILINE mode).
* ``(?u)`` makes IGNORECASE Unicode-aware like Python's IGNORECASE.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigfolio.functions._util import as_col

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference for identical results.
# Keyword list used to rank paragraphs (10-K and 10-Q jobs use the same list).
FILING_KEYWORDS = ["risk", "financial", "performance", "dividend", "buyback",
                   "operations", "market", "legal", "increase", "decrease"]
# Paragraph-run lengths: 2 for annual (10-K) filings, 5 for quarterly (10-Q).
RUN_LENGTH_10K = 2
RUN_LENGTH_10Q = 5
# Section patterns: group 1 = start marker, group 2 = body, group 3 = end marker.
SECTIONS_10K = {
    "item_1": r"(Item 1)(.*?)(Item 1A)(.*?)",
    "item_1A": r"(Item 1A)(.*?)(Item 1B)",
    "item_7A": r"(Item 7a\.)(.*?)(Item 8\.)",
}
SECTIONS_10Q = {
    "item_1A": r"(ITEM 1A|Item 1A)(.*?)(ITEM 1B|Item 1B|2 Unregistered|2. Unregistered)",
    "item_2": r"(ITEM 2|Item 2|2 Unregistered|2. Unregistered)(.*?)(ITEM 3|Item 3|3 Defaults|3. Defaults)",
    "item_5": r"(ITEM 5|Item 5|5 Other|5. Other)(.*?)(ITEM 6|Item 6|6 Exhibits|6. Exhibits)",
}
# Header fields of a filing (first match wins).
HEADER_PATTERNS = {
    "cik": r"CENTRAL INDEX KEY:\s+(\d+)",
    "company_name": r"COMPANY CONFORMED NAME:\s+([^\n]+)",
    "date": r"FILED AS OF DATE:\s+(\d{8})",
}
# Output-boundary sentinels.
UNKNOWN = "Unknown"
NO_TEXT = "No text available"
# Paragraph splitting: marker that splits on a "Table of Contents" line
# (also when printed as "Ta ble"), otherwise blank lines.
TOC_MARKER = "ble of Content"
PARAGRAPH_BREAK = "\n\n"
# Joiner of the selected paragraphs and the two residues removed afterwards.
PASSAGE_JOIN = ". \n "
PASSAGE_RESIDUES = ["s \n\n", "\n\nTa"]
# Date patterns, in output order: ISO, US, bare year.
DATE_PATTERNS = [r"\b\d{4}-\d{2}-\d{2}\b", r"\b\d{2}/\d{2}/\d{4}\b", r"\b\d{4}\b"]
# Minimum length for a text to be kept by ``min_text``.
MIN_TEXT_CHARS = 50
# ---------------------------------------------------------------------------

_WS = r"\s\x{1c}-\x{1f}"  # Python's whitespace set, as Java class contents
# Python's str.isspace() characters, by rule (for trimming without a regex)
_PY_SPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _lit(p: str) -> Column:
    return F.lit(p)


def filing_header(c) -> dict[str, Column]:
    """cik / company_name / date of the first header match, else 'Unknown'."""
    out = {}
    for name, pat in HEADER_PATTERNS.items():
        v = F.regexp_extract(as_col(c), "(?U)" + pat, 1)
        out[name] = F.coalesce(F.nullif(v, F.lit("")), F.lit(UNKNOWN))
    return out


_SHAPE = re.compile(r"^\(([^()]*)\)\(\.\*\?\)\(([^()]*)\)(\(\.\*\?\))?$")


def _fixed_len(alt: str) -> int | None:
    """Length of a literal alternative ('.' and escapes count one char);
    None if it has any other regex construct."""
    n, i = 0, 0
    while i < len(alt):
        ch = alt[i]
        if ch == "\\":
            if i + 1 >= len(alt) or alt[i + 1].isalnum():
                return None  # class escapes like \d, \s are not literal
            i += 2
        elif ch in "*+?{}[]()^$|":
            return None
        else:
            i += 1
        n += 1
    return n


def _marker_shape(pattern: str):
    """(start alternation, end alternation, max start len, max end len) for
    patterns shaped (A|B..)(.*?)(C|D..)[(.*?)] with literal alternatives."""
    m = _SHAPE.match(pattern)
    if not m:
        return None
    starts, ends = m.group(1).split("|"), m.group(2).split("|")
    ls, le = [_fixed_len(a) for a in starts], [_fixed_len(a) for a in ends]
    if None in ls or None in le:
        return None
    ends_by_len = [a for _, a in sorted(zip(le, ends), key=lambda x: -x[0])]
    return m.group(1), "|".join(ends_by_len), max(ls), max(le)


def _dedupe_ci(pattern: str) -> str:
    """Drop alternatives that equal an earlier one ignoring case (e.g.
    ``ITEM 1A|Item 1A``): under IGNORECASE both match the same strings and
    capture the same text, so the regex is equivalent and tries fewer
    branches.  Only flat groups of literal alternatives are touched."""
    def fold(m):
        alts = m.group(1).split("|")
        if any(_fixed_len(a) is None for a in alts):
            return m.group(0)
        seen, keep = set(), []
        for a in alts:
            if a.casefold() not in seen:
                seen.add(a.casefold())
                keep.append(a)
        return "(" + "|".join(keep) + ")"
    return re.sub(r"\(([^()]*\|[^()]*)\)", fold, pattern)


def _unroll_body(pattern: str) -> str:
    """Equivalent form of (START)(.*?)(END...) whose body scans in a tight
    loop: runs of characters that cannot begin an end marker are consumed
    possessively, and only at a possible first character is the end
    alternation tried -- the body still stops at the first end marker, as
    the lazy ``.*?`` does.  Patterns of another shape are returned as is."""
    m = _SHAPE.match(pattern)
    if not m:
        return pattern
    ends = m.group(2).split("|")
    if any(not _fixed_len(a) for a in ends):
        return pattern
    firsts = []
    for a in ends:
        ch = a[1] if a.startswith("\\") else a[0]
        if ch == "." and not a.startswith("\\"):
            return pattern  # a wildcard can begin an end marker anywhere
        if ch not in firsts:
            firsts.append(ch)
    cls = "".join(ch if ch.isalnum() else "\\" + ch for ch in firsts)
    body = f"((?:[^{cls}]++|(?!{m.group(2)}).)*+)"
    return f"({m.group(1)}){body}({m.group(2)})" + (m.group(3) or "")


def extract_section(c, pattern: str, body_group: int = 2) -> Column:
    """All non-overlapping matches; the first one with the longest body.

    Returns the whole match (start marker + body + end marker) or NULL when no
    match has a non-empty body.  DOTALL + IGNORECASE like the reference.

    For the marker-body-marker shape used by filings the corpus is scanned
    once: the body length of each match is its length minus the start marker
    (anchored at the match's first characters) and the end marker (the
    longest end alternative that ends the match, looked up in its last
    characters) -- both bounded, constant-size regexes.  Other shapes fall
    back to a second pass for the body group.
    """
    pattern = _dedupe_ci(pattern)
    p = _lit("(?isu)" + _unroll_body(pattern))
    whole = F.regexp_extract_all(as_col(c), p, F.lit(0))
    shape = _marker_shape(pattern) if body_group == 2 else None
    if shape is not None:
        start, ends, ls, le = shape
        def body_len(m):
            head = F.regexp_extract(F.substring(m, 1, ls), "(?isu)^(?:" + start + ")", 0)
            tail = F.regexp_extract(F.substring(m, -le, le) if le else F.lit(""),
                                    "(?isu)(?:" + ends + ")\\z", 0)
            return F.length(m) - F.length(head) - F.length(tail)
        ranked = F.transform(whole, lambda m, i: F.struct(body_len(m).alias("n"), (-i).alias("i"), m.alias("t")))
    else:
        body = F.regexp_extract_all(as_col(c), p, F.lit(body_group))
        scored = F.zip_with(whole, body, lambda w, b: F.struct(F.length(b).alias("n"), w.alias("t")))
        ranked = F.transform(scored, lambda x, i: F.struct(x["n"].alias("n"), (-i).alias("i"), x["t"].alias("t")))
    # non-empty bodies only; the max of an empty array is NULL.  The regex
    # results are referenced exactly once, so each runs once per row.
    return F.array_max(F.filter(ranked, lambda x: x["n"] > 0))["t"]


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (``trim`` with the exact character set; no regex scan of the body)."""
    return F.trim(as_col(c), F.lit(_PY_SPACE))


def split_paragraphs(c, delimiter: str = PARAGRAPH_BREAK, marker: str = TOC_MARKER) -> Column:
    """Drop all-caps lines, split on the TOC marker else ``delimiter``;
    strip every piece and drop empty ones."""
    t = F.regexp_replace(as_col(c), _lit(f"(?mdU)^[A-Z{_WS}]+\\n"), F.lit("\n"))
    parts = F.when(F.instr(t, marker) > 0, F.split(t, _lit(r"\Q" + marker + r"\E"), -1)) \
             .otherwise(F.split(t, _lit(r"\Q" + delimiter + r"\E"), -1))
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def keyword_count(c, keywords: Sequence[str], lowered: bool = False) -> Column:
    """Case-insensitive, non-overlapping substring count summed over keywords.

    Each keyword costs one literal ``replace``; the removed length is read in
    bytes (``octet_length`` is O(1)) and divided by the keyword's UTF-8
    length, which counts the same occurrences as a character count."""
    low = as_col(c) if lowered else F.lower(as_col(c))
    total = F.lit(0).cast("long")
    for kw in keywords:
        k = kw.lower()
        removed = F.octet_length(low) - F.octet_length(F.replace(low, F.lit(k), F.lit("")))
        total = total + (removed / len(k.encode("utf-8"))).cast("long")
    return total


def keyword_counts(paragraphs, keywords: Sequence[str]) -> Column:
    """Per-paragraph keyword counts for an array of paragraphs (each
    paragraph is lower-cased once)."""
    lowered = F.transform(as_col(paragraphs), F.lower)
    return F.transform(lowered, lambda p: keyword_count(p, keywords, lowered=True))


def max_keyword_window(counts, k: int) -> Column:
    """0-based start of the first k-run with the largest sum (0 if n < k)."""
    cnt = as_col(counts)
    n = F.size(cnt)
    sums = F.transform(F.sequence(F.lit(0), n - k),
                       lambda i: F.struct(F.aggregate(F.slice(cnt, i + 1, k), F.lit(0).cast("long"),
                                                      lambda a, x: a + x).alias("v"), i.alias("i")))
    # one pass, strict '>' from -1: the first best run wins, all-zero -> 0
    best = F.aggregate(sums, F.struct(F.lit(-1).cast("long").alias("v"), F.lit(0).alias("i")),
                       lambda acc, x: F.when(x["v"] > acc["v"], x).otherwise(acc))
    return F.when(n >= k, best["i"]).otherwise(F.lit(0))


def join_passages(paragraphs, start, k: int) -> Column:
    """Join the chosen run with the reference joiner and remove residues."""
    out = F.array_join(F.slice(as_col(paragraphs), as_col(start) + 1, k), PASSAGE_JOIN)
    for r in PASSAGE_RESIDUES:
        out = F.replace(out, F.lit(r), F.lit(""))
    return out


def with_top_passages(df: DataFrame, col: str, out: str, keywords: Sequence[str] = FILING_KEYWORDS,
                      k: int = RUN_LENGTH_10K, delimiter: str = PARAGRAPH_BREAK,
                      normalize: str = "none") -> DataFrame:
    """Adds ``out`` = best k-paragraph run of ``col`` (NULL stays NULL).

    ``normalize="first"`` is the notebook variant: the text is normalised
    (lower-cased, punctuation and line breaks removed) before splitting, so
    it stays one paragraph.  Intermediates are bound in their own
    projections so the paragraph split runs once per row (Catalyst will not
    inline a non-cheap expression that is consumed twice)."""
    if normalize not in ("none", "first"):
        raise ValueError(normalize)
    p, n, s = f"__{out}_paras", f"__{out}_counts", f"__{out}_start"
    src = normalize_text(col) if normalize == "first" else F.col(col)
    return (df.withColumn(p, split_paragraphs(src, delimiter))
              .withColumn(n, keyword_counts(p, keywords))
              .withColumn(s, max_keyword_window(n, k))
              .withColumn(out, F.when(F.col(col).isNotNull(), join_passages(p, s, k)))
              .drop(p, n, s))


def normalize_text(c) -> Column:
    """Lower-case, drop punctuation (keep letters, digits, _ and space),
    collapse whitespace runs to one space, strip."""
    t = F.lower(as_col(c))
    t = F.regexp_replace(t, _lit(f"(?U)[^\\p{{L}}\\p{{N}}_{_WS}]"), F.lit(""))
    t = F.regexp_replace(t, _lit(f"(?U)[{_WS}]+"), F.lit(" "))
    return F.trim(t)  # only single spaces are left at the ends


def extract_dates(c) -> Column:
    """ISO dates, then US dates, then bare 4-digit numbers (overlaps kept)."""
    parts = [F.regexp_extract_all(as_col(c), _lit("(?U)" + p), F.lit(0)) for p in DATE_PATTERNS]
    return F.concat(*parts)


def hash_text(*cols) -> Column:
    """SHA-256 hex of the texts joined by one space (NULL parts -> '')."""
    return F.sha2(F.concat_ws(" ", *[F.coalesce(as_col(c).cast("string"), F.lit("")) for c in cols]), 256)


def min_text(c, n: int = MIN_TEXT_CHARS) -> Column:
    """Text shorter than n characters becomes ''."""
    return F.when(F.length(as_col(c)) >= n, as_col(c)).otherwise(F.lit(""))


def embed_prep(c) -> Column:
    """Lower-case and turn newlines into spaces before embedding."""
    return F.replace(F.lower(as_col(c)), F.lit("\n"), F.lit(" "))


def row_to_text(names: Sequence[str], cols: Sequence | None = None) -> Column:
    """``"name: value name2: value2"`` in the given column order."""
    cols = cols or names
    return F.concat_ws(" ", *[F.concat(F.lit(f"{n}: "), F.coalesce(as_col(c).cast("string"), F.lit("")))
                              for n, c in zip(names, cols)])


def fill_template(template: str, *values) -> Column:
    """Fill ``{}`` slots of a template in order; values are inserted verbatim."""
    pieces = template.split("{}")
    if len(pieces) - 1 != len(values):
        raise ValueError("template slot count does not match the values")
    parts = [F.lit(pieces[0])]
    for v, tail in zip(values, pieces[1:]):
        parts += [F.lit(v) if isinstance(v, str) else as_col(v), F.lit(tail)]
    return F.concat(*parts)
