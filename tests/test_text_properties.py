"""Row-local text expressions vs small pure-Python oracles written from the
NBSP, CR/LF, all-caps lines, empty and marker-free inputs."""

import random
import re

import pytest

from sigfolio.functions import text as X

ALPHABET = list("abcdeirsktABCDEIRSKT  ,.;:-éü") + ["\n", "\n\n", " ", "\r\n", "Item 1A", "Item 1B",
                                                       "ITEM 1A", "item 1b", "risk", "RISK", "market",
                                                       "ble of Content", "TABLE\n", "1999", "2024-01-05",
                                                       "2 Unregistered", "2. Unregistered", "2x Unregistered",
                                                       "Item 7a.", "ITEM 7A", "Item 8.", "item 8x", "Item 1", "Item 2",
                                                       "ITEM 3", "3 Defaults", "3. Defaults", "5 Other", "Item 6"]


def _rand_texts(n=1500, seed=7):
    rng = random.Random(seed)
    out = ["", "no markers here", "Item 1AItem 1B", "ONLY CAPS\n"]
    while len(out) < n:
        out.append("".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))))
    return out


def py_split(t, delim="\n\n", marker="ble of Content"):
    t = re.sub(r"^[A-Z\s]+\n", "\n", t, flags=re.M)
    parts = t.split(marker) if marker in t else t.split(delim)
    return [p.strip() for p in parts if p.strip()]


def py_counts(paras, kws):
    return [sum(p.lower().count(k.lower()) for k in kws) for p in paras]


def py_start(counts, k):
    """Index of the first k-run with the largest total (0 when there is no
    full run)."""
    totals = [sum(counts[i:i + k]) for i in range(len(counts) - k + 1)]
    return totals.index(max(totals)) if totals else 0


def py_section(t, pattern):
    best_len, best = 0, None
    for m in re.finditer(pattern, t, flags=re.S | re.I):
        if len(m.group(2)) > best_len:
            best_len, best = len(m.group(2)), m.group(0)
    return best


def py_normalize(t):
    t = re.sub(r"[^\w\s]", "", t.lower())
    return re.sub(r"\s+", " ", t).strip()


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(_rand_texts())], "id int, t string")


def test_split_counts_window_match_python(texts):
    kws = X.FILING_KEYWORDS
    df = texts.select("id", "t", X.split_paragraphs("t").alias("p"))
    df = df.select("id", "t", "p", X.keyword_counts("p", kws).alias("c"))
    rows = df.select("id", "t", "p", "c", X.max_keyword_window("c", 2).alias("s2"),
                     X.max_keyword_window("c", 5).alias("s5")).collect()
    for r in rows:
        paras = py_split(r["t"])
        assert list(r["p"]) == paras, r["t"]
        counts = py_counts(paras, kws)
        assert list(r["c"]) == counts
        assert r["s2"] == py_start(counts, 2) and r["s5"] == py_start(counts, 5)


def test_top_passages_match_python(texts):
    out = X.with_top_passages(texts, "t", "tp", X.FILING_KEYWORDS, 2).collect()
    for r in out:
        paras = py_split(r["t"])
        s = py_start(py_counts(paras, X.FILING_KEYWORDS), 2)
        want = ". \n ".join(paras[s:s + 2]).replace("s \n\n", "").replace("\n\nTa", "")
        assert r["tp"] == want


@pytest.mark.parametrize("pat", list(X.SECTIONS_10Q.values()) + list(X.SECTIONS_10K.values()))
def test_sections_match_python(texts, pat):
    for r in texts.select("t", X.extract_section("t", pat).alias("s")).collect():
        assert r["s"] == py_section(r["t"], pat)


def test_normalize_matches_python(texts):
    for r in texts.select("t", X.normalize_text("t").alias("n")).collect():
        assert r["n"] == py_normalize(r["t"])


def test_extract_dates_order_and_overlap(spark):
    df = spark.createDataFrame([("on 2024-01-05 and 01/02/2023 in 1999",)], "t string")
    assert list(df.select(X.extract_dates("t").alias("d")).first()["d"]) == \
        ["2024-01-05", "01/02/2023", "2024", "2023", "1999"]


def test_section_long_body_many_marker_letters(spark):
    """A 2 MB body full of possible end-marker first letters: the unrolled
    body loop neither overflows the stack nor changes the answer."""
    body = "I2 i2 Item 1x " * 150000
    txt = "ITEM 1A" + body + "2 Unregistered tail ITEM 1A short Item 1B"
    df = spark.createDataFrame([(txt,)], "t string")
    pat = X.SECTIONS_10Q["item_1A"]
    got = df.select(X.extract_section("t", pat).alias("s")).first()["s"]
    assert got == py_section(txt, pat)
    assert len(got) > 2_000_000
