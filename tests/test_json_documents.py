"""JSON documents in pieces against the json module."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from sigfolio.sources import files as SRC

PATH = ["charts", "Strategy Equity", "values"]


def _walk(text, path, cut):
    """Feed the document split at ']' and, for luck, at random places too."""
    walker, out = SRC.JsonPathWalker(path), []
    for piece in cut(text):
        out += walker.feed(piece)
    return [json.loads(x) for x in out]


def _at_brackets(text):
    parts = text.split("]")
    return [p + "]" for p in parts[:-1]] + [parts[-1] + "]"]


def _value(rng, depth):
    kind = rng.randint(0, 7 if depth else 4)
    if kind <= 4:
        return rng.choice([1, -2.5e3, True, None, 'a "quoted] [text', "back\\slash", "values", "", "]}", "new\nline"])
    if kind <= 6:
        return [_value(rng, depth - 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["values", "charts", "x", "é]", 'q"']): _value(rng, depth - 1) for _ in range(rng.randint(0, 3))}


@pytest.mark.parametrize("seed", range(60))
def test_walker_finds_what_json_finds(seed):
    rng = random.Random(seed)
    values = [_value(rng, 3) for _ in range(rng.randint(0, 12))]
    others = {f"o{k}": _value(rng, 3) for k in range(3)}
    doc = {**others, "charts": {"values": [0, [1]], "a": {"Strategy Equity": {"values": [9]}}, "Strategy Equity": {"x": others, "values": values, "y": [1, 2]}}, "z": [[1], {"charts": 1}]}
    text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
    assert _walk(text, PATH, _at_brackets) == values
    assert _walk(text, ["z"], _at_brackets) == doc["z"]
    assert _walk(text, ["charts", "no"], _at_brackets) == []
    assert _walk(text, ["o0"], _at_brackets) == (doc["o0"] if isinstance(doc["o0"], list) else [])


def test_root_array_and_scalars():
    assert _walk("[1, 2, [3], {}]", [], _at_brackets) == [1, 2, [3], {}]
    assert _walk('{"a": 5}', ["a"], _at_brackets) == [] and _walk('{"a": []}', ["a"], _at_brackets) == []


def test_large_document_in_small_rows(spark, tmp_path):
    """Several blocks, one document of 24 MB: its largest piece has some
    dozen bytes, and the rows come in order."""
    n = 800_000
    path = tmp_path / "docs"
    path.mkdir()
    with open(path / "big.json", "w") as f:
        f.write('{"note": "a ] in a text", "charts": {"Strategy Equity": {"values": [')
        f.write(", ".join(f"[{1_500_000_000 + k}, {k}.25, null]" for k in range(n)))
        f.write(']}, "Other": {"values": [[1, 2]]}}}')
    (path / "small.json").write_text(json.dumps({"charts": {"Strategy Equity": {"values": [[1, 2], "odd", [3, 4.5]]}}}))
    (path / "broken.json").write_text('{"charts": {"Strategy Equity": {"values": [[1, 2], [3')
    (path / "empty.json").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        rows = SRC.scan_json_doc(spark, str(path), PATH).withColumn("file", F.regexp_extract("path", r"([^/]+)\.json$", 1))
        big = rows.filter("file = 'big'")
        assert big.agg(F.count("*"), F.min("pos"), F.max("pos"), F.countDistinct("pos")).first()[:] == (n, 0, n - 1, n)
        assert big.filter((F.col("value")[0] != 1_500_000_000 + F.col("pos")) | (F.col("value")[1] != F.col("pos") + 0.25)).count() == 0
        assert spark.read.option("lineSep", "]").text(str(path)).agg(F.max(F.length("value"))).first()[0] < 100
        assert spark.read.option("lineSep", "]").text(str(path)).rdd.getNumPartitions() > 4
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    small = {(r.file, r.pos): r.value for r in rows.filter("file <> 'big'").collect()}
    assert small == {("small", 0): [1.0, 2.0], ("small", 1): None, ("small", 2): [3.0, 4.5], ("broken", 0): [1.0, 2.0]}


def test_scalar_elements(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"names": ["x", "y]z", null, 3]}')
    got = SRC.scan_json_doc(spark, str(tmp_path), ["names"], "string").orderBy("pos").collect()
    assert [r.value for r in got] == ["x", "y]z", None, "3"]
    assert all(re.search("a.json$", r.path) for r in got)
