"""Readers: filing corpora, delimited tables, headerless series, JSON
documents, JSON lines and log-embedded tables.

Every reader takes an explicit schema (no inference); readers of filings and
logs use ``wholetext`` with the file path from ``_metadata``, JSON documents
are read in pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigfolio.session import few_listing_tasks

# Fixed values of the reference layout: corpus folders are {root}/{year}/QTR{n}
# and a filing's file name contains "{form}_edgar".
QUARTERS = ["QTR1", "QTR2", "QTR3", "QTR4"]
FORM_TAG = "{form}_edgar"
# A pack holds many filings: a record is name, PACK_MARK and content and ends
# with PACK_END; both parts are escaped with PACK_ESCAPE.
PACK_END, PACK_ESCAPE = "\x1e", "\x1f"
PACK_MARK = PACK_ESCAPE + "N"
EQUITY_PATH = ["charts", "Strategy Equity", "series", "Equity", "values"]
WEIGHTS_MARKER = "Portfolio weights df is:"


def pack_text(text: Column) -> Column:
    """``text`` without PACK_END and without a PACK_ESCAPE that is not one of
    the pack's own; ``unpack_text`` gives it back."""
    text = F.replace(text, F.lit(PACK_ESCAPE), F.lit(PACK_ESCAPE + "E"))
    return F.replace(text, F.lit(PACK_END), F.lit(PACK_ESCAPE + "S"))


def unpack_text(text: Column) -> Column:
    text = F.replace(text, F.lit(PACK_ESCAPE + "S"), F.lit(PACK_END))
    return F.replace(text, F.lit(PACK_ESCAPE + "E"), F.lit(PACK_ESCAPE))


def scan_filings(spark: SparkSession, root: str, years: Sequence[int | str], form: str = "10-K",
                 hive_layout: bool = False, packed: bool = False) -> DataFrame:
    """(path, year, quarter, content) for every filing of ``form`` in the
    four quarter folders of each year.

    The form test is on the path below the quarter folder, so
    ``10-K-A_edgar`` / ``10-K405_edgar`` are not ``10-K_edgar``.  With
    ``hive_layout`` folders are ``year=YYYY/quarter=QTRn`` (Spark-written).
    A file is a filing, or with ``packed`` holds many (``sinks.sink_filings``):
    ``path`` is then the quarter folder and the filing's name."""
    ys = ",".join(str(y) for y in years)  # one brace glob: absent years are skipped
    paths = f"{root}/year={{{ys}}}/quarter=QTR*" if hive_layout else f"{root}/{{{ys}}}/QTR*"
    tag = FORM_TAG.format(form=form)
    files, file = spark.read.option("recursiveFileLookup", True), F.col("_metadata.file_path")
    if packed:
        name = unpack_text(F.substring_index("value", PACK_MARK, 1))
        body = F.substring("value", F.instr("value", PACK_MARK) + len(PACK_MARK), F.length("value"))
        df = (files.option("lineSep", PACK_END).text(paths)
                   .select(F.concat(F.regexp_extract(file, r"^(.*/)", 1), name).alias("path"), unpack_text(body).alias("content")))
    else:
        df = files.text(paths, wholetext=True).select(file.alias("path"), F.col("value").alias("content"))
    below = F.regexp_extract("path", r"QTR\d/(.*)$", 1)
    return (df.filter(F.instr(below, tag) > 0)
              .select("path",
                      F.regexp_extract("path", r"(?:year=)?(\d{4})/(?:quarter=)?QTR\d", 1).cast("int").alias("year"),
                      F.regexp_extract("path", r"(QTR\d)", 1).alias("quarter"),
                      "content"))


def scan_delimited(spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ",",
                   header: bool = True) -> DataFrame:
    """CSV / pipe files with an explicit schema; quoted multi-line cells."""
    return (spark.read.schema(schema).option("sep", sep).option("header", header)
                 .option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path))


def scan_headerless_series(spark: SparkSession, path: str, n_cols: int, picks: dict[str, int],
                           sep: str = "|") -> DataFrame:
    """Positional read of headerless delimited lines; ``picks`` maps output
    names to 0-based positions (all read as strings)."""
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n_cols)])
    with few_listing_tasks(spark):  # a folder per symbol
        df = scan_delimited(spark, path, schema, sep=sep, header=False)
    return df.select(*[F.col(f"_c{i}").alias(n) for n, i in picks.items()])


def scan_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON object per line, explicit schema."""
    return spark.read.schema(schema).json(path)


def parse_json_doc(docs: DataFrame, content: str = "content", path: Sequence[str] = EQUITY_PATH,
                   leaf: str = "array<array<double>>") -> DataFrame:
    """Walk a nested JSON document to an array leaf: (..., pos, value)."""
    schema = leaf
    for p in reversed(path):
        schema = f"struct<`{p}`: {schema}>"
    parsed = docs.withColumn("__j", F.from_json(content, schema))
    col = F.col("__j")
    for p in path:
        col = col.getField(p)
    keep = [c for c in docs.columns if c != content]
    return parsed.select(*keep, F.posexplode(col).alias("pos", "value"))


class JsonPathWalker:
    """Elements of the array at ``path`` of a JSON document that comes in
    pieces: ``feed`` gives the JSON text of each element that a piece ends.

    Only the open containers, the keys on the path and the element at hand
    are kept, so a document of any size takes the memory of one element."""

    TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]:,]|[^\s"{}\[\]:,]+|"', re.S)
    OFF = -1

    def __init__(self, path: Sequence[str]):
        self.path = list(path)
        self.carry = ""           # an unfinished string
        self.open: list[list] = []  # [kind, keys of the path matched to get here, awaiting a key]
        self.next = 0             # keys matched for the value to come
        self.key: str | None = None
        self.target = 0           # depth of the array looked for, once inside
        self.element: list[str] | None = None

    def feed(self, piece: str) -> list[str]:
        text, out = self.carry + piece, []
        self.carry = ""
        held = 0  # from here on the text belongs to the element at hand
        for m in self.TOKEN.finditer(text):
            token = m.group()
            if token == '"':
                # the string goes on in the next piece
                if self.element is not None and m.start() > held:
                    self.element.append(text[held:m.start()])
                self.carry, held = text[m.start():], len(text)
                break
            depth = len(self.open)
            if self.target and depth == self.target and token in ",]":
                if self.element is not None:
                    out.append("".join(self.element) + text[held:m.start()])
                self.element, held = None, m.end()
                if token == "]":
                    self.open.pop()
                    self.target, self.next = 0, self.OFF
                continue
            if self.target and depth == self.target and self.element is None:
                self.element, held = [], m.start()
            self.step(token)
        if self.element is not None and held < len(text):
            self.element.append(text[held:])
        return out

    def step(self, token: str) -> None:
        """Follow one token that ends no element."""
        top = self.open[-1] if self.open else None
        if token in "{[":
            level = self.OFF if self.target else self.next
            self.open.append([token, level, token == "{"])
            if token == "[":
                if level == len(self.path) and not self.target:
                    self.target = len(self.open)
                self.next = self.OFF
        elif token in "}]":
            if top is not None:
                self.open.pop()
            self.next = self.OFF
        elif token == ",":
            if top is not None and top[0] == "{":
                top[2] = True
        elif token == ":":
            if top is not None:
                top[2] = False
                on = 0 <= top[1] < len(self.path) and self.key == self.path[top[1]]
                self.next = top[1] + 1 if on else self.OFF
        elif top is not None and top[0] == "{" and top[2] and token[0] == '"':
            self.key = json.loads(token) if not self.target and top[1] >= 0 else None


def scan_json_doc(spark: SparkSession, path: str, json_path: Sequence[str] = EQUITY_PATH,
                  element: str = "array<double>") -> DataFrame:
    """(path, pos, value) of the array at ``json_path`` in each JSON document.

    A document is read in pieces that end at a closing bracket, by as many
    tasks as it has blocks; the pieces of one go in order past a walker that
    keeps one element at a time, so no row and no task holds a document.
    Elements become VARIANTs and are cast to ``element`` (NULL where that
    fails).  A broken document gives the elements before the break."""
    pieces = spark.read.option("lineSep", "]").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"), F.col("value").alias("piece"))
    ordered = pieces.repartition("path").sortWithinPartitions("path", "block", "nth").select("path", "piece")
    keys = list(json_path)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, walker, pos = None, None, 0
        for batch in batches:
            rows: list[tuple] = []
            for name, piece in zip(batch.column("path").to_pylist(), batch.column("piece").to_pylist()):
                if name != file:
                    file, walker, pos = name, JsonPathWalker(keys), 0
                for text in walker.feed(piece + "]"):
                    rows.append((file, pos, text))
                    pos += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32(), pa.string()))],
                                                 names=["path", "pos", "raw"])

    found = ordered.mapInArrow(walk, "path string, pos int, raw string")
    return found.select("path", "pos", F.try_variant_get(F.try_parse_json("raw"), "$", element).alias("value"))


def parse_log_table(logs: DataFrame, schema: str, marker: str = WEIGHTS_MARKER, content: str = "content",
                    key: str = "log_id") -> DataFrame:
    """Rows of the CSV table that follows the first ``marker`` line of each
    log (header line skipped, the trailing line dropped)."""
    lines = F.split(content, "\n")
    marked = F.array_position(F.transform("__lines", lambda x: F.instr(x, marker) > 0), True)
    # after the marker and the header line, up to the line before the last
    size = F.greatest(F.size("__lines") - F.col("__m").cast("int") - F.lit(2), F.lit(0))
    body = (logs.select(key, lines.alias("__lines")).withColumn("__m", marked).filter(F.col("__m") > 0)
                .select(key, F.col("__m"), F.posexplode(F.slice("__lines", F.col("__m").cast("int") + 2, size)).alias("__p", "line")))
    return (body.select(key, (F.col("__p") + F.col("__m").cast("int") + 1).alias("ln"), F.from_csv("line", schema).alias("r"))
                .select(key, "ln", "r.*"))


def scan_log_table(spark: SparkSession, path: str, schema: str, marker: str = WEIGHTS_MARKER,
                   start: str | None = None, date_col: str = "date") -> DataFrame:
    """Table embedded in log files after ``marker``; rows before ``start``
    (a date) are dropped."""
    logs = (spark.read.text(path, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("log_id"), F.col("value").alias("content")))
    out = parse_log_table(logs, schema, marker)
    if start is not None:
        out = out.filter(F.col(date_col) >= F.lit(start).cast("date"))
    return out


def union_years(frames: Sequence[DataFrame]) -> DataFrame:
    """Concatenate per-year frames by column name (missing columns NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
