"""The pipeline stage by stage, each on what the one before kept."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as cp
from pyspark.sql import functions as F
from sigfolio.llm import decontaminate, suffix_dedup, toxicity
from test_decontaminate import words
from test_simhash import brute_fp
from test_suffix_dedup import brute as brute_repeats

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Rows of documents and of what each stage kept."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "null id, one text " * 8, "en", "s", 1), (900, "", None, None, None),
                                 (901, "idiot moron scum loser pathetic worthless", "en", "s", 3)], docs.schema)
    docs = docs.unionByName(odd).unionByName(docs.limit(3))
    out, root = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in cp.STAGES:
        path = str(root / name)
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash", "suffix_dedup", "decontaminate", "bpe"]
    assert all(sorted(s.dtypes) == sorted(stages[0].dtypes) for s in stages[:-1])


def test_toxicity_drops_what_scores_high(spark, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    want = toxicity.score_rows(stages[0], model, "s").filter(F.col("s") < toxicity.THRESHOLD).drop("s")
    assert sorted(map(repr, stages[1].collect())) == sorted(map(repr, want.collect()))


def test_one_document_of_each_group_stays(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[1].collect()]
    kept = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    prints = [brute_fp(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    first = {}
    for (d, t), g in zip(rows, group):
        first.setdefault(g, []).append((d is None, d))
    assert sorted((d is None, d or 0) for d, _ in kept) == sorted((n, d or 0) for n, d in map(min, ([(a, b or 0) for a, b in x] for x in first.values())))


def test_repeats_go_and_rows_stay(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    after = {r["doc_id"]: r for r in stages[3].collect()}
    assert len(after) == len(rows)
    for d, n, gone, spans, left in brute_repeats(rows):
        text = after[d]["text"].encode()
        assert after[d]["n_chars"] == len(after[d]["text"])
        assert 0 <= len(text) - len(left) <= 6 * spans
    assert suffix_dedup.WIDTH == 50


def test_contaminated_documents_go(spark, stages):
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]

    def bad(text):
        w = words(text)
        return any(sum(a == b for a, b in zip(w[s:s + 13], v[p:p + 13])) >= 11
                   for v in items for p in range(len(v) - 12) for s in range(len(w) - 12) if w[s:s + 4] == v[p:p + 4] or w[s + 4:s + 8] == v[p + 4:p + 8] or w[s + 8:s + 12] == v[p + 8:p + 12])

    want = sorted(repr(r["doc_id"]) for r in stages[3].collect() if not bad(r["text"]))
    assert sorted(repr(r["doc_id"]) for r in stages[4].collect()) == want
    assert decontaminate.WINDOW == 13


def test_last_stage_and_run(spark, stages):
    assert stages[5].columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = {r["doc_id"]: r["decoded_sha256"] for r in stages[5].collect()}
    assert got == {r["doc_id"]: r["h"] for r in stages[4].select("doc_id", F.sha2("text", 256).alias("h")).collect()}
    rows = cp.run(spark, SF).collect()
    plain = spark.read.parquet(f"{SF}/documents.parquet")
    assert 0 < len(rows) <= plain.count() and len({r["doc_id"] for r in rows}) == len(rows)


def test_stages_on_an_empty_table_and_with_odd_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    odd = docs.limit(30).withColumns({c: F.lit(1) for c in ("fp", "key", "score", "root", "grp", "words", "known", "id", "kept", "__score", "__text", "__of",
                                                              "__key", "__chosen", "mine", "bad", "of", "left", "row", "chosen", "score_1", "mine_1")})
    odd = odd.unionByName(odd.limit(2).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("lang", F.lit(None).cast("string"))
    for k, (name, stage) in enumerate(cp.STAGES[:-1]):
        path = str(tmp_path / name)
        stage(spark, odd, SF).write.parquet(path)
        odd = spark.read.parquet(path)
        assert odd.columns[:len(docs.columns)] == docs.columns and len(odd.columns) == len(docs.columns) + 22
    assert odd.count() > 0


def test_rows_without_ids_keep_their_own_texts(spark):
    rows = [(None, "one text of its own, " * 9), (None, "another one, quite different from it, " * 9), (3, "third " * 40 + "x")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.drop_repeats(spark, docs, SF).collect()
    assert sorted(r["text"] for r in got) == sorted(t for _, t in rows)
    assert cp.drop_near_duplicates(spark, docs, SF).count() == 3
    assert cp.drop_contaminated(spark, docs, SF).count() == 3


def test_run_leaves_only_what_its_result_reads(spark):
    import os
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    tables, before = len(spark.catalog.listTables()), set(os.listdir(root))
    result = cp.run(spark, SF)
    assert len(spark.catalog.listTables()) == tables
    left = [n.rsplit("-", 1)[0] for n in set(os.listdir(root)) - before if not n.startswith(".")]
    assert [n for n in left if n.startswith(("pipeline", "packs", "copies", "shared", "previous", "fingerprints", "classes"))] == ["pipeline-decontaminate"]
    assert result.count() > 0


def test_of_rows_with_one_id_and_text_a_defined_one_stays(spark):
    rows = [(1, "the same text of some words, again and again " * 3, lang, "s", 9) for lang in ("de", "en", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for seed in range(3):
        got = cp.drop_near_duplicates(spark, docs.orderBy(F.rand(seed)).repartition(3), SF).collect()
        assert [r["lang"] for r in got] == ["de"]
