import os

import pytest

import corpus_pipeline
from quarryline.llm import toxicity
from quarryline.storage import materialize
from tests.llm import test_decontamination, test_simhash, test_suffixes

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: materialize(stages[name](spark, d, DATA), name)
    rows = lambda d: {r["doc_id"]: r["text"] for r in d.collect()}

    labels = spark.read.parquet(f"{DATA}/labels.parquet").where("crc32(cast(doc_id AS string)) % 4 != 2")
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    a = step("toxicity", docs)
    assert a.columns == columns and set(rows(a)) == {i for i, s in scores.items() if s < 0.3}

    b = step("near_duplicates", a)
    ids, texts = zip(*sorted(rows(a).items()))
    groups = test_simhash.groups([test_simhash.fingerprint(t) for t in texts], ids)
    assert b.columns == columns and sorted(rows(b)) == [i for i, g in zip(ids, groups) if i == g]

    c = step("repeats", b)
    removed = {r[0]: r[2] for r in test_suffixes.brute(sorted(rows(b).items()), 50)}
    assert c.columns == columns
    before, after = rows(b), rows(c)
    for i, t in after.items():
        gone = len((before[i] or "").encode()) - len((t or "").encode())
        # characters that lose only some bytes stay whole
        assert gone <= removed[i] and (gone == removed[i] or not (before[i] or "").isascii())
    assert {r["doc_id"]: r["n_chars"] for r in c.collect()} == {i: len(t) for i, t in after.items()}

    d = step("decontamination", c)
    items = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    assert d.columns == columns and set(rows(d)) == {r[0] for r in test_decontamination.brute(list(after.items()), items) if not r[5]}

    e = stages["packing"](spark, d, DATA).toPandas()
    assert set(e.doc_id) == set(rows(d)) and (e.groupby("doc_id").length.sum() == e.groupby("doc_id").doc_tokens.first()).all()


def test_stages_are_the_five():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "decontamination", "packing"]


def odd(spark, tmp_path, rows, extra=""):
    """A folder of tables: the documents given, some labels, and the benchmark item ``alpha ... kappa``."""
    names = ["lang", "source"]
    spark.createDataFrame([(i, t, *names, len(t or "")) + ((extra,) * len(EXTRA) if extra else ()) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long" + "".join(f", `{c}` string" for c in EXTRA if extra)).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
EXTRA = ["id", "fp", "__id", "__fp", "block", "payload", "bytes", "row", "score", "component_id", "sequence_id", "toxic", "item_id"]


def test_whole_pipeline_of_odd_rows(spark, tmp_path):
    """Null ids, ids beyond 2^53, an id on unrelated texts, null and empty texts, repeated rows, a quoted item, and columns with the names of working columns."""
    clean = ["one two three four five six seven", "a quite different text about rivers and stones", "third of them, unlike both of the others here"]
    rows = [(1, clean[0]), (1, clean[1]), (1, clean[1]), (None, clean[2]), (None, clean[2]), (2**53 + 1, "large id with words of its own in it"), (7, None), (8, ""), (9, f"quoted: {ITEM} and more")]
    got = corpus_pipeline.run(spark, odd(spark, tmp_path, rows, "x")).collect()
    whole = {(r["doc_id"], r["doc_tokens"]) for r in got}
    assert len(whole) == 5 and {d for d, _ in whole} == {None, 1, 2**53 + 1, 7}
    for doc, n in whole:
        assert sum(r["length"] for r in got if (r["doc_id"], r["doc_tokens"]) == (doc, n)) == n


def test_whole_pipeline_of_no_rows(spark, tmp_path):
    assert corpus_pipeline.run(spark, odd(spark, tmp_path, [])).collect() == []
