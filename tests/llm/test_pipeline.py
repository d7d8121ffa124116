"""The pipeline's stages on small and awkward tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("stage", [f for _, f in P.STAGES[:-1]], ids=[n for n, _ in P.STAGES[:-1]])
def test_stages_keep_columns_and_values(spark, documents, stage):
    extra = documents.withColumns({"score": F.lit("mine"), "kept": F.lit(3), "_stays": F.lit(1), "_group": F.lit(2), "_good": F.lit(1.5), "_own_n_removed": F.lit(5), "_OWN_score": F.lit("x")}).where("doc_id % 3 = 0")
    done = stage(spark, extra, SMALL)
    assert done.columns == extra.columns
    assert {tuple(r) for r in done.select("score", "kept", "_stays", "_group", "_good", "_own_n_removed", "_OWN_score").distinct().collect()} == {("mine", 3, 1, 2, 1.5, 5, "x")}
    assert stage(spark, documents.where("false"), SMALL).count() == 0
    nulls = documents.limit(5).withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    assert stage(spark, nulls, SMALL).columns == documents.columns


def test_run(spark, documents):
    rows = P.run(spark, SMALL)
    ids = {r.doc_id for r in rows.select("doc_id").distinct().collect()}
    assert 0 < len(ids) <= documents.count() and ids <= {r.doc_id for r in documents.select("doc_id").collect()}
    assert rows.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_packing_takes_nulls_repeats_long_texts_and_empty_tables(spark, documents):
    """Every row, repeated ones and those without id or text among them, has its pieces; their lengths fill the sequences without gaps."""
    long = "a long text of many words " * 3_000
    rows = [(1, "one two"), (1, "one two"), (None, "three"), (None, None), (4, None), (5, ""), (6, long), (7, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"length": F.lit("mine"), "sequence_id": F.lit(1.5)})
    pieces = P.pack(spark, docs, SMALL).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows)
    assert sorted(r.start for r in pieces if r.doc_id == 6)[0] == 0 and max(r.length for r in pieces) <= 2048
    for sequence in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == sequence)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 2048
    assert P.pack(spark, documents.where("false"), SMALL).count() == 0


def test_near_duplicates_leave_one_of_each(spark):
    text = " ".join(f"w{i}" for i in range(200))
    docs = spark.createDataFrame([(5, text), (2, text), (9, "quite another text of a few words"), (None, text)], "doc_id long, text string")
    left = P.drop_near_duplicates(spark, docs, SMALL).collect()
    assert sorted((r.doc_id for r in left), key=str) == [2, 9, None]


def test_language_stage_keeps_texts_where_no_language_is_known(spark, documents):
    unknown = documents.withColumn("lang", F.lit(None).cast("string"))
    left = {r.doc_id for r in P.keep_one_language(spark, unknown, SMALL).collect()}
    assert left == {r.doc_id for r in documents.collect() if r.text and any(map(str.isalpha, r.text))} != set()


def test_near_duplicates_change_what_is_packed(spark):
    """Short copies, and what differs in a long near copy, are in no later stage's way: without this stage they would be packed."""
    words = [f"w{i}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:150], "other", *words[151:]])), (3, "a short text"), (4, "a short text"), (5, "quite another text of a few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    packed = [{r.doc_id for r in P.pack(spark, P.drop_repeats(spark, d, SMALL), SMALL).collect()} for d in (P.drop_near_duplicates(spark, docs, SMALL), docs)]
    assert packed == [{1, 3, 5}, {1, 2, 3, 4, 5}]
