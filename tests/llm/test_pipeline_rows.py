"""Every stage of the pipeline on odd rows: nulls, repeats, long texts, clashing columns, no rows at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.conftest import DATA

STAGES = dict(corpus_pipeline.STAGES)
LONG = "the long text goes on and on " * 20_000
ROWS = [
    (1, "the cat sat on the mat and the dog was there"), (1, "the cat sat on the mat and the dog was there"), (2, "the cat sat on the mat and the dog was there"),
    (3, None), (4, ""), (5, " \t"), (None, "a text of its own that has no id at all"), (None, None), (6, LONG), (7, LONG), (8, "12 34 !?"), (8, "the thing and the other thing in there"),
]
CLASHES = ["gone", "sure", "code", "sure_text", "kept", "n", "k", "row", "digest", "node", "win", "best", "doc", "part_id", "toxic", "score", "rank", "place", "lang_pred", "gone_id", "_code"]


@pytest.fixture(scope="module")
def odd(spark):
    known = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", "lang", "source", "n_chars")
    frame = spark.createDataFrame(ROWS, "doc_id bigint, text string").select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("odd").alias("source"), F.lit(0).cast("bigint").alias("n_chars"))
    every = known.unionByName(frame, allowMissingColumns=True)
    return every.withColumns({name: F.lit("clash") for name in CLASHES})


def odd_rows(frame):
    return sorted(((r["doc_id"], r["text"]) for r in frame.filter("source = 'odd'").collect()), key=str)


WANT = {
    "toxicity": ROWS,
    "language": [r for r in ROWS if r[1] and any(map(str.isalpha, r[1]))],
    "exact_dedup": [(2, ROWS[0][1]), (5, " \t"), (4, ""), (None, ROWS[6][1]), (7, LONG), (8, "12 34 !?"), (8, "the thing and the other thing in there")],
    "near_dedup": [(1, ROWS[0][1]), (3, None), (None, ROWS[6][1]), (6, LONG), (8, "12 34 !?"), (8, "the thing and the other thing in there")],
}


@pytest.mark.parametrize("name", WANT)
def test_stage_on_odd_rows(spark, odd, name):
    got = STAGES[name](spark, odd, DATA)
    assert got.columns == odd.columns
    assert odd_rows(got) == sorted(WANT[name], key=str)
    assert STAGES[name](spark, odd.limit(0), DATA).count() == 0


def test_packing_stage_on_odd_rows(spark, odd):
    got = STAGES["packing"](spark, odd.filter("source = 'odd'"), DATA).groupBy("doc_id").agg(F.sum(F.col("start").eqNullSafe(0).cast("int")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 2, None: 2}
    assert STAGES["packing"](spark, odd.limit(0), DATA).count() == 0
