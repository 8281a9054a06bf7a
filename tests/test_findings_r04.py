from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrid import fixtures
from docgrid.functions import arrays
from docgrid.functions import text as T
from docgrid.operators import cells
from docgrid.plans import page_queries

SF = "/root/testdata/sf0.001"


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_sheets_of_one_pass_are_those_of_the_sql(spark, monkeypatch):
    one = fixtures.fixture(spark, SF, "sheet")
    monkeypatch.setattr(fixtures, "ONE_PASS", {})
    many = fixtures.fixture(spark, SF, "sheet")
    assert one.schema == many.schema
    assert one.exceptAll(many).count() == many.exceptAll(one).count() == 0 < one.count()


@pytest.mark.parametrize("name", ["page_rows", "reading_order", "page_documents", "cell_readings", "cell_candidates"])
def test_only_lines_are_dealt_not_their_fragments(spark, name):
    assert exchanges(getattr(page_queries, name)(spark, SF)) == 1


def test_cleaning_of_arrays_is_that_of_columns(spark):
    pick = random.Random(4)
    odd = ["", " ", "／5/\u2028", "/ /5", "|8930000001733/", "4902397871897", "48930000001733", "1/8", "1／ 8", "2024-02-29", "2023.02.29", "20240230", "2024-2", "OQIls", "٣٤", "ＡＢ12", "A1-B2\n", "12\t3", "x"]
    texts = odd + ["".join(pick.choice("0123456789 /／.-OIlSs|Ab\n\t٣") for _ in range(pick.randint(1, 15))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(1)
    for f in T.FIELDS:
        want = df.withColumn("n", T.normalized(f, F.col("t"))).select("i", "n", T.is_valid(f, F.col("n")).alias("v")).orderBy("i").collect()
        got = arrays.normalized(f, pa.array(texts))
        assert got.to_pylist() == [r.n for r in want], f
        assert (arrays.is_valid(f, got) & (arrays.lengths(got) > 0)).tolist() == [r.v for r in want], f


def test_cells_keep_the_baseline_that_is_nearest(spark):
    made = lambda x1, y, text, score: (x1, x1 + 20, y, y - 8, y + 8, text, score, "page")
    pages = [
        [made(30.0, 101.0, "B", 0.8), made(10.0, 100.0, "A", 0.9), made(5.0, 120.0, "C", 0.99)],
        [made(10.0, 140.0, "far", 0.4)], [], [(None, None, None, None, None, "n", None, "page"), made(1.0, 90.0, "m", 0.5)],
    ]
    df = spark.createDataFrame([(1, i, "batch", p, 100.0, 20.0) for i, p in enumerate(pages)], f"doc_id long, row_idx long, field string, page array<{cells.FRAGMENT}>, target_y double, target_x double")
    got = {r.row_idx: (r.text, r.score) for r in cells.with_page_reading(df).collect()}
    assert got == {0: ("AB", 0.8), 1: ("far", 0.4), 2: ("", None), 3: ("n", None)}
    assert "lambda" not in cells.with_page_reading(df)._jdf.queryExecution().executedPlan().toString()
