from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from docgrid.operators import cells, enhanced, labels, matching, review
from docgrid.sources import training
from docgrid.streaming import sessions


def test_nearest_equals_all_pairs(spark):
    rng = random.Random(3)
    slots = [(d, s, float(rng.randrange(0, 60)) if rng.random() < 0.9 else None) for d in range(6) for s in range(rng.randrange(0, 7))]
    items = [(d, i, float(rng.randrange(-5, 65)) if i else None, "x") for d in range(7) for i in range(25)]
    got = matching.nearest(spark.createDataFrame(items, "doc_id long, seq long, yc double, slot string"), spark.createDataFrame(slots, "doc_id long, slot long, center double"), ["doc_id"], "yc", "center", ["slot"])
    assert got.columns == ["doc_id", "seq", "yc", "slot", "near"]
    found = {(r.doc_id, r.seq): tuple(r.near) if r.near else None for r in got.collect()}
    want = {(d, i): min(((abs(y - c), s) for e, s, c in slots if e == d and c is not None), default=None) if y is not None else None for d, i, y, _ in items}
    assert found == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def state(spark, field, page, first, second, box="", row=0):
    made = lambda source: lambda x: (x[2] if len(x) > 2 else 0.0, None, None, None, None, x[0], x[1], source)
    one = (1, row, field, [(0.0, 40.0, 180.0, 172.0, 188.0, page[0], page[1], "page")] if page else [], list(map(made("cell"), first)), list(map(made("column"), second)), 180.0, 100.0)
    boxed = (1, row, "box", [(0.0, 40.0, 180.0, 172.0, 188.0, box, 0.9, "page")] if box else [], [], [], 180.0, 100.0)
    rows = [one] + ([boxed] if field != "box" else [])
    f = cells.FRAGMENT
    df = spark.createDataFrame(rows, f"doc_id long, row_idx long, field string, page array<{f}>, first array<{f}>, second array<{f}>, target_y double, target_x double")
    return cells.applied(df, ["first", "second"]).where(F.col("field") == field).first()


@pytest.mark.parametrize("field, page, other", [("pallet", "1/8", "1/9"), ("box", "51", "5")])
def test_pallet_and_box_keep_disagreements_for_review(spark, field, page, other):
    once = state(spark, field, (page, 0.7), [(other, 0.9)], [])
    assert (once.text, once.reason) == (page, "model_disagreement")
    twice = state(spark, field, (page, 0.7), [(other, 0.9)], [(other, 0.91, 20.0)])
    assert (twice.text, twice.reason, [k.source for k in twice.known]) == (other, "model_disagreement", ["page", "cell", "column"])
    sure = state(spark, field, (page, 0.99), [(other, 0.9)], [])
    assert (sure.text, sure.reason, sure.known) == (page, None, [])


def test_reasons_of_skus_go_and_those_of_quantities_stay(spark):
    sku, other = "4902397871897", "8930000001733"
    tie = state(spark, "sku", (sku, 0.5), [(other, 0.6)], [])
    assert (tie.text, tie.reason) == (sku, "model_disagreement")
    settled = state(spark, "sku", (sku, 0.5), [(other, 0.6)], [(sku, 0.7)])
    assert (settled.text, settled.reason, len(settled.known)) == (sku, None, 3)
    kept = state(spark, "sku", (sku, 0.5), [("97871897", 0.6)], [("97871897", 0.6)])
    assert (kept.text, kept.reason) == (sku, "model_disagreement")
    qty = state(spark, "qty", ("54", 0.86), [("5", 0.91)], [], box="54")
    assert (qty.text, qty.reason) == ("54", "model_disagreement")
    assert state(spark, "qty", ("54", 0.86), [("5", 0.91)], [("54", 0.9)], box="54").reason == "model_disagreement"
    assert state(spark, "qty", ("625", 0.77), [("525", 0.68)], []).text == "25"
    date = state(spark, "exp", ("9098-07-31", 0.9), [("2028-07-31", 0.8)], [])
    assert (date.text, date.reason) == ("2028-07-31", None)
    assert (state(spark, "batch", None, [("A1B2", 0.2)], []).text, state(spark, "batch", None, [("A1B2", 0.4)], []).text) == ("", "A1B2")


def page_of(spark, fragments, slots, cell=(), column=(), seconds=(), allowed=()):
    made = [(1, i, (x1 + x2) / 2, y, float(x1), float(x2), y - 8, y + 8, t, s) for i, (x1, x2, y, t, s) in enumerate(fragments)]
    frame = lambda rows, schema: spark.createDataFrame(list(rows), schema)
    return enhanced.page(
        frame(made, "doc_id long, seq long, xc double, yc double, x1 double, x2 double, y1 double, y2 double, text string, score double"), frame(slots, "doc_id long, row_idx long, y1 double, y2 double"),
        frame(cell, "doc_id long, row_idx long, field string, text string, score double"), frame(column, "doc_id long, field string, seq long, x1 double, x2 double, yc double, y1 double, y2 double, text string, score double"),
        frame(seconds, "doc_id long, row_idx long, field string, text string, score double"), frame(allowed, "doc_id long, allowed array<string>"), F.lit(2026),
    )


def test_enhanced_page(spark):
    sku = "8934804041534"
    fragments = [
        (100, 200, 20.0, "PO 123456", 0.9), (300, 400, 20.0, "Inbound date 2026/05/01", 0.9), (95, 150, 180.0, "A/4", 0.5), (180, 220, 181.0, "7", 0.6), (240, 380, 180.0, sku, 0.95), (730, 780, 180.0, "71", 0.9), (790, 900, 179.0, "9028-01-02", 0.9),
        (910, 1000, 180.0, "2026-01-02", 0.9), (1030, 1150, 180.0, "633BIPCHP1", 0.9), (240, 380, 213.0, sku, 0.95), (730, 780, 213.0, "27", 0.9), (400, 500, 246.0, "TOTAL", 0.9), (730, 780, 279.0, "278", 0.9), (500, 600, 280.0, "total", 0.9), (100, 120, 400.0, None, 0.1),
    ]
    slots = [(1, 0, 163.5, 196.5), (1, 1, 196.5, 229.5), (1, 2, 229.5, 262.5), (2, 0, 100.0, 130.0)]
    got = {(r.doc_id, r.row_idx): r for r in page_of(spark, fragments, slots, [(1, 1, "qty", "271", 0.85), (1, 1, "sku", None, 0.5)], [], [(1, 0, "pallet", "2 / 4", 0.9)], [(1, ["633B1PCHP1", "other"])]).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}  # the total's row is a summary, the other document's an empty row that lines show
    one, two, empty = got[1, 0], got[1, 1], got[2, 0]
    assert (one.pallet, one.box, one.sku, one.qty, one.exp, one.mfg, one.batch) == ("2/4", "7", sku, "7", "2028-01-02", "2026-01-02", "633B1PCHP1")
    assert one.raw == {"pallet": "A/4", "qty": "71", "exp": "9028-01-02", "batch": "633BIPCHP1"}
    assert one.corrections == {"pallet": "identifier_second_opinion", "qty": "trailing_check_mark", "exp": "context_year", "batch": "allowed_batch_match"}
    assert [c.source for c in one.candidates["pallet"]] == ["identifier"] and one.scores["pallet"] == 0.9 and one.errors == {}
    assert (two.qty, two.corrections["qty"], two.raw["qty"], two.total, two.total_agrees) == ("271", "invoice_total_candidates", "27", 278, True)
    assert "qty" not in two.reasons and two.reasons == {"batch": "manual_required"} and two.errors == {"batch": "ambiguous"}
    assert (empty.structural_row_missing, empty.errors, empty.row_confidence, empty.total_agrees) == (True, {"sku": "missing", "qty": "missing"}, 0.0, False)
    assert page_of(spark, fragments, []).count() == page_of(spark, [], []).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("123 456", ["123", "456"]), ("12 34 56", ["12", "34", "56"]), ("true, false", ["true", "false"]), ("null, B7", ["null", "B7"]), ('"a" b', ['"a"', "b"]), ("[1] [2]", ["[1]", "[2]"]), ("1, 2", ["1", "2"]), ("[1]][[2]", ["[1]][[2]"]),
        ('["a", "b c", 3]', ["a", "b c", "3"]), (" [] ", []), ("628", None), ('"x"', None), ('{"a": 1}', None), ("", []), (None, []), ("A1；B2，C3", ["A1", "B2", "C3"]), ('{"a":1} {"b":2}', ['{"a":1}', '{"b":2}']), ("012", ["012"]), ('[1]},{"b":[2]', ["[1]}", '{"b":[2]']),
    ],
)
def test_lists_are_json_only_as_a_whole(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(review.listed(F.col("t")).alias("l")).first()["l"] == want


@pytest.mark.parametrize("text, want", [("EXP \uff10\uff11/02/2026", "2026-02-01"), ("EXP 01/02/2026", "2026-02-01"), ("EXP 1\u00a0/ 2 / 2026", "2026-02-01"), ("EXP 31/02/2026", None)])
def test_label_dates_with_digits_of_any_width(spark, text, want):
    found = spark.createDataFrame([(text,)], "t string").select(labels.dates(labels.lines_of(F.col("t"))).alias("d")).first()["d"]
    assert [str(d["value"]) for d in found if d["value"]] == ([want] if want else [])


def test_stream_of_shots_in_any_order_ends_as_the_fold(spark, tmp_path):
    rng = random.Random(5)
    start = dt.datetime(2026, 1, 1)
    ops = [(s, n, rng.choice(["append", "append", "append", "undo", "plus", "minus", "reset"]), rng.randrange(9), start + dt.timedelta(seconds=20 * n)) for s in (1, 2, 3) for n in range(40)]
    schema = "session long, seq long, op string, cnt long, ts timestamp"
    batches = [ops[k::5] for k in range(5)]
    rng.shuffle(batches)
    end = [(9, 1, "append", 1, start + dt.timedelta(hours=2))]
    for k, rows in enumerate([*batches, end, [(9, 2, "append", 2, start + dt.timedelta(days=3))], [(9, 3, "append", 3, start + dt.timedelta(days=3, seconds=1))]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k == 0:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
            source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            q = sessions.streamed(source, "30 minutes", "1 day").writeStream.format("memory").queryName("shown").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
    q.processAllAvailable()
    q.stop()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.table("shown").collect()
    want = {r.session: (r.total, r.shots) for r in sessions.folded(spark.createDataFrame(ops, schema)).collect()}
    closed = {r.session: (r.total, r.shots) for r in rows if r.closed}
    assert {s: closed[s] for s in (1, 2, 3)} == want  # their state is gone after a day without shots
    assert {s: [(r.total, r.shots) for r in rows if r.session == s][-1] for s in (1, 2, 3)} == want


def test_current_counts(spark):
    ops = [(1, 1, "append", 3), (1, 2, "append", 4), (1, 3, "minus", 0), (1, 4, "undo", 0), (1, 5, "reset", 0), (1, 6, "undo", 0), (2, 1, "append", None), (2, 2, "minus", 0), (2, 3, "plus", 0)]
    got = sessions.current_counts(spark.createDataFrame(ops, "session long, seq long, op string, cnt long")).collect()
    assert sorted((r.session, r.seq, r.current, r.total) for r in got) == [(1, 1, 3, 3), (1, 2, 4, 7), (1, 3, 3, 6), (1, 4, 3, 3), (1, 5, 0, 0), (1, 6, 0, 0), (2, 1, 0, 0), (2, 2, 0, 0), (2, 3, 1, 1)]


def test_training_records(spark, tmp_path):
    good = [{"document_id": f"doc-{i}", "field": "qty", "image": f"{i}.png", "ocr_text": "6\n25", "label": "25", "verified": True} for i in range(50)]
    odd = ["{", "[1, 2", '{"document_id": 5', json.dumps(good[0] | {"field": "colour"}), json.dumps(good[0] | {"verified": False}), json.dumps(good[0] | {"document_id": " "}), json.dumps(good[0] | {"label": None}), json.dumps(good[0] | {"extra": 1}), "", json.dumps(good[0] | {"verified": "maybe"})]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(g, ensure_ascii=False) for g in good))
    (tmp_path / "b.jsonl").write_text("\n".join(odd) + "\n")
    kept, rejected = training.records(spark, str(tmp_path / "*.jsonl"))
    assert kept.count() == 51 and sorted(r.document_id for r in kept.collect()) == sorted([g["document_id"] for g in good] + ["doc-0"])
    assert sorted(r.reason for r in rejected.collect()) == sorted(["not_json"] * 4 + ["unknown_field", "not_verified", "no_document", "no_label"])


def test_report_is_written_with_its_counts(spark, tmp_path):
    cases = spark.createDataFrame([("a", 3, 0, 4, 10.0), ("a", 4, 1, 4, 30.0), ("b", 0, 0, 2, 5.0)], "model string, right int, missing_or_extra int, n_expected int, elapsed_ms double")
    assert review.write_report(cases, "model", str(tmp_path / "r")) == {"cases": 3, "right": 7, "expected": 10}
    got = {r.model: (r.cases, r.exact, r.complete, r.median_ms) for r in spark.read.json(str(tmp_path / "r")).collect()}
    assert got == {"a": (2, 0.875, 1, 20.0), "b": (1, 0.0, 1, 5.0)}
