from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docgrid.functions import dates
from docgrid.functions import text as T
from docgrid.operators import geometry, labels, matching, reconcile, rows
from docgrid.streaming import sessions


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("kind", "text", "want"),
    [
        (T.clean_sku, "18934804041534N", "18934804041534"),
        (T.clean_sku, "8934804035178*", "8934804035178"),
        (T.clean_pallet, " 2 ／ 12 ", "2/12"),
        (T.clean_pallet, "2 12", "212"),
        (T.regroup_date, "2028.04.05", "2028-04-05"),
        (T.regroup_date, "", ""),
        (T.clean_digits, " 3O /", "30"),
        (T.is_date, "", True),
        (T.is_date, "2027-02-29", False),
        (T.is_date, "2028-02-29", True),
        (T.is_gtin, "8934804035178", True),
        (T.is_gtin, "8934804035179", False),
    ],
)
def test_scalars(spark, kind, text, want):
    assert one(spark, kind(F.lit(text))) == want


def test_allowed_batches(spark):
    two = F.array(F.lit("633B1PCHP1"), F.lit("999X1PCHP9"))
    assert one(spark, matching.reconciled_batch(F.lit("633BIPCHP1"), two)) == "633B1PCHP1"
    assert one(spark, matching.reconciled_batch(F.lit("ABC12"), F.array(F.lit("ABC11"), F.lit("ABC13")))) == ""
    batch, places = matching.reconciled_label_batch(F.lit("618405316B"), F.array(F.lit("61840E316B"), F.lit("XYZ")))
    assert (one(spark, batch), one(spark, places)) == ("61840E316B", [5])
    assert one(spark, T.confusable(F.lit("A5C"), F.lit("AEC"))) == [1]
    assert one(spark, T.confusable(F.lit("ABC"), F.lit("AXC"))) == []


@pytest.mark.parametrize(
    ("quantities", "options", "total", "want"),
    [
        (["7", "27"], [[7, 72], [27, 271]], 34, []),
        (["72", "271"], [[7, 72], [27, 271]], 34, [(0, "7", "invoice_total_candidates"), (1, "27", "invoice_total_candidates")]),
        (["232", "53"], [[232], None], 185, [(0, "132", "invoice_total_single_digit")]),
        (["232", "260"], [[232], [260]], 392, []),
        (["51", "7"], [None, None], 12, [(0, "5", "invoice_total_check")]),
        (["", "4"], [None, None], 9, []),
    ],
)
def test_total(spark, quantities, options, total, want):
    rows = [(1, i, q, o, total) for i, (q, o) in enumerate(zip(quantities, options))] + [(2, 0, "5", None, None), (2, 1, "x", None, None)]
    got = reconcile.against_total(spark.createDataFrame(rows, "doc_id long, row_idx int, qty string, options array<int>, total long")).collect()
    assert sorted((r.row_idx, r.qty, r.correction) for r in got if r.doc_id == 1 and r.correction) == want
    assert sorted((r.row_idx, r.qty, r.raw_qty) for r in got if r.doc_id == 2) == [(0, "5", None), (1, "x", None)]
    assert {r.row_idx: r.raw_qty or r.qty for r in got if r.doc_id == 1} == dict(enumerate(quantities))


def test_choices_equal_all_combinations():
    rng = random.Random(8)
    for _ in range(400):
        values = [rng.randrange(1, 40) for _ in range(rng.randrange(1, 6))]
        choices = [sorted({v, *(rng.randrange(1, 40) for _ in range(rng.randrange(1, 3)))}) for v in values]
        gap = rng.randrange(-60, 60)
        found = [c for c in itertools.product(*choices) if sum(c) - sum(values) == gap]
        assert reconcile.chosen(gap, values, choices) == (list(found[0]) if len(found) == 1 else None)
    far = 10**12  # no array holds changes as wide as this
    assert reconcile.chosen(far - 7, [7, 5], [[7, far], [5, 25]]) == [far, 5]
    assert reconcile.chosen(3 * far, [1, 1, 1, 1], [[1, 1 + far]] * 3 + [[1, 9]]) == [1 + far, 1 + far, 1 + far, 1]
    wide = [[i * 997, i * 1009 + 5] for i in range(1, 90)]  # more ways than any list of them could hold
    assert reconcile.chosen(sum(b - a for a, b in wide), [a for a, _ in wide], wide) == [b for _, b in wide]


@pytest.mark.parametrize(
    ("exp", "mfg", "anchor", "want"),
    [
        ("2099-09-11", "2096-06-11", 2026, ("2029-09-11", "context_year", "2026-06-11", "context_year")),
        ("2021-09-11", "", 2026, ("", "manual_required", "", None)),
        ("9098-07-31", "", 2026, ("2028-07-31", "context_year", "", None)),
        ("2026-01-01", "2026-06-01", 2026, ("2026-01-01", "date_order", "2026-06-01", "date_order")),
        ("2028-04-50", "B", 2026, ("", "manual_required", "", "manual_required")),
    ],
)
def test_dates(spark, exp, mfg, anchor, want):
    df = spark.createDataFrame([(exp, mfg, anchor)], "exp string, mfg string, anchor int")
    assert tuple(reconcile.context_dates(df).select("exp", "exp_reason", "mfg", "mfg_reason").first()) == want


def test_row_clusters_against_a_plain_loop(spark):
    rng = random.Random(3)
    data = [(d, s, rng.randrange(0, 400) / 2) for d in range(40) for s in range(12)]
    want = {}
    for d in range(40):
        found: list[list[float]] = []
        for y, s in sorted((y, s) for k, s, y in data if k == d):
            home = next((i for i, c in enumerate(found) if abs(sum(c) / len(c) - y) <= 16), None)
            if home is None:
                found.append([])
                home = len(found) - 1
            found[home].append(y)
            want[d, s] = home
    got = rows.clustered(spark.createDataFrame(data, "doc_id long, seq int, yc double"))
    assert {(r.doc_id, r.seq): r.row for r in got.collect()} == want


def test_reading_lines(spark):
    box = lambda x, y, h: [[float(x), float(y)], [x + 30.0, float(y)], [x + 30.0, float(y + h)], [float(x), float(y + h)]]
    lines = [(box(50, 12, 20), " b ", 0.5), (box(0, 10, 20), "a", 0.75), (box(0, 40, 20), "c", 0.25), (box(90, 19, 30), " ", 0.1), (box(70, 17, 20), "d", 0.9), (box(0, 27, 2), "e", 1.0)]
    df = spark.createDataFrame([(lines,), ([],)], "l array<struct<box:array<array<double>>,text:string,confidence:double>>")
    got = [[tuple(x) for x in r.x] for r in df.select(rows.reading_lines(F.col("l")).alias("x")).collect()]
    assert got == [[("a b d", 0.5), ("e", 1.0), ("c", 0.25)], []]
    assert [r.x for r in df.select(rows.reading_text(F.col("l")).alias("x")).collect()] == ["a\nb\nd\ne\nc", ""]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MFG 06/07/2028\nEXP 06/07/2027", (None, None)),
        ("EXP 06/07/2027\nLOT AB1234", (None, "2027-07-06")),
        ("06/07/2026 02:26\n06/07/2028\nAB12345", ("2026-07-06", "2028-07-06")),
        ("", (None, None)),
        ("MFG 01/02/2026 and EXP 01/02/2026", (None, None)),
        ("MFG 01/02/2026 EXP 01/02/2027", ("2026-02-01", "2027-02-01")),
        ("EXP01/02/2026\n01/02/2025", ("2025-02-01", "2026-02-01")),
        ("01/02/2026 MFG\n03.02.2027", ("2026-02-01", "2027-02-03")),
        ("31/02/2026\nMFG 0102/2026", ("2026-02-01", None)),
    ],
)
def test_label_roles(spark, text, want):
    got = one(spark, labels.parsed(F.lit(text)))
    assert (got.manufacture_at, got.expire_at) == want


@pytest.mark.parametrize(
    "text,order,want,normalized",
    [
        ("EXP 01/02/2028", "auto", [("", "ambiguous", "expire_at")], "EXP 01/02/2028"),
        ("EXP 01/02/2028", "dmy", [("2028-02-01", "valid", "expire_at")], "EXP 2028-02-01"),
        ("EXP 01/02/2028", "mdy", [("2028-01-02", "valid", "expire_at")], "EXP 2028-01-02"),
        ("2027-02-29, 2028-02-29 31/04/2028", "auto", [("", "invalid", ""), ("2028-02-29", "valid", ""), ("", "invalid", "")], "2027-02-29, 2028-02-29 31/04/2028"),
        ("ABC20281119X", "auto", [], "ABC20281119X"),
        ("November 19, 2026\n31122028 20012028\n01022028", "auto", [("2026-11-19", "valid", ""), ("2028-12-31", "valid", ""), ("2028-01-20", "valid", ""), ("", "ambiguous", "")], "2026-11-19\n2028-12-31 2028-01-20\n01022028"),
        ("LOT20281119 EXP20281120", "auto", [("2028-11-20", "valid", "expire_at")], "LOT20281119 EXP2028-11-20"),
        ("生产日期：2026年1月2日\r\n批次号 20261119\n", "auto", [("2026-01-02", "valid", "manufacture_at")], "生产日期：2026-01-02\n批次号 20261119"),
        (None, "auto", [], ""),
        ("", "auto", [], ""),
    ],
)
def test_dates_of_free_text(spark, text, order, want, normalized):
    got = spark.createDataFrame([(text,)], "t string").select(dates.scanned(F.col("t"), order).alias("s")).first()["s"]
    assert [(d["value"], d["status"], d["field"]) for d in got["dates"]] == want
    assert got["normalized"] == normalized


def test_notes_keep_the_first_height_of_a_line(spark):
    items = spark.createDataFrame([(1, 9e0, 1200e0, "b"), (1, 5e0, 1218e0, "a"), (1, 1e0, 1219e0, "c"), (1, 1e0, 1300e0, "PO12 Total"), (1, 1e0, 1100e0, "table"), (2, 1e0, 5e0, "x")], "doc_id int, x1 double, yc double, text string")
    assert [tuple(r) for r in rows.notes(items, 1100).collect()] == [(1, "a b | c")]


def test_layouts(spark):
    heads = [(1, 95, 138, "PALLET"), (1, 190, 143, "BOX"), (1, 334, 145, "SKU #"), (1, 628, 139, "Name"), (1, 872, 116, "aty")]
    heads += [(2, 574, 121, "Name"), (2, 778, 138, "Qty"), (2, 875, 138, "EXP"), (2, 996, 140, "MFG"), (2, 1142, 144, "Batch"), (4, 300, 500, None)]
    body = [(3, x, 200 + 40 * i, t) for i in range(10) for x, t in ((340, f"930060513{100 + i}"), (890, str(10 + i)), (1000, "2027.09.11"), (1150, "2026.06.11"))]
    got = matching.layouts(spark.createDataFrame(heads + body, "doc_id int, xc double, yc double, text string".replace("double", "int")), 166)
    assert {tuple(r) for r in got.collect()} == {(1, "without_batch"), (2, "with_batch"), (3, "without_batch"), (4, "fixed")}


def test_row_centers():
    slots = np.arange(5) * 30.0 + 100
    assert geometry.centers(np.array([101.0, 132, 160, 191, 222]), slots).tolist() == [101, 132, 160, 191, 222]
    fit = geometry.centers(np.array([103.0, 134, 227]), slots)
    assert np.abs(fit - (np.arange(5) * 31 + 103)).max() < 1
    for seen in ([], [100.0, 130], [900.0, 1000, 1100]):
        assert geometry.centers(np.array(seen), slots).tolist() == slots.tolist()


def test_row_centers_equal_a_plain_search():
    rng = random.Random(12)
    for _ in range(6):
        slots = [100.0 + 30 * k for k in range(rng.randrange(3, 7))]
        seen = sorted(s + rng.randrange(-8, 9) + 3 * k for k, s in enumerate(slots[: rng.randrange(3, 7)]))
        if rng.random() < 0.5:
            seen = sorted([*seen, seen[0] + 4, 700.0])
        n, best = len(slots), None
        for i, j in itertools.product(range(31), range(55)):
            size, first = 30 * 0.85 + i * 9 / 30, slots[0] - 13.5 + j * 0.5
            placed = [(v, round((v - first) / size)) for v in seen]
            held = [(v, k) for v, k in placed if 0 <= k < n]
            rows_ = {k for _, k in held}
            if len(rows_) >= min(3, n):
                score = sum(abs(v - first - k * size) for v, k in held) / len(held) + (len(held) - len(rows_)) * 10.5 + (len(seen) - len(held)) * 7.5 + abs(first - slots[0]) * 0.03 - len(rows_) * 0.02
                best = min(best or (9e9,), (round(score, 9), i, j, len(rows_), first, size))
        steps = [b - a for a, b in zip(seen, seen[1:])]
        middle = float(np.median(steps))
        if len(seen) == n and middle >= 10 and all(0.55 * middle <= g <= 1.45 * middle for g in steps):
            want = seen
        elif best is None or best[3] < max(3, int(min(n, len(seen)) * 0.55)):
            want = slots
        else:
            want = [best[4] + k * best[5] for k in range(n)]
        assert np.allclose(geometry.centers(np.array(seen), np.array(slots)), want)
