from __future__ import annotations

from docgrid.llm import suffix_dedup


def test_texts_are_cut_once(spark):
    """A second cut in the plan is a second Python worker for each task."""
    passage = "".join(f"é{i * i} " for i in range(60))
    rows = [(None, passage), (1, "one " + passage), (2, passage), (3, None), (4, ""), (5, "short"), (6, "tail " + passage), (7, "tail " + passage)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.without_later_copies(docs)
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=key) == [(None, passage), (1, "one "), (3, None), (4, ""), (5, "short"), (6, "tail")]  # with the space before the passage, as in 1
