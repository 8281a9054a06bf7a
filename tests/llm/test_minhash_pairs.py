from __future__ import annotations

import random

import pyarrow as pa

from docgrid.llm import hyperminhash


def test_pairs_leave_the_join_once(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):  # all near one text, few near each other
        own = list(words)
        for at in rng.sample(range(400), 4):
            own[at] = f"x{rng.random()}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = {}
    plain = hyperminhash.written
    monkeypatch.setattr(hyperminhash, "written", lambda df, name: seen.setdefault(name, (df._jdf.queryExecution().optimizedPlan().toString(), plain(df, name)))[1])
    distinct = hyperminhash.described(docs, 0.85).drop("doc_id")
    hyperminhash.links(docs, distinct, 85, block=4)
    how, across = seen["across"]
    assert across.count() == across.distinct().count() > 0
    assert not how.startswith("Aggregate")


def test_pipeline_hands_small_batches_to_python(spark):
    from docgrid.llm.common import small_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    with small_batches(spark, 7):
        sizes = spark.range(0, 100, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        assert max(r["n"] for r in sizes.collect()) == 7
    assert spark.conf.get(key) == before
