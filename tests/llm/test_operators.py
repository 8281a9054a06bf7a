from __future__ import annotations

import base64
import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docgrid.llm import chat, common, cotraining, decontaminate, hyperminhash, image_copies, mixing, near_copies, queries, simhash, suffix_dedup, terms, toxicity, url_filter, warc
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "src1", None) for i, t in texts], DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    same(queries.queries()[name](spark, SF), connect(SF), queries.oracle_sql()[name])


def brute_repeats(rows, length, first):
    rows = sorted(rows)
    at = collections.defaultdict(list)
    for n, (_, t) in enumerate(rows):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            at[b[p : p + length]].append((n, p))
    gone = [set() for _ in rows]
    for places in at.values():
        if len(places) > 1:
            for n, p in places[1:] if first else places:
                gone[n].update(range(p, p + length))
    out = []
    for (i, t), g in zip(rows, gone):
        b = (t or "").encode()
        kept = bytes(x for j, x in enumerate(b) if j not in g)
        out.append((i, len(b), len(g), sum(j - 1 not in g for j in g), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("first", [False, True])
@pytest.mark.parametrize("limit", [1, suffix_dedup.KEY_LIMIT])
def test_suffix_dedup(spark, first, limit):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdé", k=rng.randrange(2, 9)))
    texts = [" ".join(word() for _ in range(120)) for _ in range(12)]
    texts += [texts[0], texts[1][:300] + texts[2][100:], "x" + texts[3], texts[4][50:] + texts[4], "a" * 900, "ab" * 300, "b" + "ab" * 200, "", None, "short"]
    rows = list(enumerate(texts))
    got = suffix_dedup.removal_report(docs_of(spark, rows), first_kept=first, key_limit=limit)
    assert sorted(map(tuple, got.collect())) == brute_repeats(rows, 200, first)


def test_longest_previous_factors():
    rng = np.random.default_rng(5)
    for length, letters, n in ((8, 2, 400), (12, 3, 300), (200, 2, 900)):
        data = rng.integers(0, letters, n + length).astype(np.uint8)
        data[n // 2 : n // 2 + length + 40] = data[: length + 40]
        starts, order = np.arange(n), rng.permutation(n)
        raw = data.tobytes()

        def common(i, j):
            k = 0
            while k < length and raw[i + k] == raw[j + k]:
                k += 1
            return k if k > 1 else 0  # below two bytes counts as none

        prefix = [[common(i, j) for j in range(n)] for i in range(n)]
        sa, lcp = suffix_dedup.suffix_order(data, starts, order, length)
        assert all((raw[i : i + length], order[i]) < (raw[j : j + length], order[j]) for i, j in zip(sa, sa[1:]))
        assert lcp.tolist() == [0] + [prefix[i][j] for i, j in zip(sa, sa[1:])]
        for signed in (order, -order):
            want = [max((prefix[i][j] for j in range(n) if signed[j] < signed[i]), default=0) for i in range(n)]
            assert suffix_dedup.previous_factors(sa, lcp, signed).tolist() == want


@pytest.mark.parametrize("first", [False, True])
def test_suffix_dedup_of_long_texts_and_repeated_rows(spark, first):
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefgh ", k=suffix_dedup.PIECE + 5000))
    shared = long[suffix_dedup.PIECE - 300 : suffix_dedup.PIECE + 300]
    rows = [(1, long), (2, "x" + shared + "y"), (4, "z" * 3000), (5, shared[:199]), (6, "w" + shared[100:] + "v")]
    got = suffix_dedup.removal_report(docs_of(spark, rows), first_kept=first).collect()
    assert sorted(map(tuple, got)) == brute_repeats(rows, 200, first)
    again = docs_of(spark, [(1, shared), (1, shared), (None, shared[1:]), (None, None)])
    counts = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.removal_report(again, first_kept=first).collect()}
    assert counts == ({(1, 600): 600, (None, 599): 0, (None, 0): 0} if first else {(1, 600): 600, (None, 599): 599, (None, 0): 0})


def test_suffix_dedup_keeps_clashing_columns(spark):
    passage = "".join(f"{i * i} " for i in range(60))
    docs = docs_of(spark, [(1, passage), (2, passage + "tail")]).withColumns({c: F.lit(c) for c in ("spans", "_cut", "cut", "own", "_own", "rid", "doc", "p0", "n", "key")})
    got = suffix_dedup.without_later_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text, r.spans, r.cut, r.own, r.rid, r.doc) for r in got.collect()) == [(1, passage, "spans", "cut", "own", "rid", "doc"), (2, "tail", "spans", "cut", "own", "rid", "doc")]


def test_suffix_dedup_texts(spark):
    passage = "".join(f"é{i * i} " for i in range(60))
    got = suffix_dedup.without_later_copies(docs_of(spark, [(1, "one " + passage), (2, passage + " two"), (3, None), (4, ""), (5, "one " + passage)]))
    assert {r.doc_id: r.text for r in got.collect()}[1] == "one " + passage
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4}
    empty = docs_of(spark, [])
    assert suffix_dedup.removal_report(empty).count() == suffix_dedup.without_later_copies(empty).count() == 0


def slow_print(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("limit", [1, 32])
def test_simhash(spark, limit):
    rows = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    rows += [(1000, None), (1001, " \t"), (1002, rows[0][1]), (1003, rows[0][1])]
    prints = {i: slow_print(t) for i, t in rows}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = simhash.classes(docs_of(spark, rows), bucket_limit=limit)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got.collect()} == {(i, f"{p:016x}", find(i)) for i, p in prints.items()}


def test_first_of_each_class(spark):
    rows = [(1, "b b b b"), (5, "b b b b"), (5, "a unique text here"), (None, "b b b b"), (None, "alone again"), (7, "a unique text here"), (7, "a unique text here"), (8, "twice told tale"), (8, "twice told tale"), (9, None), (10, "")]
    docs = docs_of(spark, rows).withColumns({c: F.lit(77) for c in ("rid", "fp", "component", "keep", "n", "_nth", "_gone", "RID_")})
    for got in (simhash.deduplicated(docs), common.first_of_each(docs, near_copies.classes(docs))):
        assert got.columns == docs.columns and {(r.rid, r.fp, r.component, r._nth) for r in got.collect()} == {(77, 77, 77, 77)}
        found = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        assert found == sorted([(1, "b b b b"), (5, "a unique text here"), (8, "twice told tale"), (9, None), (None, "alone again")], key=repr)
    assert simhash.deduplicated(docs.limit(0)).count() == common.first_of_each(docs.limit(0), near_copies.classes(docs.limit(0))).count() == 0


def test_simhash_dense_group(spark):
    base = 0x0123456789ABCDEF
    values = [base ^ (1 << i) ^ (1 << j) for i in range(12) for j in range(i)] + [base, 7, 7 ^ (1 << 63)]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), bucket_limit=8)
    roots = {r.node: r.root for r in common.components(found).collect()}
    assert len({roots[v] for v in signed[:-2]}) == 1 and roots[signed[-1]] == roots[signed[-2]] != roots[signed[0]]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(5, 5)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}


def test_decontamination(spark):
    docs, items = common.table(spark, SF, "documents"), common.table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id) for r in decontaminate.report(docs, items).collect()}
    rows, tests = docs.collect(), items.collect()
    assert {(d.doc_id, i.item_id) for d in rows for i in tests if i.text in d.text} <= got
    item = tests[0].text
    words = item.split()
    made = docs_of(spark, [(1, "head " * 300 + item.upper() + " tail" * 300), (2, " ".join(words[: len(words) // 2])), (3, None), (4, ""), (5, "clean " * 50)])
    assert {(r.doc_id, r.item_id) for r in decontaminate.report(made, items).collect()} == {(1, tests[0].item_id)}
    assert {r.doc_id for r in decontaminate.without_leaks(made, items).collect()} == {2, 3, 4, 5}
    assert decontaminate.report(made, items.limit(0)).count() == 0


def test_block_max_wand_finds_all_that_scoring_every_item_finds():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices([f"w{k}" for k in range(60)], k=12))) for i in range(90)]
    index = decontaminate.Index(items)
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.vocabulary)), 15))
        scores = collections.Counter()
        for t in terms:
            for doc, w in index.postings(t):
                scores[doc] += w
        for threshold in (0.2, 0.4):
            assert {d for d, _ in index.wand(terms, threshold)} == {d for d, s in scores.items() if s >= threshold}


def plain_leaks(docs, items):
    """Every passage scored against every item, from the texts alone."""
    split = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    items = [(i, t, split(t)) for i, t in set(items) if t and split(t)]
    n, mean, half = len(items), sum(len(w) for _, _, w in items) / len(items), max(len(w) for _, _, w in items)
    df = collections.Counter(x for _, _, w in items for x in set(w))
    grams = lambda w, k: {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    out = {}
    for item, text, w in items:
        tf = collections.Counter(w)
        weight = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, f in tf.items()}
        total = sum(weight.values())
        cut = len(split(text[: text.find("?") + 1])) if "?" in text else 2 * len(w) // 3
        parts = [p for p in (w[:cut], w[cut:]) if p] or [w]
        for row, (_, body) in enumerate(docs):
            all_words = split(body or "")
            for at in range(0, len(all_words), half):
                passage = all_words[at : at + 2 * half]
                score = sum(weight[x] for x in set(passage) & set(weight)) / total
                shares = [len(grams(p, 5) & grams(passage, min(5, len(p)))) / len(grams(p, 5)) for p in parts]
                if score >= 0.5 - 1e-9 and min(shares) >= 0.8:
                    out[row, item] = max(out.get((row, item), 0), score)
    return sorted((docs[row][0], item, round(s, 6)) for (row, item), s in out.items())


@pytest.mark.parametrize("most", [decontaminate.INDEX_BYTES, 900])
def test_decontamination_equals_scoring_every_passage(spark, monkeypatch, most):
    docs = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").where("doc_id < 120").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    docs += [(500, items[0][1]), (500, items[0][1]), (501, "\n".join(items[1][1].split())), (502, "x y " * 400 + items[2][1] + " z" * 900), (503, "Ünïcode wörds? " * 20), (504, None)]
    items += [items[3], (9001, None), (9002, ""), (9003, "Ünïcode wörds?"), (items[4][0], "another text under the same id, with words of its own? yes indeed it has")]
    docs += [(505, items[-1][1]), (506, items[4][1] + "\t" + items[-1][1])]
    monkeypatch.setattr(decontaminate.indexes, "__defaults__", (most,))
    monkeypatch.setattr(decontaminate, "PIECE", 600 if most == 900 else 1 << 20)
    got = decontaminate.report(docs_of(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = plain_leaks(docs, items)
    if most == 900:  # windows start anew in each piece, so the score of a partly held item may differ
        assert {(r.doc_id, r.item_id) for r in got} == {w[:2] for w in want}
    else:
        assert sorted((r.doc_id, r.item_id, round(r.score, 6)) for r in got) == want


def test_decontamination_pieces_cut_between_words(monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE", 50)
    text = "\n".join(f"word{i}" for i in range(200)).encode()
    parts = [p.split() for p in decontaminate._pieces(text, 6)]
    assert parts[0][0] == b"word0" and parts[-1][-1] == b"word199" and {w for p in parts for w in p} == set(text.split())
    assert all(b[:6] == a[-6:] for a, b in zip(parts, parts[1:])) and len(parts) > 10


def warc_record(fields, block, version="1.1"):
    lines = [f"WARC/{version}", *[f"{k}: {v}" for k, v in fields.items()], f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@pytest.mark.parametrize("split", ["300b", "128m"])
def test_warc_of_other_writers(spark, tmp_path, split):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    fake = warc_record({"WARC-Type": "response"}, b"abc")
    payloads = [b"plain", fake * 8, b"", b"WARC/1.1\r\n", b"\r\n\r\nWARC/1.0\r\nContent-Length: 4\r\n\r\n" * 30, b"\xff\xfe" * 400, fake[:-3], b"\r\n\r\nWARC/1."]
    digest = base64.b32encode(hashlib.sha1(payloads[0]).digest()).decode()
    kinds = [({"WARC-Type": "warcinfo", "WARC-Record-ID": "<urn:uuid:1>"}, fake), *[({"WARC-Type": "response", "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{digest}"}, http + p) for p in payloads], ({"WARC-Type": "resource"}, fake * 3), ({"WARC-Type": "metadata"}, b"")]
    folder = tmp_path / "w"
    folder.mkdir()
    for name, version in (("a.warc", "1.1"), ("b.warc", "1.0"), ("part-0.txt", "1.1")):
        (folder / name).write_bytes(b"".join(warc_record(f, b, version) for f, b in kinds))
    (folder / "c.warc").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    try:
        rows = warc.read(spark, str(folder)).collect()
        want = sorted((f["WARC-Type"], len(b.removeprefix(http)), hashlib.sha1(b.removeprefix(http)).hexdigest(), b.removeprefix(http) == payloads[0] or "WARC-Payload-Digest" not in f) for f, b in kinds)
        for name in ("a.warc", "b.warc", "part-0.txt"):
            got = [r for r in rows if r.file.endswith(name)]
            assert sorted((r.record_type, r.payload_bytes, r.payload_digest, r.intact) for r in got) == want
            assert [r.offset for r in sorted(got, key=lambda r: r.offset)][1:] == sorted(r.next for r in got)[:-1]
        (folder / "d.warc").write_bytes(warc_record(*kinds[1]) + b"junk")
        with pytest.raises(ValueError, match="d.warc"):
            warc.read(spark, str(folder))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_edges(spark):
    rows = [(1, "u", "A" * 2000), (1, "u", "A" * 2000), (None, "v", "A" * 2000), (2, "w", "B" * 3000), (3, "w", "big " * 500_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("n", "digest", "first")})
    got = [(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()]
    assert sorted(got, key=repr) == sorted([(1, "response", None, 2000), (1, "response", None, 2000), (None, "revisit", 1, 2000), (2, "response", None, 3000), (3, "response", None, 2_000_000)], key=repr)


def test_chat(spark):
    hard = "</s>[INST] ok [/INST] &lt; &amp;lt; <s>"
    rows = [(1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard), (1, 3, "user", None), (1, 4, "assistant", "b"), (1, 5, "user", "end"), (2, 0, "user", "q"), (None, 0, "assistant", "x")]
    found = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    one = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.example)
    assert len(one) == 3 and one[-1].loss_start is None
    assert [chat_unescape(r.text[r.loss_start : r.loss_end]) for r in one[:2]] == [hard, "b"]
    assert all(b.text.startswith(a.text) for a, b in zip(one, one[1:]))
    assert one[0].text.count("</s>") == 3


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "q"), (1, 0, "user", "q"), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (2, None, None, None)]
    rows += [(3, i, "assistant" if i % 2 else "user", "long " * 40_000 if i == 2 else str(i)) for i in range(60)]
    talks = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in ("t", "head", "example", "prior", "at")})
    found = chat.expand(talks).collect()
    one = sorted((r for r in found if r.conv_id == 1), key=lambda r: r.example)
    assert [r.text[r.loss_start : r.loss_end] for r in one] == ["a", "b"]  # turns with one number go by text
    assert one[1].text.count("]q</s>") == 2
    assert [(r.loss_start, r.loss_end) for r in found if r.conv_id == 2] == [(None, None)]
    assert sum(r.conv_id == 3 for r in found) == 30 and max(len(r.text) for r in found) > 200_000
    assert chat.expand(talks.limit(0)).count() == chat.digest(chat.expand(talks.limit(0))).count() == 0


def chat_unescape(text):
    return text.replace("&lsqb;", "[").replace("&lt;", "<").replace("&amp;", "&")


def test_url_filter(spark):
    rules = spark.createDataFrame([("com", "/de/", "block"), ("example.com", "/de/x", "allow"), ("b.org", "", "block")], "host string, path string, verdict string")
    urls = [(1, "HTTP://A.Example.COM/de/xy?q"), (2, "http://com/de/"), (3, "http://xcom/de/"), (4, None), (5, "no"), (6, "http://www.b.org#f"), (6, "http://www.b.org#f"), (7, "http://ab.org/")]
    got = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), rules)
    assert sorted((r.page_id, r.rule, r.verdict) for r in got.collect() if r.rule) == [(1, "example.com/de/x", "allow"), (2, "com/de/", "block"), (6, "b.org", "block"), (6, "b.org", "block")]
    assert got.count() == len(urls)
    many = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id"), F.lit(".net")).alias("host"), F.lit("/").alias("path"), F.lit("block").alias("verdict"))
    asked = spark.range(15_000, 25_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), F.col("id"), F.lit(".net/")).alias("url"))
    assert url_filter.judge(asked, many).where("verdict = 'block'").count() == 5000


def test_url_filter_edges(spark):
    rules = spark.createDataFrame([("com", "/de/", "block"), ("com", "/de/", "allow"), (None, None, "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, None if i % 2 else "broken") for i in range(300)] + [(400, "http://A.com/de/" + "x" * 100_000), (401, "http://A.com/d"), (None, "http://a.com/de/")], "page_id long, url string").withColumns({c: F.lit(7) for c in ("host", "path", "rule", "key_host", "block", "w0")})
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == 303 and got[400] == got[None] == ("a.com", "com/de/", "block") and got[401] == ("a.com", None, "allow")
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    assert {(r.rule, r.verdict) for r in url_filter.judge(pages, rules.limit(0), "block").collect()} == {(None, "block")}


def test_toxicity_edges(spark):
    labels = common.table(spark, SF, "labels")
    docs = common.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(9000, "word " * 200_000), (9000, "word " * 200_000), (None, None)], "doc_id long, text string"))
    clash = docs.withColumns({c: F.lit("kept") for c in ("label", "seq", "at")})
    got = toxicity.scored(clash, toxicity.train(clash, labels), "odds")
    rows = got.where("doc_id = 9000 or doc_id is null").collect()
    assert len(rows) == 3 and {(r.label, r.seq, r.at) for r in rows} == {("kept",) * 3} and rows[0].odds == rows[1].odds
    assert toxicity.report(docs.limit(0), labels).count() == 0 and toxicity.report(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_mixing_budgets(spark):
    leaves = spark.createDataFrame([("a", "en", "1", 10), ("a", "en", "2", 1000), ("a", "fr", "3", 5), ("b", "en", "4", 1000)], "domain string, lang string, source string, tokens long")
    got = mixing.budgets(leaves, mixing.LEVELS, {}, F.lit(800), 1)
    assert {r.source: r.budget for r in got.collect()} == {"1": 10, "2": 385, "3": 5, "4": 400}
    got = mixing.budgets(leaves, mixing.LEVELS, {"domain": {"a": 3.0}}, F.lit(1600), 1)
    assert {r.source: r.budget for r in got.collect()} == {"1": 10, "2": 1000, "3": 5, "4": 585}


def test_mixing_edges(spark):
    docs = docs_of(spark, [(1, "a b c"), (1, "a b c"), (2, None), (3, "")])
    assert mixing.mix(docs, F.substring("source", 1, 4), ratio=1.0).count() == 4
    assert mixing.mix(docs.limit(0), F.substring("source", 1, 4)).count() == 0
    clash = docs.withColumns({c: F.lit(c) for c in ("rest", "cut", "whole", "last", "_h", "_domain", "bucket", "n", "base", "tokens")}).withColumn("epoch", F.lit("old"))
    got = mixing.mix(clash, F.substring("source", 1, 4), ratio=2.0)
    assert got.columns == [*clash.columns, "domain", "n_tokens"]
    rows = got.collect()
    assert {(r.rest, r.cut, r.whole, r.last, r._h, r.bucket, r.base) for r in rows} == {("rest", "cut", "whole", "last", "_h", "bucket", "base")}
    assert sorted(r.epoch for r in rows) == [0, 0, 0, 0, 1, 1, 1, 1]
    none = spark.createDataFrame([(1, "a b", None, None, None), (2, "c d", None, "s", 3), (None, "e f", "en", None, 3)], DOCS)
    assert {(r.doc_id, r.domain) for r in mixing.mix(none, F.substring("source", 1, 4), ratio=2.0).collect()} == {(1, ""), (2, "s"), (None, "")}


def test_mixing_of_a_heavy_leaf_and_weights(spark):
    """A leaf with most rows, against a plain loop; a domain of weight 0 gives nothing."""
    rng = random.Random(4)
    rows = [(i, "w " * rng.randrange(1, 9), "en", "big1" if i % 10 else f"tiny{i % 70}", None) for i in range(3000)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs, F.substring("source", 1, 4), ratio=0.4, weights={"domain": {"tiny": 0.0}}, seed=3).collect()
    leaf = [(i, len(t.split())) for i, t, _, source, _ in rows if source == "big1"]
    budget, tokens = int(sum(len(r[1].split()) for r in rows) * 0.4), sum(n for _, n in leaf)
    assert budget < tokens
    taken, chosen = 0, []
    for i, n in sorted(leaf, key=lambda x: hashlib.md5(f"3:0:{x[0]}".encode()).hexdigest()):
        if taken + n > budget:
            break
        taken += n
        chosen.append(i)
    assert sorted(r.doc_id for r in got) == sorted(chosen) and {r.source for r in got} == {"big1"}


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    got = queries.op7_toxicity(spark, sf)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.95
    assert got.count() == 1000 and got.where("score between 0 and 1").count() == 1000
    docs = docs_of(spark, [(1, None), (2, "")])
    assert toxicity.report(docs, labels.limit(0)).count() == 2


def test_toxicity_learns_a_pair():
    import numpy as np

    rows = [(a, b) for a in (0, 1) for b in (0, 1)] * 50
    sets = [[i for i, x in enumerate(r) if x] for r in rows]
    start = np.cumsum([0, *map(len, sets)])
    machine = toxicity.FactorizationMachine(2).fit(np.array([float(a & b) for a, b in rows]), start, np.array([i for s in sets for i in s]), steps=600)
    assert machine.score([0, 1]) > 0.7 > 0.3 > max(machine.score([0]), machine.score([1]))


def test_terms_of_large_balanced_classes(spark):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "good word").otherwise("bad word").alias("text"))
    chosen = terms.choose(docs.withColumn("label", (F.col("doc_id") % 2).cast("int")), 10)
    assert len(chosen) == 2
    labels = docs.select("doc_id", (F.col("doc_id") % 2).alias("toxic"))
    got = toxicity.report(docs, labels)
    assert got.where("predicted <> doc_id % 2").count() == 0
    doubled = terms.sample(docs.unionByName(docs), labels, "toxic", 100)
    assert doubled.count() == 100


def test_cotraining_held_out(spark):
    sf = "/root/testdata/sf0.01"
    labels = common.table(spark, sf, "labels")
    got = queries.op1_cotraining(spark, sf)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) / len(good) / len(bad) > 0.8
    docs = docs_of(spark, [(1, None), (1, None), (2, ""), (None, "word " * 300_000)]).withColumns({c: F.lit(1) for c in ("label", "seq", "apart", "content", "meta", "score")})
    rows = cotraining.report(docs, labels.limit(0)).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    assert cotraining.report(docs.limit(0), labels).count() == 0
    assert cotraining.report(docs, spark.createDataFrame([(1, 1, None), (1, 0, None), (7, 1, 0)], "doc_id long, quality int, toxic int")).count() == 4


def test_cotraining_counts_all_sure_documents(spark):
    """Lessons equal those of a plain loop over every unlabelled document."""
    docs = common.table(spark, SF, "documents")
    labels = common.table(spark, SF, "labels").where("doc_id % 3 = 0")
    model, every = cotraining.train(docs, labels, rounds=1)
    n = cotraining._spread(every, model)
    bounds = [cotraining._bounds(view, 0.2, 0.5) for view in n]
    got = cotraining._lessons(every, model, bounds)
    rows = every.toArrow()
    f = cotraining.Features.of(rows)
    p = [cotraining._sigmoid(z) for z in model.logits(f)]
    assert n.sum(axis=1).tolist() == [rows.num_rows] * 2
    for pupil, column in ((0, "content"), (1, "meta")):
        counts, taken = collections.Counter(), [0, 0]
        for row, q in zip(rows.column(column).to_pylist(), p[1 - pupil]):
            place = min(int(q * cotraining.BINS), cotraining.BINS - 1)
            for label, sure in ((0, place <= bounds[1 - pupil][0]), (1, place >= bounds[1 - pupil][1])):
                if sure:
                    taken[label] += 1
                    counts.update((label, at) for at in row)
        assert got[pupil][1].tolist() == taken and {k: got[pupil][0][k] for k in counts} == counts and got[pupil][0].sum() == sum(counts.values())


def grouped(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in pairs:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    return [find(i) for i in range(n)]


IMAGE = "image_id long, width int, height int, pixels binary"


def image_row(image_id, img):
    return (image_id, img.shape[1], img.shape[0], bytearray(np.ascontiguousarray(img).tobytes()))


def test_image_copies(spark):
    vectors = spark.range(120).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.5).cast("float")).alias("embedding"))
    images = image_copies.rendered(vectors)
    more = [(200, 2, 2, bytearray(b"1234")), (201, None, None, None), (202, 9, 9, bytearray(b"broken")), (203, 2, 2, bytearray(b"1234")), (None, 5, 5, None), (204, 40, 40, bytearray(1600))]
    images = images.unionByName(images.where("image_id = 3").withColumn("image_id", F.lit(103).cast("long"))).unionByName(spark.createDataFrame(more + more[:1], IMAGE))
    images = images.withColumn("node", F.lit(1)).withColumn("root", F.lit(2))
    rows = image_copies.classes(images).collect()
    got = {r.image_id: r.component_id for r in rows}
    assert len(rows) == images.count() and sum(r.image_id == 200 for r in rows) == 2
    assert sum(got[-i] == got[i] for i in range(7, 120, 10)) >= 10 and got[103] == got[3]  # two of each edit; the tables miss some
    assert len({got[i] for i in range(120)}) == 119  # 103 is a copy of 3
    assert (got[200], got[201], got[202], got[203], got[204], got[None]) == (200, 201, 202, 200, 204, None)
    assert image_copies.classes(images.limit(0)).count() == 0


def test_more_points_on_larger_images():
    rng = np.random.default_rng(1)
    sizes = [len(image_copies.describe(rng.integers(0, 255, (n, n)).astype(np.uint8))) for n in (20, 96, 200, 400)]
    assert 0 < sizes[0] < sizes[1] and sizes[3] > 3 * sizes[2] > 9 * sizes[1]


@pytest.mark.parametrize("crowd", [3, image_copies.CROWD])
def test_image_links_equal_brute_force(spark, crowd):
    rng = np.random.default_rng(2)
    pictures = []
    for k in range(24):
        base = image_copies.picture([float(k), 2.5])
        pictures.append(base)
        pictures += [image_copies.copied(base, seed, edit) for seed, edit in enumerate(image_copies.EDITS)]
        if k < 4:  # larger groups, of crops that differ
            pictures += [image_copies.copied(base, 50 + int(x), "cut") for x in rng.integers(0, 1000, 8)]
    points = [image_copies.describe(p) for p in pictures]
    keys = [set(image_copies.keys(p).tolist()) for p in points]
    n = len(points)
    true = [(i, j) for j in range(n) for i in range(j) if image_copies.votes(points[i], points[j]) >= image_copies.MIN_VOTES]
    met = [(i, j) for i, j in true if keys[i] & keys[j]]
    assert len(met) >= 0.9 * len(true)  # recall of the tables
    one = spark.createDataFrame([(i, bytearray(p.tobytes()), bytearray(p["d"][:, 0].tobytes())) for i, p in enumerate(points)], "node long, points binary, half binary")
    found = image_copies.links(one, 3, crowd).collect()
    assert grouped(n, [(r.u, r.v) for r in found]) == grouped(n, met)
    assert {(r.u, r.v) for r in found} <= set(met)


@pytest.mark.parametrize("block", [3, hyperminhash.BLOCK])
def test_simhash_stage_equals_brute_force(spark, monkeypatch, block):
    import corpus_pipeline

    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(6):
        base = words(300)
        texts.append(base)
        for edits in (1, 2, 4, 6, 8, 20):  # similarities from about 0.97 down to 0.5
            copy = list(base)
            for at in rng.sample(range(300), edits):
                copy[at] = "new"
            texts.append(copy)
    chain = words(400)
    texts += [chain[k * 15 : k * 15 + 200] for k in range(12)]  # each near the next only
    line = words(10)
    texts += [line * 60 + words(40) for _ in range(8)]  # one repeated line, other words differ
    texts += [[], [], ["a"], ["a"], ["A", "b"]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = [(i, j) for j in range(len(rows)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert sum(len(sets[i] & sets[j]) < 0.95 * len(sets[i] | sets[j]) for i, j in near) > 20
    for i, j in near:
        x, y = sorted((find(i), find(j)))
        parent[y] = x
    docs = docs_of(spark, rows + [(None, "no id"), (3, rows[3][1])])
    monkeypatch.setattr(hyperminhash.links, "__defaults__", (hyperminhash.PERCENT, block))
    got = corpus_pipeline.simhash_stage(spark, docs, SF)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted({find(i) for i in range(len(rows))})
    assert got.where("doc_id is null").count() == 1


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.written(stage(spark, docs, SF), name)
        assert kept.columns == docs.columns and 0 < kept.count() <= docs.count()
        docs = kept
    assert docs.count() > 130
    toxic = common.table(spark, SF, "labels").where("toxic = 1").select("doc_id")  # few rows to learn from here
    assert docs.join(toxic, "doc_id").count() < toxic.count() / 2


def test_pipeline_last_stage_and_tables(spark, tmp_path):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    sql = mixing.sql(corpus_pipeline.MIX_RATIO)
    chosen = mixed.select("doc_id", "domain", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "n_tokens", "epoch")
    same(chosen, connect(SF), sql)
    assert set(mixed.columns) == {*docs.columns, "domain", "n_tokens", "epoch"}
    other = common.written(docs.limit(3), "other")  # of another run
    with common.collected() as own:
        out = corpus_pipeline.run(spark, SF)
    assert own == [] and 0 < out.count()
    (left,) = {p.rsplit("/", 1)[0] for p in out.inputFiles()}
    assert "mixing" in left and other.count() == 3
    common.release(spark, [left])
