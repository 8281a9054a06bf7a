from __future__ import annotations

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docgrid.llm import common, hyperminhash, lexical, token_alignment

SF = "/root/testdata/sf0.001"


def rows_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def documents(spark):
    return [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").select("doc_id", "text").collect()]


# Tokenizer alignment


def slow_alignment(rows):
    a_tok = Tokenizer.from_file(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json")
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model")
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}

    def piece(i):
        p = b_tok.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("\u2581", " ").encode()

    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            a, b = a_tok.encode(" " + text, add_special_tokens=False).ids, b_tok.encode(text)
            a_bytes, b_bytes = [bytes(chars[c] for c in a_tok.id_to_token(i)) for i in a], [piece(i) for i in b]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                i = j = x = y = 0
                left, right = [], []
                while i < len(a) or j < len(b):
                    if x <= y:
                        x, i = x + len(a_bytes[i]), i + 1
                        left.append(a[i - 1])
                    else:
                        y, j = y + len(b_bytes[j]), j + 1
                        right.append(b[j - 1])
                    if x == y:
                        groups.append((left, right))
                        left, right = [], []
        links = [(p, q) for left, right in groups for p in left for q in right]
        counts.update(set(links))
        docs.append((doc_id, groups, links))
    top = collections.defaultdict(int)
    for (p, _), n in counts.items():
        top[p] = max(top[p], n)
    text = lambda groups: ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
    return sorted(
        (
            (d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(k), sum(counts[x] == top[x[0]] for x in k), sum(counts[x] for x in k), hashlib.sha256(text(g).encode()).hexdigest() if g else "")
            for d, g, k in docs
        ),
        key=repr,
    )


@pytest.mark.parametrize("part", [3000, token_alignment.PART_BYTES])
def test_token_alignment(spark, part):
    rng = random.Random(3)
    bits = [" ", "  ", "\n", " \n", "\t", "a", "b", "'s", "\u00e9", "\u4e2d", "\U0001f600", "\u00a0", "\u2581", "<|endoftext|>", "</s>", "<0x0A>", "1", "...", "\u0085", "\x1c", "\x00", "\u3000", "\u0301", "the", " the", "ing", "\r\n", "\ufb01"]
    rows = documents(spark)
    rows += [(10_000 + i, "".join(rng.choices(bits, k=rng.randrange(40)))) for i in range(400)]
    rows += [(20_000, None), (20_001, ""), (20_002, " "), (20_003, "   "), (20_005, "a" * 20_000), (20_006, " " * 3000), (20_007, "\u4e2d" * 3000), (20_008, "x \u2581 y"), (20_009, "ab" * 5000 + " z"), (None, "one"), (20_005, "a" * 20_000)]
    docs = rows_of(spark, rows).withColumns({c: F.lit(c) for c in ("part", "pairs", "n_a", "of", "pair")})
    got = token_alignment.align(docs.repartition(3), part_bytes=part)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_alignment(rows)


@pytest.mark.parametrize("long, wide", [(0, 0), (token_alignment.LONG, token_alignment.WIDE_GROUP)])
def test_alignment_is_the_same_by_words_and_by_ranges(monkeypatch, long, wide):
    monkeypatch.setattr(token_alignment, "LONG", long)
    monkeypatch.setattr(token_alignment, "WIDE_GROUP", wide)
    a, b = token_alignment.byte_level(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json"), token_alignment.pieced(f"{token_alignment.TOKENIZERS}/piece_bpe_32k.model")
    texts = ["some words of a text", " " * 400, "a" * 3000, "x\n \n", "ab" * 50 + "zzz"]
    rows, _, _ = token_alignment._part(pa.array(texts), a, b)
    want = {r[0]: r for r in slow_alignment(list(enumerate(texts)))}
    for i in range(len(texts)):
        assert tuple(int(rows[c][i]) for c in ("n_a", "n_b", "n_groups", "n_links")) == want[i][1:5] and rows["groups_sha256"][i] == want[i][7]


def test_token_alignment_of_nothing(spark):
    assert token_alignment.align(rows_of(spark, [])).count() == 0
    assert [tuple(r)[1:] for r in token_alignment.align(rows_of(spark, [(1, None)])).collect()] == [(0, 0, 0, 0, 0, 0, "")]


# Lexical search


def slow_search(rows, items, k):
    found = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    docs = [(d, collections.Counter(found(t))) for d, t in rows]
    lengths = [sum(c.values()) for _, c in docs]
    n, total = sum(x > 0 for x in lengths), sum(lengths)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for (d, c), size in zip(docs, lengths):
            if size:
                m = 100 - 75 + (75 * size * n) // total
                scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in found(text) if t in c), d is None, d))
        out += [(item, i + 1, d, -s) for i, (s, _, d) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, batch", [(1, lexical.ITEM_BYTES), (5000, 300), (lexical.SHARD_BYTES, lexical.ITEM_BYTES)])
def test_lexical_search(spark, shard, batch):
    rng = random.Random(2)
    words = ["alpha", "Beta", "\u00c9t\u00e9", "x1", "\u4e2d\u6587", "of", "rare"]
    rows = [(i, " ".join(rng.choices(words[:-1], k=rng.randrange(12)))) for i in range(60)]
    rows += [(100 + i, "same text, same score!") for i in range(30)]
    rows += [(200, None), (201, ""), (202, "-- !"), (203, "rare " + "of " * 3000), (204, "a_b\tC-d"), (205, "\u00c9T\u00c9")]
    items = [(1, "same score"), (2, "alpha beta beta of"), (3, None), (4, ""), (5, "unheard"), (6, "RARE x1; \u4e2d\u6587"), (7, "\u00c9t\u00e9 A_B c")]
    docs = rows_of(spark, rows).withColumns({c: F.lit(c) for c in ("shard", "term", "ids", "counts")}).repartition(2)
    queries = spark.createDataFrame(items, "item_id long, text string").withColumn("term", F.lit("x"))
    got = lexical.search(lexical.index(docs, shard), queries.unionByName(queries), k=10, batch=batch)
    assert sorted(map(tuple, got.collect())) == slow_search(rows, items, 10)


def test_lexical_search_of_nothing_and_null_ids(spark):
    docs = rows_of(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (1, "c")])
    items = spark.createDataFrame([(None, "a"), (2, "c")], "item_id long, text string")
    got = lexical.search(lexical.index(docs), items, k=2).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id) for r in got), key=repr) == sorted([(None, 1, 3), (None, 2, 3), (2, 1, 1)], key=repr)
    assert lexical.search(lexical.index(docs), items.limit(0)).count() == lexical.search(lexical.index(docs.limit(0)), items).count() == 0


def test_best_keeps_ties_by_id():
    scores = np.array([5, 7, 5, 0, 5, 9, 5])
    ids = np.array([6, 5, 4, 3, 2, 1, 0])
    assert sorted(lexical.best(scores, ids, 4).tolist()) == [1, 4, 5, 6]
    assert sorted(lexical.best(scores, ids, 6).tolist()) == [0, 1, 2, 4, 5, 6]


# HyperMinHash


def slow_set(text):
    raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    words = raw.split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_classes(rows, percent):
    sets = [slow_set(t) for _, t in rows]
    parent, holders = list(range(len(rows))), collections.defaultdict(list)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for j, n in collections.Counter(j for x in s for j in holders[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
        for x in s:
            holders[x].append(i)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)], d == low[find(i)]) for i, (d, _) in enumerate(rows))


def near_texts(rng, first, sizes, copies):
    rows = []
    for size in sizes:
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        rows.append((first + len(rows), " ".join(base)))
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randrange(size // 30 + 2)):
                copy[rng.randrange(size)] = f"w{rng.randrange(5000)}"
            rows.append((first + len(rows), " ".join(copy[: size - rng.randrange(size // 12 + 1)])))
    return rows


@pytest.mark.parametrize("percent, block", [(85, 3), (85, hyperminhash.BLOCK), (80, hyperminhash.BLOCK)])
def test_hyperminhash_classes(spark, monkeypatch, percent, block):
    rng = random.Random(4)
    rows = documents(spark) + near_texts(rng, 10_000, [5, 7, 8, 12, 20, 40, 80, 200, 700], 12)
    words = [f"c{i}" for i in range(500)]
    rows += [(20_000 + k, " ".join(words[k * 12 : k * 12 + 200])) for k in range(12)]  # each near the next only
    rows += [(30_000, None), (30_001, ""), (30_002, " \t"), (30_003, "A b"), (30_004, "a  B"), (30_005, "a b c"), (30_006, "\u00e9 \u00c9"), (30_007, "\u00c9 \u00e9"), (30_008, "long " * 100_000)]
    monkeypatch.setattr(hyperminhash.links, "__defaults__", (hyperminhash.PERCENT, block))
    docs = rows_of(spark, rows).withColumns({c: F.lit(c) for c in ("rid", "fp", "keys", "component", "n")})
    want = slow_classes(rows, percent)
    assert sum(not r[3] for r in want) > 60
    assert sorted(map(tuple, hyperminhash.classes(docs.repartition(3), percent).collect())) == want


def test_hyperminhash_null_ids_repeats_and_nothing(spark):
    text = "one two three four five six"
    got = hyperminhash.classes(rows_of(spark, [(None, text), (4, text), (4, text), (None, "alone"), (None, None), (7, None)])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (None, 1, None, True), (None, 0, None, True), (7, 0, 7, True)], key=repr)
    assert hyperminhash.classes(rows_of(spark, [])).count() == 0


def test_compared_pairs_grow_with_the_rows(spark):
    """Texts that share two thirds of their words with all others, but are no copies, meet in bands yet not in pairs."""

    def pairs(n):
        rng = random.Random(n)
        template = [f"t{i}" for i in range(130)]
        rows = [(i, " ".join(template + [f"w{rng.randrange(10**6)}" for _ in range(70)])) for i in range(n)]
        found = hyperminhash.described(rows_of(spark, rows), 0.8)
        _, across = hyperminhash.links(rows_of(spark, rows), common.written(found, "prints"), 80)
        return across.count()

    few, many = pairs(300), pairs(600)
    assert many <= 2.2 * max(25, few)


def test_estimates_lose_no_similar_pair(spark):
    """Of sets of known similarity, the condition of the join lets all pass that reach it, and few that are far below."""
    rng = np.random.default_rng(1)
    found, starts, true = [], [0], []
    for size in (30, 150, 700, 5000):
        for share in (0.5, 0.8, 0.85, 0.9, 0.97):
            for _ in range(12):
                both = int(np.ceil(size * 2 * share / (1 + share)))
                h = np.unique(rng.integers(0, 1 << 63, 2 * size - both, np.uint64) * np.uint64(2) + np.uint64(1))
                first = rng.permutation(h)[:size]
                second = np.concatenate((first[:both], np.setdiff1d(h, first)))
                for s in (first, second):
                    found.append(np.sort(s)), starts.append(starts[-1] + len(s))
                true.append(both / len(h))
    values, filled = hyperminhash.registers(np.concatenate(found), np.array(starts))
    planes = np.concatenate([np.packbits(values >> k & 1, axis=1) for k in range(hyperminhash.MANTISSA)], axis=1)
    size = np.diff(starts)
    rows = [(k // 2, k % 2, int(size[k]), float(hyperminhash.slack(0.8, size[k : k + 1])[0]), planes[k].view("<i8").tolist(), np.packbits(filled[k]).view("<i8").tolist()) for k in range(len(size))]
    df = spark.createDataFrame(rows, "pair long, side long, n long, slack double, bits array<long>, filled array<long>")
    a, b = df.where("side = 0").alias("x"), df.where("side = 1").alias("y")
    passed = {r[0] for r in a.join(b, (F.col("x.pair") == F.col("y.pair")) & hyperminhash._likely(0.8, "x", "y")).select("x.pair").collect()}
    assert {k for k, t in enumerate(true) if t >= 0.8} <= passed
    assert not {k for k, t in enumerate(true) if t < 0.55 and size[2 * k] >= 150} & passed


def test_shingle_sets_split_words_as_stated():
    texts = pa.array(["A b\tc\x0bD e F", None, "", "one", "One", "a b c d e f", " \n", "\u00c9 x"])
    found, starts = hyperminhash.shingle_sets(texts)
    sets = [set(found[i:j].tolist()) for i, j in zip(starts, starts[1:])]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 1, 2, 0, 1] and sets[0] == sets[5] and sets[3] == sets[4]
