"""Alignment of two tokenizers' tokens over the same bytes.

Both tokenizers end a token before a space that stands between two characters that are not white
space: the first splits texts there, and the second has no piece with a space behind anything but
spaces. So a text is a sequence of words that are encoded independently, and a part of the
documents (about ``PART_BYTES`` of text) needs each different word once.

DuckDB aligns a part's words, laid out on one line of bytes: token interval tables, an ASOF join that
finds the ends common to both, a window sum that numbers the groups between these, and a range join
that puts the second tokenizer's tokens into the first's groups. Links of a word are counted by pair
of ids. A part keeps, for each document, the numbers of its pairs and how often it has them, and for
each of its pairs in how many documents it is. Spark adds these counts up over all parts, joins the
totals back to the parts, and each part's documents sum them over their links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgrid.llm.common import slices, written

PART_BYTES = 4 << 20
#: Words are encoded in runs of about so many characters.
RUN = 1 << 13
#: Words of more bytes are joined by their ranges alone.
LONG = 1 << 12
#: Groups of more links are counted by id before their tokens are paired.
WIDE_GROUP = 1 << 10
#: Ids are below this, so that a pair of ids is one number.
WIDE = 1 << 16
TOKENIZERS = "/opt/tokenizers"
# Fixed value: the pattern by which the byte-level tokenizer cuts texts before its merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CUT = re.compile(r"(?<=\S) (?=\S)")
_DOCS = "part long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, pair array<long>, held array<int>"
_NAMES = [c.split()[0] for c in _DOCS.split(", ")]


@dataclass
class Coder:
    """A tokenizer: the ids of a text that follows a space, and each id's bytes (none for ids that stand for no text)."""

    encode: Callable[[str], list[int]]
    pieces: list[bytes]

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of words (not empty) that each follow a space: all ids, each one's end on the line of bytes of all words, and the
        numbers of words whose tokens' bytes differ from the word (these have no tokens)."""
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        odd: list[int] = []
        size = np.array([len(p) for p in self.pieces])
        at, done = 0, 0

        def run(first: int, last: int) -> None:
            nonlocal done
            text = " ".join(words[first:last])
            whole = b" " + text.encode()
            found = self.encode(text)
            if b"".join([self.pieces[i] for i in found]) == whole:
                ids.append(np.array(found, np.int64))
                ends.append(done + np.cumsum(size[ids[-1]]))
            elif last - first > 1:
                for i in range(first, last):
                    run(i, i + 1)
                return
            else:
                odd.append(first)
            done += len(whole)

        while at < len(words):
            last, n = at, 0
            while last < len(words) and n < RUN:
                n += len(words[last]) + 1
                last += 1
                if words[last - 1][-1].isspace():  # what follows it would not begin a token
                    break
            run(at, last)
            at = last
        none = [np.zeros(0, np.int64)]
        return np.concatenate(ids or none), np.concatenate(ends or none), np.array(odd, np.int64)


def byte_level(path: str) -> Coder:
    """The byte-level BPE of a tokenizer file: a token's id is its rank, so the merges are those of the file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        known = json.load(f)
    special = {t["id"] for t in known.get("added_tokens", [])}
    vocabulary = {i: bytes(chars[c] for c in token) for token, i in known["model"]["vocab"].items() if i not in special}
    encoding = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks={b: i for i, b in vocabulary.items()}, special_tokens={})
    pieces = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
    return Coder(lambda text: encoding.encode_ordinary(" " + text), pieces)


def pieced(path: str) -> Coder:
    """A sentencepiece model that puts a space before each text."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    space = "▁"
    pieces = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i):
            pieces.append(b"")
        elif model.is_byte(i):
            pieces.append(bytes([int(piece[3:5], 16)]))
        else:
            if re.search(f"[^{space}]{space}", piece):
                raise ValueError("a piece goes on behind a word's end")
            pieces.append(piece.replace(space, " ").encode())
    return Coder(lambda text: model.encode(text, num_threads=1), pieces)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Texts as words: for each word in turn its text's number and its own, and the different words. Words
    are what stands between spaces that have no white space on either side; empty texts have none."""
    parts = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), " ")
    coded = parts.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    edge = np.array([w == "" or w[0].isspace() or w[-1].isspace() for w in words], bool)
    wrong = np.unique(text[edge[word]]) if len(word) else np.zeros(0, np.int64)
    if not len(wrong):
        return text, word, words
    stays = ~np.isin(text, wrong)
    number = {w: i for i, w in enumerate(words)}
    more_text, more_word = [], []
    for n in wrong.tolist():
        for w in _CUT.split(texts[n].as_py() or ""):
            if w:
                more_text.append(n)
                more_word.append(number.setdefault(w, len(number)))
    text, word = np.concatenate((text[stays], np.array(more_text, np.int64))), np.concatenate((word[stays], np.array(more_word, np.int64)))
    used, word = np.unique(word, return_inverse=True)
    order = np.argsort(text, kind="stable")
    names = list(number)
    return text[order], word[order], [names[i] for i in used.tolist()]


@dataclass
class Words:
    """Of each word: tokens, groups and links, its groups as text, and its pairs (CSR: first, pair, times)."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    texts: list[str]
    first: np.ndarray
    pair: np.ndarray
    times: np.ndarray
    odd: np.ndarray


@cache
def _marks() -> np.ndarray:
    """An id after a new group of its word, before its group's second side, within a side, and at a word's start."""
    return np.array([f"{sep}{i}" for sep in (";", "|", ",", "") for i in range(WIDE)], object)


def aligned(words: list[str], a: Coder, b: Coder) -> Words:
    """The words' tokens, aligned by DuckDB."""
    sizes = np.array([len(w.encode()) + 1 for w in words], np.int64)
    line = np.cumsum(sizes)
    (a_ids, a_ends, a_odd), (b_ids, b_ends, b_odd) = a.tokens(words), b.tokens(words)
    odd = np.zeros(len(words), bool)
    odd[a_odd], odd[b_odd] = True, True

    size_kind = np.int32 if sizes.sum() < 1 << 31 else np.int64
    long = sizes > LONG

    def table(ids: np.ndarray, ends: np.ndarray, coder: Coder) -> pa.Table:
        begin = ends - np.array([len(p) for p in coder.pieces])[ids]
        word = np.searchsorted(line, begin, "right")
        keep = ~odd[word]
        return pa.table({"s": begin[keep].astype(size_kind), "e": ends[keep].astype(size_kind), "id": ids[keep].astype(np.int32), "word": word[keep].astype(np.int32), "long": long[word[keep]]})

    with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "1GB", "temp_directory": ""}) as db:
        db.register("a", table(a_ids, a_ends, a))
        db.register("b", table(b_ids, b_ends, b))
        db.execute("""create temp table ga as
          select s, e, id, word, long, coalesce(sum(cast(common as int)) over (order by s rows between unbounded preceding and 1 preceding), 0)::int as g
          from (select a.*, coalesce(b.e = a.e, false) as common from a asof left join b on a.e >= b.e)""")
        db.execute("create temp table spans as select g, min(s) as s, max(e) as e, any_value(word) as word, any_value(long) as long from ga group by g")
        # words are short, so a word's tokens and groups are few; within the long ones the ranges alone decide
        db.execute("create temp table gb as select b.s, b.id, b.word, spans.g from b join spans on b.word = spans.word and b.s >= spans.s and b.s < spans.e where not b.long and not spans.long")
        if long.any():
            db.execute("insert into gb select b.s, b.id, b.word, x.g from (select * from b where long) b join (select * from spans where long) x on b.s >= x.s and b.s < x.e")
        db.execute(f"create temp table wide as select g from (select g, count(*) as n from ga group by g having n > 8) join (select g, count(*) as m from gb group by g having m > 8) using (g) where n * m > {WIDE_GROUP}")
        first, second = (db.execute(f"select word, g, id from {t} order by s").fetchnumpy() for t in ("ga", "gb"))
        links = [db.execute(f"select x.word, x.id::bigint * {WIDE} + y.id as pair, 1::bigint as times from ga x join gb y using (g) where g not in (from wide)").fetchnumpy()]
        if db.execute("select count(*) from wide").fetchone()[0]:  # ids are counted before they meet
            links.append(db.execute(f"""select x.word, x.id::bigint * {WIDE} + y.id as pair, (x.n * y.n)::bigint as times
              from (select g, id, any_value(word) as word, count(*) as n from ga where g in (from wide) group by g, id) x
              join (select g, id, count(*) as n from gb where g in (from wide) group by g, id) y using (g)""").fetchnumpy())
    both = {c: np.concatenate([np.asarray(t[c], np.int64) for t in (first, second)]) for c in ("word", "g", "id")}
    both["side"] = np.repeat([0, 1], [len(first["g"]), len(second["g"])])
    order = np.argsort(both["g"] * 2 + both["side"], kind="stable")
    rows = {c: x[order] for c, x in both.items()}
    links = {c: np.concatenate([np.asarray(t[c], np.int64) for t in links]) for c in ("word", "pair", "times")}
    order = np.argsort(links["word"], kind="stable")
    links = {c: x[order] for c, x in links.items()}
    n = len(words)
    word, side, ids = rows["word"], rows["side"], rows["id"]
    new_group = np.diff(rows["g"], prepend=-1) != 0
    new_word = np.diff(word, prepend=-1) != 0
    kind = np.where(new_group, np.where(new_word, 3, 0), np.where(np.diff(side, prepend=0) != 0, 1, 2))
    told = _marks()[kind * WIDE + ids].tolist()
    start = np.searchsorted(word, np.arange(n + 1))
    count = lambda of, weights=None: np.bincount(of, weights, n).astype(np.int64)
    return Words(
        count(word[side == 0]), count(word[side == 1]), count(word[new_group]), count(links["word"], links["times"]),
        ["".join(told[i:j]) for i, j in zip(start[:-1].tolist(), start[1:].tolist())],
        np.searchsorted(links["word"], np.arange(n + 1)), links["pair"], links["times"], odd,
    )


def _part(texts: pa.Array, a: Coder, b: Coder) -> tuple[dict[str, np.ndarray | list], np.ndarray, np.ndarray]:
    """A part's documents (columns of ``_DOCS``), its pairs, and in how many documents each is."""
    n = len(texts)
    text, word, words = words_of(texts)
    known = aligned(words, a, b)
    broken = np.zeros(n, bool)
    broken[text[known.odd[word]]] = True
    keep = ~broken[text]
    text, word = text[keep], word[keep]
    total = lambda per: np.bincount(text, per[word], n).astype(np.int64)
    out: dict[str, np.ndarray | list] = {c: total(getattr(known, c)) for c in ("n_a", "n_b", "n_groups", "n_links")}
    start = np.searchsorted(text, np.arange(n + 1)).tolist()
    lists = word.tolist()
    out["groups_sha256"] = [hashlib.sha256(";".join([known.texts[w] for w in lists[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip(start, start[1:])]
    pairs, number = np.unique(known.pair, return_inverse=True)
    times = [np.zeros(0, np.int64)] * n
    own = list(times)
    held = np.zeros(len(pairs), np.int64)
    at, step = 0, max(1, (1 << 20) // max(1, int(np.diff(known.first).max(initial=1))))
    del lists
    while at < n:  # some documents at a time
        z = max(at + 1, int(np.searchsorted(start, start[at] + step, "right")) - 1)
        w, t = word[start[at] : start[z]], text[start[at] : start[z]]
        size = known.first[w + 1] - known.first[w]
        place = np.repeat(known.first[w] - np.cumsum(size) + size, size) + np.arange(size.sum())
        code, back = np.unique(np.repeat(t, size) * len(pairs) + number[place], return_inverse=True)
        sums = np.bincount(back, known.times[place], len(code)).astype(np.int64)
        of, pair = code // max(1, len(pairs)), code % max(1, len(pairs))
        held += np.bincount(pair, minlength=len(pairs))
        edges = np.searchsorted(of, np.arange(at, z + 1)).tolist()
        for k in range(at, z):
            own[k], times[k] = pair[edges[k - at] : edges[k - at + 1]], sums[edges[k - at] : edges[k - at + 1]]
        at = z
    out["pairs"] = [np.diff(p, prepend=0).astype("<i4").tobytes() for p in own]
    out["times"] = [t.astype("<i4").tobytes() for t in times]
    return out, pairs, held


def _parts(docs: DataFrame, a_path: str, b_path: str, part_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(a_path), pieced(b_path)
        number = TaskContext.get().partitionId() << 32
        kinds = {"n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "pairs": pa.binary(), "times": pa.binary()}
        for batch in batches:
            for part in slices(batch, "text", part_bytes):
                n = part.num_rows
                rows, pairs, held = _part(part.column("text"), a, b)
                lists = [pa.nulls(n, pa.list_(pa.int64())), pa.nulls(n, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, number)), part.column("doc_id"), *[pa.array(rows[c], kind) for c, kind in kinds.items()], *lists], _NAMES)
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind)) for x, kind in ((pairs, pa.int64()), (held, pa.int32()))]
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.int64()), *[pa.nulls(1, kind) for kind in kinds.values()], *lists], _NAMES)
                number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(run, _DOCS), "alignment")


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, count (documents that hold it linked), best (whether no pair of its first id has more)."""
    each = parts.where("pair is not null").select(F.explode(F.arrays_zip("pair", "held")).alias("x")).select("x.pair", "x.held")
    counts = each.groupBy("pair").agg(F.sum("held").cast("long").alias("count")).withColumn("a", F.expr(f"pair div {WIDE}"))
    top = counts.groupBy("a").agg(F.max("count").alias("top"))
    return counts.join(top, "a").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))


def align(docs: DataFrame, a_path: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_path: str = f"{TOKENIZERS}/piece_bpe_32k.model", part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``.

    A space stands before each text. Null and empty texts, and texts that the tokens of either side do not
    spell again, have no tokens: zeros and ''. Rows repeated in ``docs`` count as documents of their own; a null
    doc_id is kept; other columns are ignored; an empty table gives an empty result. The files are read by
    tasks and must be at ``a_path`` and ``b_path`` on each executor."""
    parts = _parts(docs, a_path, b_path, part_bytes)
    at = parts.where("pair is not null").select("part", F.posexplode("pair").alias("at", "pair"))
    known = at.join(pair_counts(parts), "pair").select(F.col("part").alias("of"), "at", "count", "best")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def run(rows: pa.Table, figures: pa.Table) -> pa.Table:
        place = figures.column("at").to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = figures.column("count").to_numpy(), figures.column("best").to_numpy().astype(np.int64)
        n_best, total = [], []
        for pairs, times in zip(rows.column("pairs").to_pylist(), rows.column("times").to_pylist()):
            pair, n = np.cumsum(np.frombuffer(pairs, "<i4"), dtype=np.int64), np.frombuffer(times, "<i4").astype(np.int64)
            n_best.append(int(n @ best[pair])), total.append(int(n @ count[pair]))
        rows = rows.drop_columns(["part", "pairs", "times"])
        rows = rows.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(total, pa.int64()))
        return rows.select([c.split()[0] for c in schema.split(", ")])

    rows = parts.where("pair is null").select(*_NAMES[:-2])
    return rows.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(run, schema)
