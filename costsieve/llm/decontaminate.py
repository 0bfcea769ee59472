"""Benchmark decontamination by suffix arrays over the training words.

Every Arrow batch of documents is a shard. A shard's words are numbered by the benchmark's
vocabulary (any other word: 0, where no match can go on), its runs of known words that are long
enough to hold a window become one sequence, and a suffix array sorts that sequence by prefix
doubling. Every suffix of every benchmark item is then binary-searched in the array, word by
word, all suffixes at once. The ranges found give all places of each window; runs of them on one
diagonal are the longest verbatim matches.

The benchmark is a stated query set: it is read in blocks of at most about ``block_words`` words,
each broadcast on its own, and the corpus passes by each block. Nothing is shuffled and a shard
needs memory for one batch only.

Defined cases: a null text or a text without words has no words and is not contaminated; items
without words match nothing; an item with a null id marks words but is not listed; repeated items
with one id count once; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from itertools import repeat
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import LOWER_ALNUM, col, fresh, map_arrow, materialise, text_bytes

WINDOW = 13
BLOCK_WORDS = 4_000_000
MATCHES = "array<struct<item_id:string,item_start:bigint,doc_start:bigint,n_words:bigint>>"


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(LOWER_ALNUM).split()


class Suffixes:
    """All suffixes of a block of items, over the word numbers of the block's vocabulary."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.ids: list[str | None] = []
        words, starts, item, length = [], [], [], []
        for item_id, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in alnum_words(text)]
            if not own:
                continue
            need = min(window, len(own))
            for p in range(len(own) - need + 1):
                starts.append(len(words) + p)
                item.append(len(self.ids))
                length.append(need)
            self.ids.append(item_id)
            words += own + [0]
        self.words = np.array(words, np.int64)
        self.start = np.array(starts, np.int64)
        self.item = np.array(item, np.int64)
        self.need = np.array(length, np.int64)
        first = np.r_[0, np.flatnonzero(self.words == 0) + 1][: len(self.ids)]
        self.item_first = first.astype(np.int64)

    @property
    def shortest(self) -> int:
        return int(self.need.min()) if len(self.need) else 0


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``seq`` sorted by their first ``depth`` symbols at least (prefix doubling)."""
    rank, k = seq, 1
    while k < depth:
        ahead = np.zeros_like(rank)
        ahead[:-k] = rank[k:]
        values, rank = np.unique(rank * (int(rank.max()) + 1) + ahead, return_inverse=True)
        if len(values) == len(seq):
            break
        k *= 2
    return np.argsort(rank, kind="stable")


def bound(seq: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray,
          after: bool) -> np.ndarray:
    """Binary search in each range [lo, hi) of the array: the first suffix whose symbol at offset
    ``at`` is not below ``word`` (``after``: above it)."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) // 2
        there = seq[order[np.where(open_, mid, 0)] + at]
        right = open_ & ((there <= word) if after else (there < word))
        lo = np.where(right, mid + 1, lo)
        hi = np.where(open_ & ~right, mid, hi)


def search(seq: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(suffix number, position) of every place where a suffix's first ``need`` words stand."""
    deepest = int(suffixes.need.max())
    order = suffix_array(seq, deepest)
    padded = np.r_[seq, np.zeros(deepest, seq.dtype)]
    who = np.arange(len(suffixes.start))
    lo, hi = np.zeros(len(who), np.int64), np.full(len(who), len(seq), np.int64)
    out_who, out_lo, out_hi = [], [], []
    for at in range(deepest):
        word = suffixes.words[suffixes.start[who] + at]
        lo, hi = bound(padded, order, lo, hi, at, word, False), bound(padded, order, lo, hi, at, word, True)
        full = (hi > lo) & (suffixes.need[who] == at + 1)
        out_who.append(who[full])
        out_lo.append(lo[full])
        out_hi.append(hi[full])
        on = (hi > lo) & ~full
        who, lo, hi = who[on], lo[on], hi[on]
        if not len(who):
            break
    who, lo, hi = map(np.concatenate, (out_who, out_lo, out_hi))
    n = hi - lo
    shift = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(who, n), order[np.repeat(lo, n) + shift]


def shard_matches(texts: list[bytes], suffixes: Suffixes) -> tuple[list[int], dict[int, list[tuple]]]:
    """Word counts of the shard's documents, and by document number its longest verbatim matches
    (item number, item_start, doc_start, n_words)."""
    get, shortest = suffixes.vocabulary.get, suffixes.shortest
    counts, parts, part_doc, part_at = [], [], [], []
    for i, text in enumerate(texts):
        words = alnum_words(text)
        counts.append(len(words))
        if not shortest or len(words) < shortest:
            continue
        ids = np.fromiter(map(get, words, repeat(0)), np.int64, len(words))
        cut = np.flatnonzero(ids == 0)
        begin, end = np.r_[0, cut + 1], np.r_[cut, len(ids)]
        for b, e in zip(begin[end - begin >= shortest].tolist(), end[end - begin >= shortest].tolist()):
            parts.append(np.r_[ids[b:e], 0])
            part_doc.append(i)
            part_at.append(b)
    found: dict[int, list[tuple]] = {}
    if not parts:
        return counts, found
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    who, pos = search(np.concatenate(parts), suffixes)
    if not len(who):
        return counts, found
    # one row per run of places on a diagonal: the longest verbatim matches
    diagonal = pos - suffixes.start[who]
    by = np.lexsort((pos, diagonal, suffixes.item[who]))
    who, pos, diagonal = who[by], pos[by], diagonal[by]
    item = suffixes.item[who]
    new = np.r_[True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(who)] - 1
    part = np.searchsorted(first, pos[head], side="right") - 1
    length = pos[last] - pos[head] + suffixes.need[who[head]]
    item_start = suffixes.start[who[head]] - suffixes.item_first[item[head]]
    for p, it, a, x, n in zip(part.tolist(), item[head].tolist(), item_start.tolist(), pos[head].tolist(),
                              length.tolist()):
        found.setdefault(part_doc[p], []).append((it, a, part_at[p] + x - int(first[p]), n))
    return counts, found


def _find(block, text: str, n_words: str, matches: str):
    def run(batches):
        suffixes = block.value
        for batch in batches:
            names = batch.schema.names
            counts, found = shard_matches(batch.column(names.index(text)).to_pylist(), suffixes)
            old = batch.column(names.index(matches)).to_pylist()
            now = [
                (x or []) + [{"item_id": suffixes.ids[m[0]], "item_start": m[1], "doc_start": m[2], "n_words": m[3]}
                             for m in sorted(found.get(i, []))]
                for i, x in enumerate(old)
            ]
            own = {n_words: pa.array(counts, pa.int64()), matches: pa.array(now, batch.schema.field(matches).type)}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words`` (long) and ``matches``: the longest verbatim matches of at least
    ``window`` words (a shorter item: the whole item), with their places in words from 0."""
    spark = docs.sparkSession
    items = benchmark.select(col(item_id).cast("string").alias("item_id"), text_bytes(item_text).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n_blocks = max(1, ceil(total / 6 / block_words))  # a word has some six bytes
    (raw,) = fresh(docs, "__raw")
    keep = [col(c) for c in docs.columns if c.lower() not in ("n_words", "matches")]
    out = docs.select(*keep, text_bytes(text_col).alias(raw), F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast(MATCHES).alias("matches"))
    for k in range(n_blocks):
        mine = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(n_blocks)) == k)
        rows = [(r[0], bytes(r[1])) for r in mine.collect()]
        block = spark.sparkContext.broadcast(Suffixes(sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1])), window))
        out = map_arrow(out, _find(block, raw, "n_words", "matches"))
        if k < n_blocks - 1:  # no long chain of Python workers
            out = materialise(out, "decontaminate")
    return out.drop(raw)


def hit_words(matches: Column) -> Column:
    """Words inside any match: the length of the union of the spans."""
    spans = F.array_sort(F.transform(matches, lambda m: F.struct(
        m["doc_start"].alias("a"), (m["doc_start"] + m["n_words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to"))
    return F.aggregate(
        spans, zero,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), x["b"] - F.greatest(s["to"], x["a"]))).alias("n"),
                              F.greatest(s["to"], x["b"]).alias("to")),
        lambda s: s["n"])


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """At least a twentieth of the words lies inside benchmark windows."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that the columns added clash with none
    renamed = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)])
    found = benchmark_matches(renamed, benchmark, dict(zip(docs.columns, names))[text_col], **options)
    clean = found.where(~contaminated(F.col("n_words"), hit_words(F.col("matches"))))
    return clean.select(*[col(n).alias(c) for c, n in zip(docs.columns, names)])
