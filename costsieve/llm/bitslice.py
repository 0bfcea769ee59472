"""Exact top-k by a bit-sliced index.

Vectors are quantised to whole numbers (floor(scale * x), x as double). Each block of rows keeps,
for every component, bitmaps over its rows: one for each bit of (component - least) and of
(greatest - component), and their multiples by the digits 0 to 15. A query's score is the sum of
its components times the row's; with the greater or the lesser form chosen by the sign, all
summands are whole numbers from 0 on. They are added as bitmaps: full adders work on 64 rows at a
time and leave the score's slices. The top rows are then
selected from the most significant slice downward: rows surely in, rows still possible, until the
slices end; the rows that are then still possible tie at the boundary, and those of smaller ids
fill the places. That is exact for each block; the blocks' winners meet in a last top-k.

The rows whose id is divisible by ``every`` are a stated query set. They are taken in blocks of at
most ``query_block`` rows, each broadcast on its own, against all blocks of rows.

Defined cases: vectors that are null, or hold null or non-finite components, take no part, and
neither do null ids. Components may be large: a block has as many slices as its own ranges need, and
fewer rows where these are wide. A component of 2^62 or more after quantising, or a score among the
highest that doesn't fit in 64 bits, is an error. Vectors meet only vectors of the same length; empty
ones score 0; an empty table gives no rows. A repeated candidate row stays a candidate of its own; of query rows with one id
the smallest vector is taken; a query's own row is every row of its id.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from costsieve.llm.common import col, materialise

SCALE = 64
TOP = 20
EVERY = 20
ROW_BLOCK = 32_768
QUERY_BLOCK = 8_192
DIGIT = 4
INDEX_BYTES = 256 << 20
LARGEST = 2.0**62


def quantised(table: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vec array<long>) of the vectors that take part."""
    too_large = F.raise_error(F.lit("a component is too large for an index in 64 bits"))
    x = F.transform(col(vec_col), lambda v: F.when(F.abs(v.cast("double") * scale) < LARGEST, F.floor(v.cast("double") * scale)).otherwise(too_large))
    raw = table.where(col(id_col).isNotNull() & col(vec_col).isNotNull()).where(
        ~F.exists(col(vec_col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))))
    return raw.select(col(id_col).cast("long").alias("id"), x.cast("array<long>").alias("vec"))


def add(total: list[np.ndarray], other: list[np.ndarray], shift: int = 0) -> list[np.ndarray]:
    """Sum of two numbers given as slices, lowest first; ``other`` shifted up. Bitmap full adders."""
    out, carry = total[:shift], None
    if len(total) < shift:
        zero = np.zeros_like(other[0])
        out = total + [zero] * (shift - len(total))
    for i in range(max(len(total) - shift, len(other))):
        a = total[i + shift] if i + shift < len(total) else None
        b = other[i] if i < len(other) else None
        if a is None or b is None:
            x = b if a is None else a
            if carry is None:
                out.append(x)
            else:
                out.append(x ^ carry)
                carry = x & carry
        elif carry is None:
            out.append(a ^ b)
            carry = a & b
        else:
            half = a ^ b
            out.append(half ^ carry)
            carry = (a & b) | (half & carry)
    if carry is not None:
        out.append(carry)
    return out


class Block:
    """The index of one block of rows of one vector length."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray):
        by = np.argsort(ids, kind="stable")
        self.ids, vecs = ids[by], vecs[by].astype(np.int64)
        self.n, self.dims = vecs.shape
        self.words = ceil(self.n / 64)
        self.every = self._bitmap(np.ones(self.n, bool))
        self.least, self.greatest = vecs.min(axis=0).tolist(), vecs.max(axis=0).tolist()
        self.table = [[self._multiples(x) for x in (vecs[:, j] - self.least[j], self.greatest[j] - vecs[:, j])]
                      for j in range(self.dims)]

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(bits, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def _multiples(self, x: np.ndarray) -> list[list[np.ndarray]]:
        """Slices of 0x to 15x."""
        one = [self._bitmap((x >> s) & 1 > 0) for s in range(int(x.max()).bit_length())]
        zero = np.zeros(self.words, np.uint64)
        made = [[], one]
        for d in range(2, 1 << DIGIT):
            made.append([zero, *made[d // 2]] if d % 2 == 0 and one else add(made[d - 1], one))
        return made

    def slices(self, query: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the scores of all rows, and what they lack of the score."""
        total: list[np.ndarray] = []
        base = 0
        for x, (plus, minus), least, greatest in zip(query, self.table, self.least, self.greatest):
            base += x * (least if x >= 0 else greatest)
            forms, size, shift = (plus if x >= 0 else minus), abs(x), 0
            while size:
                if forms[size & 15]:
                    total = add(total, forms[size & 15], shift)
                size >>= DIGIT
                shift += DIGIT
        return total, base

    def top(self, query: list[int], own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """(row numbers, scores) of the query's k highest scores in this block."""
        slices, base = self.slices(query)
        possible = self.every.copy()
        for r in range(*np.searchsorted(self.ids, [own, own + 1]).tolist()):
            possible[r // 64] &= ~np.uint64(1 << (r % 64))
        sure = np.zeros_like(possible)
        for s in reversed(slices):
            upper = possible & s
            both = sure | upper
            if int(np.bitwise_count(both).sum()) > k:
                possible = upper
            else:
                sure = both
                possible &= ~s
        rows = self._rows(sure)
        if len(rows) < k:  # ids rise with the row numbers
            rows = np.sort(np.r_[rows, self._rows(possible)[: k - len(rows)]])
        word, bit = rows // 64, (rows % 64).astype(np.uint64)
        scores = [base] * len(rows)
        for s, bitmap in enumerate(slices):
            for i in np.flatnonzero((bitmap[word] >> bit) & np.uint64(1)).tolist():
                scores[i] += 1 << s  # Python's numbers: parts of a sum may need more than 64 bits
        return rows, scores

    @staticmethod
    def _rows(bitmap: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def rows_of_index(vecs: np.ndarray, most: int = INDEX_BYTES) -> int:
    """How many of the rows may share an index of ``most`` bytes of bitmaps."""
    width = sum(r.bit_length() + DIGIT for r in (vecs.max(axis=0) - vecs.min(axis=0)).tolist())
    return max(64, most * 8 // ((2 << DIGIT) * max(1, width)))


def _search(block, k: int, row_block: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def index_and_ask(ids: list, vecs: list):
        sizes = np.array([len(v) for v in vecs])
        for dims, (query_ids, queries) in block.value.items():
            here = np.flatnonzero(sizes == dims)
            if not len(here):
                continue
            own_ids = np.array([ids[i] for i in here], np.int64)
            own = np.array([vecs[i] for i in here], np.int64).reshape(len(here), dims)
            step = rows_of_index(own)
            for a in range(0, len(here), step):
                index = Block(own_ids[a:a + step], own[a:a + step])
                out = [(query_id, *index.top(query, query_id, k)) for query_id, query in zip(query_ids, queries)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([o[0] for o in out], [len(o[1]) for o in out]), pa.int64()),
                     pa.array(np.concatenate([index.ids[o[1]] for o in out]), pa.int64()),
                     pa.array([x for o in out for x in o[2]], pa.int64())], schema=schema)

    def run(batches):
        ids, vecs = [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            vecs += [np.array(v, np.int64) for v in batch.column(1).to_pylist()]
            while len(ids) >= row_block:
                yield from index_and_ask(ids[:row_block], vecs[:row_block])
                ids, vecs = ids[row_block:], vecs[row_block:]
        if ids:
            yield from index_and_ask(ids, vecs)

    return run


def top_k(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = TOP, every: int = EVERY,
          scale: int = SCALE, row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each query, ties to
    the smaller id."""
    spark = table.sparkSession
    rows = materialise(quantised(table, id_col, vec_col, scale), "vectors")
    n = rows.count()
    dealt = rows.repartition(max(1, ceil(n / row_block)))
    asked = materialise(rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("vec").alias("vec")), "queries")
    n_blocks = max(1, ceil(asked.count() / query_block))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = None
    for b in range(n_blocks):
        mine: dict[int, tuple[list, list]] = {}
        for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == b).collect():
            own = mine.setdefault(len(r["vec"]), ([], []))
            own[0].append(r["id"])
            own[1].append(r["vec"])
        block = spark.sparkContext.broadcast(mine)
        found = dealt.mapInArrow(_search(block, k, row_block), "query_id long, vec_id long, score long")
        ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        out = ranked if out is None else out.union(ranked)
    return out.select("query_id", "rank", "vec_id", "score")
