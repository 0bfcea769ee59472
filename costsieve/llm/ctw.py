"""Language-model scoring by context-tree weighting (CTW) over bytes, beside a unigram base score.

The model. Each byte is decomposed into its eight binary decisions, most significant bit first:
255 decision nodes. Each of them has a context tree over the ``DEPTH`` bytes before the current
one (of the same text; \\xff, which UTF-8 never uses, stands before the text's start and is also
the symbol for its end). Every context of up to ``DEPTH`` bytes is a node, however rare. A node
with a zeros and b ones has the Krichevsky-Trofimov block probability
Pe = G(a+1/2) G(b+1/2) / (pi G(a+b+1)). Its weighted probability is Pe at a leaf and else
(Pe + product of its children's) / 2: all depths are mixed with the weights that the training data
give them. Counts are frozen after training. The chance of a bit is the weighted mix from the
deepest node up, p_d = (B KT_d + p_(d+1)) / (B + 1), where B = Pe / product of the children.

The work. Counting is a distributed aggregate over all texts: tasks count their strings of
``DEPTH`` + 1 bytes and words by pieces, Spark adds them up. A string of the texts that are only
scored is in the table too, with count 0, which changes no probability. The strings are dealt by
their two newest context bytes and sorted; a task holds whole pairs, weighs their contexts of two
and more bytes, and hands on what the depths above need: at most 256 x 255 decisions, added up by
Spark and mixed in the driver. A second pass over the same table mixes down and gives each string's
log chance. That table grows with the corpus and is never broadcast whole: at most ``HOT_CODES``
frequent strings are, and the ``HOT_WORDS`` most frequent words (of at most 64 bytes each); the
rest of each text's strings and words join their tables by shuffles. Every exact count is used.

Defined cases: a null text is an empty one, which has the end alone; rows are scored one by one,
repeated rows too; without training texts every count is 0, every bit has chance 1/2 and the base
score's denominator is 1.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, groups_of, materialise, text_bytes

DEPTH = 4
END = b"\xff"
PAD = END * DEPTH
HOT_WORDS = 65_536
HOT_BYTES = 64
HOT_CODES = 1 << 19
SLOTS = 1 << 20
PAIR_CODES = 1 << 17
PIECE = 1 << 20
PIECE_TEXT = 2 * PIECE
WORDS_HELD = 300_000


def parts_of(batches, raw: str):
    """Slices of the batches with some PIECE_TEXT bytes of text each: what one step holds in Python
    doesn't follow the rows of a batch."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.names.index(raw))).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // PIECE_TEXT)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def codes_of(data: np.ndarray) -> np.ndarray:
    """Each byte after the first DEPTH with its context, as one number: oldest byte on top."""
    out = np.zeros(len(data) - DEPTH, np.int64)
    for i in range(DEPTH + 1):
        out = (out << 8) | data[i: len(data) - DEPTH + i]
    return out


def strings(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all symbols, and the number of symbols of each text, its end included."""
    codes = codes_of(np.frombuffer(b"".join(PAD + t + END for t in texts), np.uint8))
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    at_pad = np.cumsum(sizes + DEPTH)[:-1] - DEPTH  # what follows an end: the next text's padding
    return np.delete(codes, np.concatenate([at_pad + i for i in range(DEPTH)])) if len(at_pad) else codes, sizes


def pieces(text: bytes):
    """A long text's codes by pieces."""
    whole = PAD + text + END
    for a in range(0, len(text) + 1, PIECE):
        yield codes_of(np.frombuffer(whole[a:a + PIECE + DEPTH], np.uint8))


def all_codes(texts: list[bytes]):
    """(codes, sizes of the texts in them) for groups of texts of bounded size."""
    for a, b in groups_of(texts, PIECE):
        if len(texts[a]) > 2 * PIECE:
            for codes in pieces(texts[a]):
                yield codes, None, (a, b)
        else:
            codes, sizes = strings(texts[a:b])
            yield codes, sizes, (a, b)


def _summed(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of the rows of ``n``."""
    distinct, where = np.unique(values, return_inverse=True)
    sums = np.zeros((len(distinct), n.shape[1]), np.int64)
    np.add.at(sums, where, n)
    return distinct, sums


def _count(raw: str, learn: str):
    schema = pa.schema([("word", pa.binary()), ("code", pa.int64()), ("n", pa.int64()), ("seen", pa.int64())])

    def codes_rows(held):
        values, n = _summed(np.concatenate([v for v, _ in held]), np.concatenate([n for _, n in held]))
        return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.binary()), pa.array(values), pa.array(n[:, 0]), pa.array(n[:, 1])], schema=schema)

    def words_rows(words: Counter):
        n = pa.array(list(words.values()), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(len(words), pa.int64()), n, n], schema=schema)

    def run(batches):
        words, held, size, ends = Counter(), [], 0, 0
        for batch in parts_of(batches, raw):
            texts = [t.lower() for t in batch.column(batch.schema.names.index(raw)).to_pylist()]
            flags = batch.column(batch.schema.names.index(learn)).to_pylist()
            for learns in (True, False):
                some = [t for t, x in zip(texts, flags) if x is learns]
                if learns:
                    ends += len(some)
                    for t in some:
                        words.update(t.split())
                        if len(words) > WORDS_HELD:
                            yield words_rows(words)
                            words = Counter()
                for codes, _, _ in all_codes(some):
                    values, n = np.unique(codes, return_counts=True)
                    held.append((values, np.stack([n * learns, n], axis=1)))
                    size += len(values)
                    if size > PIECE:
                        yield codes_rows(held)
                        held, size = [], 0
        if words:
            yield words_rows(words)
        if held:
            yield codes_rows(held)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.array([ends], pa.int64()), pa.array([ends], pa.int64())], schema=schema)

    return run


def corpus_counts(texts: DataFrame, text_col: str, learn: Column | None = None) -> DataFrame:
    """(word, code, n, seen): counts of words (code null), of byte strings (word null) and of ends
    (both null) over the rows of ``texts`` where ``learn`` holds (all, without it). Byte strings of
    the other rows are there as well; ``seen`` counts all rows."""
    raw, flag = fresh(texts, "__raw", "__learn")
    holds = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    counted = texts.select(text_bytes(text_col).alias(raw), holds.alias(flag)).mapInArrow(
        _count(raw, flag), "word binary, code long, n long, seen long")
    summed = counted.groupBy("word", "code").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"))
    return materialise(summed.where("seen > 0"), "ctw-counts")


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma(x) for x > 0, by Stirling's series at x + 10."""
    down = np.zeros_like(x)
    for i in range(10):
        down += np.log(x + i)
    z = x + 10
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7) - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - np.log(np.pi) - log_gamma(zeros + ones + 1.0)


def decisions(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones (rows x 255) of the binary decisions of symbol counts (rows x 256). Node
    2^k - 1 + x: the decision after the k first bits x."""
    zeros, ones = [], []
    for k in range(8):
        halves = counts.reshape(len(counts), 1 << k, 2, -1).sum(axis=3)
        zeros.append(halves[:, :, 0])
        ones.append(halves[:, :, 1])
    return np.concatenate(zeros, axis=1).astype(float), np.concatenate(ones, axis=1).astype(float)


def mix(zeros, ones, log_children, deeper):
    """Chance of a one at nodes with these counts, given their children's block probability and
    the chance that the next depth's node gives."""
    weight = np.exp(np.minimum(log_kt(zeros, ones) - log_children, 700.0))
    own = (ones + 0.5) / (zeros + ones + 1.0)
    return own + (deeper - own) / (weight + 1.0)


class Shape:
    """The tree of retained contexts. Node 0 is the root; a context of d bytes has the key
    256^d + its bytes, the newest lowest."""

    def __init__(self, keys: list[int]):
        keys = np.array(sorted(keys), np.int64)  # parents come first: they have fewer bytes
        self.depth = np.r_[0, (np.frompyfunc(int.bit_length, 1, 1)(keys.astype(object)).astype(np.int64) - 1) // 8]
        self.last = np.r_[-1, keys & 255]
        self.parent = np.zeros(len(keys) + 1, np.int64)
        self.child = np.zeros((len(keys) + 1) * 256, np.int32)
        for d in range(1, int(self.depth.max()) + 1):
            own = np.flatnonzero(self.depth == d)
            key = keys[own - 1]
            oldest = (key >> (8 * (d - 1))) & 255
            above = (key & ((1 << (8 * (d - 1))) - 1)) | (1 << (8 * (d - 1)))
            self.parent[own] = 0 if d == 1 else np.searchsorted(keys, above) + 1
            self.child[self.parent[own] * 256 + oldest] = own

    def locate(self, codes: np.ndarray) -> np.ndarray:
        """The deepest node for each code."""
        node, on = np.zeros(len(codes), np.int32), np.ones(len(codes), bool)
        for d in range(1, int(self.depth.max()) + 1):
            child = self.child[node.astype(np.int64) * 256 + ((codes >> (8 * d)) & 255)]
            on &= child > 0
            node = np.where(on, child, node)
        return node


def context_shape(codes: DataFrame, min_share: float) -> Shape:
    """Contexts of all depths with at least their share of the symbols."""
    total = codes.agg(F.sum("n")).first()[0] or 0
    keys = F.array(*[F.shiftright("code", 8).bitwiseAND(F.lit((1 << (8 * d)) - 1)) + F.lit(1 << (8 * d)) for d in range(1, DEPTH + 1)])
    held = codes.select(F.explode(keys).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n"))
    return Shape([r["key"] for r in held.where(F.col("n") >= F.lit(min_share * total)).select("key").collect()])


def _deal(block):
    def run(batches):
        for batch in batches:
            codes = batch.column(0).to_numpy(zero_copy_only=False)
            n = batch.column(1).to_numpy(zero_copy_only=False)
            shape = block.value
            values, where = np.unique(shape.locate(codes).astype(np.int64) << 8 | (codes & 255), return_inverse=True)
            sums = np.zeros(len(values), np.int64)
            np.add.at(sums, where, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shape.last[values >> 8], pa.int64()), pa.array(values >> 8, pa.int64()), pa.array(values & 255, pa.int64()), pa.array(sums)],
                names=["last", "node", "symbol", "n"])

    return run


def _weigh(block):
    """One last byte's contexts: chances mixed from the deepest node up to depth 1, one row for
    each node (its other contexts), and what the root needs."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        shape = block.value
        last = int(pdf["last"].iloc[0])
        nodes = np.flatnonzero(shape.last == last)
        place = np.zeros(len(shape.last), np.int64)
        place[nodes] = np.arange(len(nodes))
        counts = np.zeros((len(nodes), 256))
        np.add.at(counts, (place[pdf["node"].to_numpy()], pdf["symbol"].to_numpy()), pdf["n"].to_numpy())
        zeros, ones = decisions(counts)
        depth, above = shape.depth[nodes], place[shape.parent[nodes]]
        chance = (ones + 0.5) / (zeros + ones + 1.0)
        log_children = log_kt(zeros, ones)  # of the other contexts; the retained ones are added below
        weighted = log_children.copy()  # right for leaves
        for d in range(DEPTH, 0, -1):
            own = np.flatnonzero(depth == d)
            if d < DEPTH:
                weighted[own] = np.logaddexp(log_kt(zeros[own], ones[own]), log_children[own]) - np.log(2)
            if d > 1:
                for whole, part in ((zeros, zeros), (ones, ones), (log_children, weighted)):
                    np.add.at(whole, above[own], part[own])
        # from each row's deepest node up to depth 1; a leaf's own estimate is already its chance
        at = np.where(depth < DEPTH, np.arange(len(nodes)), above)
        level = np.where(depth < DEPTH, depth, depth - 1)
        while (level >= 1).any():
            row = np.flatnonzero(level >= 1)
            chance[row] = mix(zeros[at[row]], ones[at[row]], log_children[at[row]], chance[row])
            at[row] = above[at[row]]
            level[row] -= 1
        top = int(np.flatnonzero(depth <= 1)[0])
        stats = np.stack([zeros[top], ones[top], weighted[top]])
        return pd.DataFrame({"last": [last], "nodes": [nodes.astype("<i4").tobytes()],
                             "chance": [chance.astype("<f8").tobytes()], "stats": [stats.astype("<f8").tobytes()]})

    return run


PATH = np.array([[(1 << k) - 1 + (s >> (8 - k)) for k in range(8)] for s in range(256)])
BIT = np.array([[(s >> (7 - k)) & 1 for k in range(8)] for s in range(256)], bool)


def symbol_logs(chance: np.ndarray) -> np.ndarray:
    """log10 chance of each of 256 symbols, from the chances of its eight decisions."""
    one, zero = np.log10(chance), np.log10(1.0 - chance)
    return np.where(BIT, one[:, PATH], zero[:, PATH]).sum(axis=2)


def _logs(stats: np.ndarray):
    zeros, ones, log_children = stats

    def run(frames):
        for pdf in frames:
            for nodes, chance in zip(pdf["nodes"], pdf["chance"]):
                nodes, chance = np.frombuffer(nodes, "<i4"), np.frombuffer(chance, "<f8").reshape(-1, 255)
                for a in range(0, len(nodes), 2048):
                    logs = symbol_logs(mix(zeros, ones, log_children, chance[a:a + 2048]))
                    yield pd.DataFrame({"nodes": [nodes[a:a + 2048].tobytes()], "logs": [logs.astype("<f4").tobytes()]})

    return run


class ContextTree:
    """The frozen model: for each node the log10 chances of 256 symbols."""

    def __init__(self, shape: Shape, root: np.ndarray, rows: list):
        self.shape = shape
        zeros, ones, log_children = root
        self.log_block = np.logaddexp(log_kt(zeros, ones), log_children) - np.log(2)
        # a last byte that was never seen: nothing is known below the root
        self.logs = np.tile(symbol_logs(mix(zeros, ones, log_children, np.full((1, 255), 0.5))), (len(shape.last), 1)).astype(np.float32)
        for r in rows:
            self.logs[np.frombuffer(r["nodes"], "<i4")] = np.frombuffer(r["logs"], "<f4").reshape(-1, 256)

    def score(self, codes: np.ndarray) -> np.ndarray:
        return self.logs[self.shape.locate(codes), codes & 255].astype(np.float64)


def train(counts: DataFrame, min_share: float = 0.0) -> ContextTree:
    """A model in memory, for texts outside the table: all contexts, or on request only those with
    a share of the symbols. ``score`` doesn't use it; its model is a table."""
    codes = counts.where("code is not null and n > 0").select("code", "n")
    shape = context_shape(codes, min_share)
    block = counts.sparkSession.sparkContext.broadcast(shape)
    dealt = codes.mapInArrow(_deal(block), "last long, node long, symbol long, n long").groupBy("last", "node", "symbol").agg(F.sum("n").alias("n"))
    weighed = materialise(dealt.groupBy("last").applyInPandas(
        _weigh(block), "last long, nodes binary, chance binary, stats binary"), "ctw-weights")
    root = np.zeros((3, 255))
    for r in weighed.select("last", "stats").orderBy("last").collect():
        root += np.frombuffer(r["stats"], "<f8").reshape(3, 255)
    rows = weighed.select("nodes", "chance").mapInPandas(_logs(root), "nodes binary, logs binary").collect()
    return ContextTree(shape, root, rows)


def text_scores(model: ContextTree, texts: list[bytes]) -> list[float]:
    out = [0.0] * len(texts)
    for codes, sizes, (a, b) in all_codes(texts):
        logs = model.score(codes)
        if sizes is None:
            out[a] += float(logs.sum())
        else:
            out[a:b] = np.add.reduceat(logs, np.cumsum(sizes) - sizes).tolist()
    return out


# ------------------------------------------------------------------ the whole tree as a table
def key_of(code: Column) -> Column:
    """The code with its context turned round: newest byte on top, so all depths' contexts are prefixes."""
    out = code.bitwiseAND(F.lit(255))
    for d in range(1, DEPTH + 1):
        out = out + F.shiftleft(F.shiftright(code, 8 * d).bitwiseAND(F.lit(255)), 8 * (DEPTH + 1 - d))
    return out


class Pairs:
    """The decisions of depths 2 to DEPTH over sorted distinct keys that hold whole pairs.

    ``keys[d]``: (context of d bytes, symbol) in order; ``up[d]``: its place at depth d - 1. For the
    k-th decision, ``node[d][k]`` is each key's node, ``first[d][k]`` each node's first key."""

    def __init__(self, keys: np.ndarray, n: np.ndarray):
        self.keys, self.up, counts = {DEPTH: keys}, {}, {DEPTH: n.astype(float)}
        for d in range(DEPTH, 2, -1):
            self.keys[d - 1], self.up[d] = np.unique(self.keys[d] >> 16 << 8 | self.keys[d] & 255, return_inverse=True)
            counts[d - 1] = np.bincount(self.up[d], counts[d])
        self.node, self.first, self.zeros, self.ones = ({d: [] for d in counts} for _ in range(4))
        for d, key in self.keys.items():
            for k in range(8):
                new = np.r_[True, np.diff(key >> (8 - k)) != 0]
                first = np.flatnonzero(new)
                ones = np.add.reduceat(counts[d] * (key >> (7 - k) & 1), first)
                self.node[d].append(np.cumsum(new) - 1)
                self.first[d].append(first)
                self.ones[d].append(ones)
                self.zeros[d].append(np.add.reduceat(counts[d], first) - ones)
        self.children, self.weighted = {d: [None] * 8 for d in counts}, {d: [None] * 8 for d in counts}
        for d in range(DEPTH, 1, -1):
            for k in range(8):
                own = log_kt(self.zeros[d][k], self.ones[d][k])
                if d < DEPTH:
                    above = self.above(d + 1, k)
                    self.children[d][k] = np.bincount(above, self.weighted[d + 1][k], len(own))
                    own = np.logaddexp(own, self.children[d][k]) - np.log(2)
                self.weighted[d][k] = own

    def above(self, d: int, k: int) -> np.ndarray:
        """For each node of depth d its node one depth up."""
        return self.node[d - 1][k][self.up[d][self.first[d][k]]]

    def decision(self, d: int, k: int) -> np.ndarray:
        """For each node of depth d its number among the 255 decisions."""
        return (1 << k) - 1 + ((self.keys[d][self.first[d][k]] & 255) >> (8 - k))

    def logs(self, upper: np.ndarray) -> np.ndarray:
        """log10 chance of each key's symbol. ``upper``: zeros, ones and log_children of depth 0 (row
        256) and of depth 1 (by last byte)."""
        out = np.zeros(len(self.keys[DEPTH]))
        for k in range(8):
            chance = (self.ones[DEPTH][k] + 0.5) / (self.zeros[DEPTH][k] + self.ones[DEPTH][k] + 1.0)
            at = np.arange(len(chance))
            for d in range(DEPTH, 2, -1):
                at = self.above(d, k)[at]
                chance = mix(self.zeros[d - 1][k][at], self.ones[d - 1][k][at], self.children[d - 1][k][at], chance)
            decision = self.decision(DEPTH, k)
            last = self.keys[DEPTH][self.first[DEPTH][k]] >> (8 * DEPTH)
            for row in (last, 256):
                chance = mix(*upper[:, row, decision], chance)
            bit = self.keys[DEPTH] >> (7 - k) & 1
            chance = chance[self.node[DEPTH][k]]
            out += np.log10(np.where(bit == 1, chance, 1.0 - chance))
        return out


def whole_pairs(batches):
    """(keys, counts) of sorted (key, n) rows, PAIR_CODES or more at a time, pairs never parted."""
    keys, n, size = [], [], 0
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        keys.append(key)
        n.append(batch.column(1).to_numpy(zero_copy_only=False))
        size += len(key)
        if size >= PAIR_CODES:
            k, m = np.concatenate(keys), np.concatenate(n)
            cut = int(np.searchsorted(k >> 24, k[-1] >> 24))  # the last pair may go on
            if cut:
                yield k[:cut], m[:cut]
            keys, n, size = [k[cut:]], [m[cut:]], 0 if cut else -len(k)
    if sum(map(len, keys)):
        yield np.concatenate(keys), np.concatenate(n)


def _up(batches):
    """What depth 1 needs of each context of two bytes."""
    for keys, n in whole_pairs(batches):
        pairs = Pairs(keys, n)
        for k in range(8):
            first = pairs.first[2][k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs.keys[2][first] >> 16), pa.array(pairs.decision(2, k)), pa.array(pairs.zeros[2][k].astype(np.int64)),
                 pa.array(pairs.ones[2][k].astype(np.int64)), pa.array(pairs.weighted[2][k])],
                names=["last", "decision", "zeros", "ones", "weighted"])


def _down(upper: np.ndarray):
    def run(batches):
        for keys, n in whole_pairs(batches):
            code = keys & 255
            for d in range(1, DEPTH + 1):
                code |= (keys >> (8 * (DEPTH + 1 - d)) & 255) << (8 * d)
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(Pairs(keys, n).logs(upper))], names=["code", "log"])

    return run


def string_logs(codes: DataFrame) -> DataFrame:
    """(code, log): the log10 chance of each string's last byte after its context, by all contexts."""
    dealt = codes.select(key_of(F.col("code")).alias("key"), "n").repartition(F.shiftright("key", 24)).sortWithinPartitions("key")
    sums = dealt.mapInArrow(_up, "last long, decision long, zeros long, ones long, weighted double").groupBy("last", "decision").agg(
        F.sum("zeros"), F.sum("ones"), F.sum(F.col("weighted").cast("decimal(38,12)")).cast("double"))
    last, decision, *stats = (c.to_numpy() for c in sums.toArrow().columns)
    upper = np.zeros((3, 257, 255))
    upper[:, last, decision] = stats
    upper[:2, 256] = upper[:2, :256].sum(axis=1)
    upper[2, 256] = (np.logaddexp(log_kt(*upper[:2, :256]), upper[2, :256]) - np.log(2)).sum(axis=0)
    return materialise(dealt.mapInArrow(_down(upper), "code long, log double"), "ctw-logs")


class HotCodes:
    """Logs of strings in two tables of slots; a string that finds both its slots taken is left out."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        """``codes``: most frequent first."""
        self.tables = []
        for level in range(2):
            keys, values = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS)
            slot = self.slot(codes, level)
            keys[slot[::-1]] = codes[::-1]  # of several the most frequent
            there = keys[slot] == codes
            values[slot[there]] = logs[there]
            self.tables.append((keys, values))
            codes, logs = codes[~there], logs[~there]

    @staticmethod
    def slot(codes: np.ndarray, level: int) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[level])
        return (mixed >> np.uint64(40)).astype(np.int64) % SLOTS

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logs, 0 where there is none; places of the codes that aren't here)."""
        keys, values = self.tables[0]
        slot = self.slot(codes, 0)
        logs, left = values[slot], np.flatnonzero(keys[slot] != codes)
        keys, values = self.tables[1]
        slot = self.slot(codes[left], 1)
        there = keys[slot] == codes[left]
        logs[left] = np.where(there, values[slot], 0.0)
        return logs, left[~there]


def hot_codes(logs: DataFrame, codes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and logs of the most frequent strings, HOT_CODES at most, whole classes of frequencies."""
    known = codes.select("code", "seen", F.floor(F.log2("seen") * 8).alias("class"))
    total, least = 0, None
    for r in known.groupBy("class").count().orderBy(F.desc("class")).collect():
        total += r["count"]
        if total > HOT_CODES:
            break
        least = r["class"]
    if least is None:
        return np.zeros(0, np.int64), np.zeros(0)
    code, log, seen = (c.to_numpy() for c in known.where(F.col("class") >= least).join(logs, "code").select("code", "log", "seen").toArrow().columns)
    order = np.lexsort((code, -seen))
    return code[order], log[order]


def hot_scores(hot: HotCodes, texts: list[bytes]) -> tuple[list[float], np.ndarray, np.ndarray, np.ndarray]:
    """Each text's sum over its hot strings, and (text, code, n) of all others, in order of texts."""
    out = [0.0] * len(texts)
    places, others, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for codes, sizes, (a, b) in all_codes(texts):
        logs, rest = hot.find(codes)
        if sizes is None:
            out[a] += float(logs.sum())
            text = np.full(len(rest), a)
        else:
            out[a:b] = np.add.reduceat(logs, np.cumsum(sizes) - sizes).tolist()
            text = a + np.searchsorted(np.cumsum(sizes), rest, side="right")
        pair, n = np.unique(np.stack([text, codes[rest]]), axis=1, return_counts=True)
        places.append(pair[0])
        others.append(pair[1])
        counts.append(n)
    return out, np.concatenate(places), np.concatenate(others), np.concatenate(counts)


RARE = "array<struct<word:binary,n:bigint>>"
RARE_CODES = "array<struct<code:bigint,n:bigint>>"


def _score(block, raw: str):
    def run(batches):
        codes, logs, hot, end = block.value
        frequent, get = HotCodes(codes, logs), hot.get
        for batch in parts_of(batches, raw):
            names = batch.schema.names
            texts = [t.lower() for t in batch.column(names.index(raw)).to_pylist()]
            tokens, known, base, rare = [], [], [], []
            for t in texts:
                words = t.split()
                logs = list(map(get, words))
                rest = Counter([w for w, x in zip(words, logs) if x is None])
                tokens.append(len(words) + 1)
                known.append(len(words) - rest.total() + (end is not None))
                base.append(sum(x for x in logs if x is not None) + (end or 0.0))
                rare.append([{"word": w, "n": n} for w, n in rest.items()])
            scores, place, code, n = hot_scores(frequent, texts)
            own = {"n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known, pa.int64()),
                   "base_score": pa.array(base, pa.float64()), "score": pa.array(scores, pa.float64()),
                   "n_bytes": pa.array([len(t) + 1 for t in texts], pa.int64()),
                   raw: pa.array([b""] * len(texts), pa.binary())}
            own["rare"] = pa.array(rare, batch.schema.field("rare").type)
            kind = batch.schema.field("rare_codes").type
            own["rare_codes"] = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(place, np.arange(len(texts) + 1)), pa.int32()),
                pa.StructArray.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], fields=list(kind.value_type)), type=kind)
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def score(docs: DataFrame, learn: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row
    of ``docs``, learning from the rows where ``learn`` holds."""
    spark = docs.sparkSession
    counts = corpus_counts(docs, text_col, learn)
    codes = counts.where("code is not null").select("code", "n", "seen")
    chances = string_logs(codes)
    words = counts.where("code is null").select("word", "n")
    total, distinct = words.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    ends = words.where("word is null").agg(F.sum("n")).first()[0]
    some = words.where(F.length("word") <= HOT_BYTES).orderBy(F.desc("n"), "word").limit(HOT_WORDS).collect()
    hot = {bytes(r["word"]): float(np.log10(r["n"] + 1)) for r in some}
    block = spark.sparkContext.broadcast((*hot_codes(chances, codes), hot, None if ends is None else float(np.log10(ends + 1))))
    null = [F.lit(0).cast("bigint").alias(c) for c in ("n_bytes", "n_tokens", "n_known")]
    ready = docs.select(col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), text_bytes(text_col).alias("raw"), *null,
                        F.lit(0.0).alias("base_score"), F.lit(0.0).alias("score"), F.array().cast(RARE).alias("rare"),
                        F.array().cast(RARE_CODES).alias("rare_codes"))
    scored = materialise(ready.mapInArrow(_score(block, "raw"), ready.schema).drop("raw"), "ctw-scores")
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", F.col("r.word").alias("w"), F.col("r.n").alias("k"))
    met = rare.join(words.where("word is not null"), F.col("w") == F.col("word"))
    strings_left = scored.select("row", F.explode("rare_codes").alias("r")).select("row", F.col("r.code").alias("c"), F.col("r.n").alias("k"))
    deep = strings_left.join(chances, F.col("c") == F.col("code"))
    added = met.select("row", "k", (F.col("k") * F.log10(F.col("n") + 1)).alias("x"), F.lit(0.0).alias("y")).unionByName(
        deep.select("row", F.lit(0).cast("bigint").alias("k"), F.lit(0.0).alias("x"), (F.col("k") * F.col("log")).alias("y"))
    ).groupBy(F.col("row").alias("at")).agg(F.sum("k").alias("more"), F.sum("x").alias("logs"), F.sum("y").alias("deep"))
    whole = F.col("score") + F.coalesce("deep", F.lit(0.0))
    bottom = F.log10(F.lit(float(total + distinct + 1)))
    return scored.join(added, F.col("row") == F.col("at"), "left").select(
        F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * bottom).alias("base_score"), whole.alias("score"),
        (-whole / F.lit(float(np.log10(2))) / F.col("n_bytes")).alias("bits_per_byte"))
