"""Language identification by prediction by partial matching (PPM, escape method C).

For each language a variable-order tree of byte contexts (orders 0 to ``order``) is counted on a
bounded sample of its labelled documents and then frozen. A symbol x after context s costs
-log2(c(s,x) / (n(s) + q(s))) bits where it was seen, else the escape -log2(q(s) / (n(s) + q(s)))
and its cost after the context shortened by one byte; a context that was never seen costs
nothing, and below order 0 all 256 bytes are alike. n: symbols counted, q: distinct ones. The
text's exact code length is the sum over its whole bytes; the shortest code names the language.

Training reads at most ``max_docs`` documents of at most ``max_doc_bytes`` bytes for each
language (those with the smallest hash of the id; of longer documents the first bytes, where a
language has no shorter one), so the trees are bounded by max_docs *
max_doc_bytes * (order + 1) entries a language whatever the corpus holds. They are broadcast.

Defined cases: a null text or one without letters is ``und`` with score 0, and so is any text
where nothing could be learned; equal code lengths go to the smaller label; labels are taken as
they are; a null label teaches nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, groups_of, id_text, map_arrow, materialise, text_bytes

ORDER = 3
MAX_DOCS = 400
MAX_DOC_BYTES = 16_384
CHUNK = 1 << 20
FEW_LANGUAGES = 4096
UND = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


def grams(text: np.ndarray, k: int) -> np.ndarray:
    """The k-byte strings of ``text`` as numbers; one for each position from k - 1 on."""
    out = np.zeros(max(0, len(text) - k + 1), np.uint64)
    for i in range(k):
        out = (out << np.uint64(8)) | text[i: len(text) - k + 1 + i]
    return out


def _count(order: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for k in range(1, order + 2):
            values, n = np.unique(np.concatenate([grams(np.frombuffer(t.lower(), np.uint8), k) for t in pdf["t"]]),
                                  return_counts=True)
            rows.append(pd.DataFrame({"lang": pdf["lang"].iloc[0], "k": k, "gram": values.astype(np.int64), "n": n}))
        return pd.concat(rows)

    return run


def training_sample(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang",
                    id_col: str = "doc_id", max_docs: int = MAX_DOCS, max_doc_bytes: int = MAX_DOC_BYTES) -> DataFrame:
    """(lang, t): at most ``max_docs`` documents a language, those with the smallest hash; the first
    ``max_doc_bytes`` bytes of longer ones where a language has no other."""
    usable = docs.where(learn & col(text_col).isNotNull() & col(lang_col).isNotNull()).select(
        col(lang_col).cast("string").alias("lang"), text_bytes(text_col).alias("t"),
        (F.shiftrightunsigned(F.xxhash64(id_text(id_col)), 1) / F.lit(float(2**63))).alias("u"))
    usable = usable.where(F.length("t") >= 1).withColumn("short", F.length("t") <= max_doc_bytes)
    n = usable.groupBy(F.col("lang").alias("l")).agg(F.count_if("short").alias("n_short"), F.count(F.lit(1)).alias("n"))
    n = n.select("l", F.when(F.col("n_short") > 0, F.col("n_short")).otherwise(F.col("n")).alias("n"), (F.col("n_short") > 0).alias("has_short"))
    share = materialise(n.select("l", "has_short", F.least(F.lit(1.0), F.lit(2.0 * max_docs) / F.col("n")).alias("share")), "languages")
    if share.count() <= FEW_LANGUAGES:  # else a shuffle join
        share = F.broadcast(share)
    near = usable.join(share, F.col("lang") == F.col("l")).where("u <= share and short = has_short")
    near = near.select("lang", F.substring("t", 1, max_doc_bytes).alias("t"), "u")
    first = Window.partitionBy("lang").orderBy("u", "t")
    return near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= max_docs).select("lang", "t")


class Ppm:
    """Frozen trees of all languages side by side: for each order the strings seen in any
    language, with each language's code length of the last byte after the others."""

    def __init__(self, counts: pd.DataFrame, order: int):
        self.order = order
        self.langs = sorted(counts["lang"].unique().tolist())
        place = {x: i for i, x in enumerate(self.langs)}
        wide = len(self.langs)
        self.keys, self.cost, self.contexts, self.escape = [], [], [], []
        below_keys, below = None, None
        for k in range(1, order + 2):
            own = counts[counts["k"] == k]
            keys = np.unique(own["gram"].to_numpy())
            n = np.zeros((len(keys), wide))
            n[np.searchsorted(keys, own["gram"].to_numpy()), own["lang"].map(place).to_numpy()] = own["n"].to_numpy()
            contexts, where = np.unique(keys >> 8, return_inverse=True)
            total, distinct = np.zeros((len(contexts), wide)), np.zeros((len(contexts), wide))
            np.add.at(total, where, n)
            np.add.at(distinct, where, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(distinct / (total + distinct)), 0.0)
                seen = -np.log2(n / (total + distinct)[where])
            if k == 1:
                lower = np.full((len(keys), wide), 8.0)
            else:
                lower = below[np.searchsorted(below_keys, keys & ((1 << (8 * (k - 1))) - 1))]
            cost = np.where(n > 0, seen, escape[where] + lower)
            self.keys.append(keys.astype(np.uint64))
            self.cost.append(cost)
            self.contexts.append(contexts.astype(np.uint64))
            self.escape.append(escape)
            below_keys, below = keys, cost
        self._index()

    def _index(self) -> None:
        """A first look-up for the longest strings: one of them for each hash slot."""
        self.bits = max(8, int(np.ceil(np.log2(max(2, len(self.keys[-1]))))) + 2)
        self.slot = np.zeros(1 << self.bits, np.int32)
        self.slot[self._hash(self.keys[-1])] = np.arange(len(self.keys[-1]))

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _find(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        table = self.keys[k - 1]
        if k <= self.order:
            i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
            return i, table[i] == keys
        i = self.slot[self._hash(keys)]
        hit = table[i] == keys
        rest = np.flatnonzero(~hit)
        j = np.minimum(np.searchsorted(table, keys[rest]), len(table) - 1)
        i[rest], hit[rest] = j, table[j] == keys[rest]
        return i, hit

    def symbol_costs(self, strings: np.ndarray, k: int) -> np.ndarray:
        """Bits (rows: strings of k bytes; columns: languages) of each last byte."""
        i, hit = self._find(k, strings)
        out = self.cost[k - 1][i]
        miss = np.flatnonzero(~hit)
        if len(miss):
            if k == 1:
                out[miss] = 8.0 + self.escape[0][0]
            else:
                at = self.contexts[k - 1]
                before = strings[miss] >> np.uint64(8)
                j = np.minimum(np.searchsorted(at, before), len(at) - 1)
                escape = np.where((at[j] == before)[:, None], self.escape[k - 1][j], 0.0)
                shorter = strings[miss] & np.uint64((1 << (8 * (k - 1))) - 1)
                out[miss] = escape + self.symbol_costs(shorter, k - 1)
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of whole texts under each language. The first bytes have shorter contexts."""
        out = np.zeros((len(texts), len(self.langs)))
        full = self.order + 1
        if max(map(len, texts), default=0) > 4 * CHUNK:  # a very long text goes by pieces
            for i, t in enumerate(texts):
                out[i] = sum((self._pieces(np.frombuffer(t.lower(), np.uint8))), np.zeros(len(self.langs)))
            return out
        data = np.frombuffer(b"".join(texts).lower(), np.uint8)
        sizes = np.array([len(t) for t in texts], np.int64)
        start = np.cumsum(sizes) - sizes
        if len(data) >= full:
            costs = self.symbol_costs(grams(data, full), full)  # row r: the byte at r + order
            long = np.flatnonzero(sizes >= full)
            ends = np.empty(2 * len(long), np.int64)
            ends[0::2], ends[1::2] = start[long], np.minimum(start[long] + sizes[long] - self.order, len(costs))
            if len(long):
                sums = np.add.reduceat(np.vstack([costs, np.zeros((1, costs.shape[1]))]), ends, axis=0)
                out[long] = sums[0::2]
        for k in range(1, full):
            has = np.flatnonzero(sizes >= k)
            if len(has):
                head = np.zeros(len(has), np.uint64)
                for i in range(k):
                    head = (head << np.uint64(8)) | data[start[has] + i]
                out[has] += self.symbol_costs(head, k)
        return out

    def _pieces(self, data: np.ndarray):
        full = self.order + 1
        for k in range(1, min(full, len(data) + 1)):
            yield self.symbol_costs(grams(data[:k], k), k).sum(axis=0)
        for a in range(0, max(0, len(data) - self.order), CHUNK):
            yield self.symbol_costs(grams(data[a: a + CHUNK + self.order], full), full).sum(axis=0)


def train(sample: DataFrame, order: int = ORDER) -> Ppm | None:
    """Count each language's tree in Spark; None if there is nothing to learn from."""
    counts = sample.groupBy("lang").applyInPandas(_count(order), "lang string, k int, gram long, n long").toArrow().to_pandas()
    return Ppm(counts, order) if len(counts) else None


def predict(model: Ppm | None, texts: list[bytes | None]) -> tuple[list[str], list[float]]:
    labels, scores = [UND] * len(texts), [0.0] * len(texts)
    if model is None:
        return labels, scores
    known = [i for i, t in enumerate(texts) if t and has_letter(t)]
    some = [texts[i] for i in known]
    for a, b in groups_of(some, CHUNK):
        bits = model.code_lengths(some[a:b])
        best = bits.argmin(axis=1)
        share = 1.0 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
        for i, j, s in zip(known[a:b], best.tolist(), share.tolist()):
            labels[i], scores[i] = model.langs[j], s
    return labels, scores


def _predict(model, raw: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            labels, scores = predict(model.value, batch.column(names.index(raw)).to_pylist())
            own = {"lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def identify(docs: DataFrame, model: Ppm | None, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the posterior share 2^-bits of the language
    among all learned ones at equal priors."""
    (raw,) = fresh(docs, "__raw")
    keep = [col(c) for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    out = docs.select(*keep, col(text_col).cast("binary").alias(raw), F.lit("").alias("lang_pred"),
                      F.lit(0.0).alias("score"))
    return map_arrow(out, _predict(docs.sparkSession.sparkContext.broadcast(model), raw)).drop(raw)


def keep_identified(docs: DataFrame, model: Ppm | None, text_col: str = "text") -> DataFrame:
    """The documents that have a language, with their own columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that the columns added clash with none
    renamed = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)])
    found = identify(renamed, model, dict(zip(docs.columns, names))[text_col])
    return found.where(F.col("lang_pred") != UND).select(*[col(n).alias(c) for c, n in zip(docs.columns, names)])
