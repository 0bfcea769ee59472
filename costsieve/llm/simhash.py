"""SimHash near-duplicates by pigeonring filtering.

A fingerprint has a bit set where over half of the text's shingle hashes have it set. Equal
fingerprints are one class from the start (a partial aggregate, whatever the number of copies);
only distinct ones are compared.

Pigeonring: the 64 bits lie in ``max_bits + 1`` segments on a ring. If two fingerprints differ in
at most t = max_bits bits, then from some segment on every chain of l consecutive segments (l = 1
to m) differs in at most l * t / m bits in sum. The chain's first segment thus has to be equal: it
is the join key. The join condition requires the longer chains' budgets one after the other, and
the whole ring is the full Hamming check.

A bucket of a first segment that holds over ``bucket_limit`` distinct fingerprints would mean all
its pairs. Its members get a longer key from the next budgets: with m = t + 1 segments the chain of
l segments differs in at most l - 1 bits, so the l-th does as well, and of l parts of it at least one
is equal. Part by part, the second and the following segments lengthen the key, as long as a
bucket is too large (for two bits: 21, about 32, then about 39 bits). Each step keeps every pair.

What is still in a large bucket then is a dense cluster. It goes an exact way that is linear: each
member sends itself and its 64 one-bit neighbours, and those that meet at one string (65 at most)
differ in two bits at most; they are linked to the smallest. This covers every pair of such a bucket;
it is written for two bits. For any other ``max_bits`` the last buckets are compared pair by pair.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other;
fewer words than a shingle: the whole sequence is the only shingle; a null id never names a
component unless no id is there; repeated rows are each kept and share a component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, map_arrow, materialise, text_bytes
from costsieve.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 2
SEED = 42
BUCKET_LIMIT = 128
_PIECE = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, _PIECE):
        part = zip(starts[a:a + _PIECE], ends[a:a + _PIECE])
        h = np.array([digest(joined[x:y], SEED) for x, y in part], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def _fingerprints(raw: str, out: str, shingle: int):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts = batch.column(names.index(raw)).to_pylist()
            own = {out: pa.array([fingerprint(t, shingle) for t in texts], pa.int64()),
                   raw: pa.array([b""] * len(texts), pa.binary())}
            yield pa.RecordBatch.from_arrays([own.get(n, batch.column(k)) for k, n in enumerate(names)], names=names)

    return run


def with_fingerprint(docs: DataFrame, out: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    (raw,) = fresh(docs, "__raw")
    ready = docs.select(*[col(c) for c in docs.columns if c.lower() != out.lower()], text_bytes(text_col).alias(raw),
                        F.lit(0).cast("bigint").alias(out))
    return map_arrow(ready, _fingerprints(raw, out, shingle)).drop(raw)


def _masks(m: int, first: int = 0, last: int = 64) -> list[int]:
    """The bits of each of m segments of bits ``first`` to ``last``, as signed 64-bit numbers."""
    cuts = [first + (last - first) * i // m for i in range(m + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def _part_masks(m: int, level: int) -> list[list[int]]:
    """For each start on the ring, the ``level + 1`` parts of the segment ``level`` steps on."""
    segments = [(start + level) % m for start in range(m)]
    return [_masks(level + 1, 64 * j // m, 64 * (j + 1) // m) for j in segments]


def _chain(m: int, budget: int, start: int, x: Column, y: Column) -> Column:
    """Cumulative differences from segment ``start`` on stay within the proportional budgets."""
    masks, keep = _masks(m), F.lit(True)
    for length in range(2, m):
        mask = 0
        for j in range(length):
            mask |= masks[(start + j) % m]
        keep &= F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(mask))) <= length * budget // m
    return keep


def _place(rows: DataFrame, m: int, level: int) -> DataFrame:
    """Each (fp, ring, part, seg) once for each part of its next segment, the key ``seg`` longer by it."""
    masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in parts]) for parts in _part_masks(m, level)])
    each = rows.select("fp", "ring", "part", "seg", F.posexplode(masks[F.col("ring")]).alias("j", "mask"))
    return each.select("fp", "ring", (F.col("part") * (level + 1) + F.col("j")).alias("part"),
                       F.col("seg").bitwiseOR(F.col("fp").bitwiseAND(F.col("mask"))).alias("seg"))


def near_links(prints: DataFrame, max_bits: int = MAX_BITS, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp``: each pair within ``max_bits`` bits that shares
    a bucket of bounded size, and for those of dense clusters edges with the same components."""
    m = max_bits + 1
    chain = F.lit(False)
    for i in range(m):
        chain |= (F.col("ring") == i) & _chain(m, max_bits, i, F.col("x"), F.col("y"))
    full = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= max_bits
    key = ["ring", "part", "seg"]
    open_ = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("ring"), F.lit(0).cast("long").alias("part"),
                          F.lit(0).cast("long").alias("seg"))
    found = None
    for level in range(m):
        placed = materialise(_place(open_, m, level), "segments")
        if level and placed.isEmpty():
            return found
        sizes = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = placed.join(sizes, key)
        small = F.lit(True) if level == m - 1 and max_bits != 2 else F.col("n") <= bucket_limit
        few = sized.where(small)
        x, y = few.select(F.col("fp").alias("x"), *key), few.select(F.col("fp").alias("y"), *[F.col(k).alias(f"{k}2") for k in key])
        same = (F.col("ring") == F.col("ring2")) & (F.col("part") == F.col("part2")) & (F.col("seg") == F.col("seg2"))
        links = x.join(y, same & (F.col("x") > F.col("y")) & chain & full).select(F.col("x").alias("u"), F.col("y").alias("v"))
        found = links if found is None else found.union(links)
        open_ = sized.where(~small).select("fp", *key)
    if max_bits == 2:
        found = found.union(_links_by_neighbour(open_.select("fp").distinct()))
    return found


def _links_by_neighbour(prints: DataFrame) -> DataFrame:
    """Exact links within two bits through a shared one-bit neighbour; 65 rows a fingerprint."""
    flips = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    sent = prints.select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(b)) for b in flips])).alias("at"))
    met = sent.groupBy("at").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    return met.select(F.explode(F.slice("fps", 2, 64)).alias("u"), F.col("fps")[0].alias("v"))


def groups(prints: DataFrame, id_col: str, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, component_id) for the table of (id, fp): the component's least fingerprint and
    the smallest id reachable."""
    classes = materialise(prints.groupBy("fp").agg(F.min(col(id_col)).alias("first")), "classes")
    roots = connected_components(near_links(classes.select("fp"), max_bits))
    rooted = materialise(
        classes.join(roots, F.col("fp") == F.col("vertex"), "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    least = rooted.groupBy(F.col("root").alias("k")).agg(F.min("first").alias("component_id"))
    return rooted.join(least, F.col("root") == F.col("k")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint as a signed long, component_id), one row for each document."""
    prints = materialise(
        with_fingerprint(docs.select(col(id_col).alias("id"), col(text_col).alias("text")), "fp", "text", shingle)
        .select("id", "fp"), "fingerprints")
    found = groups(prints, "id", max_bits).withColumnRenamed("fp", "f")
    return prints.join(found, F.col("fp") == F.col("f")).select(
        F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                         max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each component, the one with the smallest id (a null id is the largest; of
    rows with one id, any one), with its own columns."""
    names = [f"__c{i}" for i in range(len(docs.columns))]  # so that the columns added clash with none
    by = dict(zip(docs.columns, names))
    renamed = docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)], F.monotonically_increasing_id().alias("row"))
    table = materialise(with_fingerprint(renamed, "fp", by[text_col], shingle), "fingerprinted")
    prints = table.select(F.col(by[id_col]).alias("id"), "fp", "row")
    found = groups(prints, "id", max_bits).select(F.col("fp").alias("f"), "root")
    order = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("b"), F.col("row").alias("row"))
    firsts = prints.groupBy("fp").agg(F.min(order).alias("best")).join(found, F.col("fp") == F.col("f"))
    stay = firsts.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias("r"))
    gone = prints.select("row").join(stay, F.col("row") == F.col("r"), "left_anti").select(F.col("row").alias("r"))
    kept = table.join(gone, F.col("row") == F.col("r"), "left_anti")
    return kept.select(*[col(n).alias(c) for c, n in zip(docs.columns, names)])
