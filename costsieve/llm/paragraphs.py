"""Substring dedup: repeated paragraphs found by MinHash banding, removed but for the first copy.

A paragraph is a line of at least ``MIN_WORDS`` words (white space parts words, ASCII capitals in
lower case). Paragraphs with the same words are one class from the start; classes are compared by
their sets of ``SHINGLE``-word shingles:

1. ``bands_for`` tunes bands and rows: the most rows for which a pair at the threshold meets in
   some band with the wanted recall. Each class sends one key for each band.
2. Classes that share a key are candidates. In a bucket of at most ``BUCKET_LIMIT`` classes these
   are its pairs. A larger bucket is cut into blocks of some ``SIDE`` classes, and each pair of
   blocks is a group of its own, of bounded size: it compares its pairs and hands on a spanning
   forest of the links (fewer links than classes), which joins the same components as all of them.
   Pairs that are already joined are skipped. A filter that loses nothing spares most sets: each
   class has a bitmap of 512 bits over its shingles, two bitmaps differ in at most as many bits as
   the sets differ in shingles, and similar sets differ in few.
3. A link is verified by exact Jaccard similarity of the shingle sets, which a second scan gives for
   the classes in buckets only.
4. Components of the links are clusters. The occurrence with the smallest (id, paragraph number)
   stays, all others are removed.

Passages inside a line, or over several, have no paragraph of their own. For them, all blocks of
``BLOCK`` consecutive words of a document (line breaks are no bounds) count as paragraphs too, as
far as winnowing picks them: of every ``PASSAGE - BLOCK + 1`` neighbouring blocks the one with
the least hash. Two passages of ``PASSAGE`` equal words thus have a picked block in common. Blocks
are compared as classes only: at this length a changed word already takes 32-word blocks below
the similarity. Of each of a block's words the first occurrence whose line stays is kept; the words
of the later occurrences are cut. A word is thus only ever cut for an equal one at a smaller place
that no paragraph removal takes, and no passage is lost from the whole corpus. The cut goes on to
both sides as far as the words equal those around some earlier place, whichever has most of them: up
to ``PASSAGE - BLOCK`` words, the most that a passage has before its first picked block or after its last.

Texts are shuffled only for documents that lose a paragraph. The other documents, and paragraphs
without candidates, are passed by with a bitmap of fixed size over hashes; a false hit costs work
and changes nothing.

Defined cases: null texts stay null; empty ones have no paragraphs; rows with the same id and
text count as one document; a null id is the largest id; shorter lines are never removed.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, groups_of, map_arrow, materialise, text_bytes
from costsieve.llm.components import connected_components

MIN_WORDS = 25
SHINGLE = 5
SIMILARITY = 0.8
RECALL = 0.998
HASHES = 32
BUCKET_LIMIT = 64
SIDE = 512
BITS = 512
BLOCK, PASSAGE = 32, 50
MARKS = 1 << 24
_PIECE = 1 << 20


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): as many rows as still give the recall with at most ``hashes`` hashes."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - similarity**rows) ** bands >= recall:
                return bands, rows
    return hashes, 1


BANDS, ROWS = bands_for()


def paragraphs(text: bytes, min_words: int) -> list[tuple[int, list[bytes]]]:
    """(line number, words) of the paragraphs."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        words = line.lower().split()
        if len(words) >= min_words:
            out.append((i, words))
    return out


_BASE, _OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _BASE
    return x ^ (x >> np.uint64(29))


def windows(word: np.ndarray, size: int, base: np.uint64 = _BASE) -> np.ndarray:
    """A polynomial hash of every ``size`` consecutive words, by doubling."""
    if size == 1:
        return word
    half = size // 2
    part = windows(word, half, base)
    out = part[:-half] * base ** np.uint64(half) + part[half:]
    return out if size % 2 == 0 else out[:-1] * base + word[size - 1:]


def shingle_hashes(words: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of paragraphs that lie one after the other in ``words``, and how many
    each has. A paragraph has SHINGLE words at least (see ``padded``)."""
    n = np.array(sizes) - SHINGLE + 1
    starts = np.cumsum(sizes) - sizes
    at = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
    return mixed(windows(word_hashes(words), SHINGLE))[at], n


def padded(words: list[bytes]) -> list[bytes]:
    """Fewer words than a shingle are one shingle."""
    return words + [b""] * (SHINGLE - len(words))


def class_id(words: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(words))


_RANDOM = np.random.default_rng(20_240_229)
_TIMES = _RANDOM.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, HASHES, dtype=np.uint64)


def band_keys(hashes: np.ndarray, counts: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(paragraphs x bands) keys from each paragraph's least hash values."""
    starts = np.cumsum(counts) - counts
    keys = np.empty((len(counts), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(counts), b + 1, np.uint64)
        for r in range(rows):
            i = b * rows + r
            own = hashes * _TIMES[i] + _PLUS[i]
            own ^= own >> np.uint64(32)
            key = (key ^ np.minimum.reduceat(own * _BASE, starts)) * _OTHER
            key ^= key >> np.uint64(29)
        keys[:, b] = key
    return keys.view(np.int64)


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(col(text_col), F.lit("")))


def _scan(min_words: int):
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32()), ("class", pa.binary()),
                        *[(f"b{i}", pa.int64()) for i in range(BANDS)]])

    def table(rows, words, sizes):
        ids, texts, lines, classes = zip(*rows)
        keys = band_keys(*shingle_hashes(words, sizes))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(texts, pa.int64()), pa.array(lines, pa.int32()), pa.array(classes, pa.binary()),
             *[pa.array(np.ascontiguousarray(keys[:, i])) for i in range(BANDS)]], schema=schema)

    def run(batches):
        rows, all_words, sizes = [], [], []
        for batch in batches:
            for i, th, text in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                for line, words in paragraphs(text, min_words):
                    rows.append((i, th, line, class_id(words)))
                    words = padded(words)
                    all_words += words
                    sizes.append(len(words))
                    if len(all_words) > _PIECE // 2:
                        yield table(rows, all_words, sizes)
                        rows, all_words, sizes = [], [], []
        if rows:
            yield table(rows, all_words, sizes)

    return run


def marks(table: DataFrame, column) -> np.ndarray:
    """A bitmap of fixed size of the hash values of a column: at most MARKS bits come here."""
    out = np.zeros(MARKS, bool)
    out[table.select(F.pmod(column, F.lit(MARKS)).cast("int").alias("m")).distinct().toArrow()["m"].to_numpy()] = True
    return np.packbits(out)


def has_mark(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    m = values % MARKS
    return (bitmap[m >> 3] >> (7 - (m & 7)).astype(np.uint8) & 1).astype(bool)


def marked_rows(batch: pa.RecordBatch, bitmap: np.ndarray, column: int, wanted: bool = True) -> pa.RecordBatch:
    hit = has_mark(bitmap, batch.column(column).to_numpy(zero_copy_only=False))
    return batch.filter(pa.array(hit == wanted))


def marked(bitmap: np.ndarray, value: int) -> bool:
    m = value % MARKS
    return bool(bitmap[m >> 3] >> (7 - (m & 7)) & 1)


def class_number(digest: bytes) -> int:
    """The first 8 bytes as a signed number: what the class bitmap is over."""
    return int.from_bytes(digest[:8], "big", signed=True)


def shingle_bits(hashes: np.ndarray) -> bytes:
    """A bitmap of the shingles by the top bits of their hashes."""
    out = np.zeros(BITS, bool)
    out[(hashes >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(out).tobytes()


def _shingle_sets(block, texts, min_words: int):
    """Sets of the marked classes, from the marked texts."""
    schema = pa.schema([("class", pa.binary()), ("shingles", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches):
        seen: set[bytes] = set()
        for batch in batches:
            classes, sets, bits = [], [], []
            for text in marked_rows(batch, texts.value, 0).column(1).to_pylist():
                for _, words in paragraphs(text, min_words):
                    digest = class_id(words)
                    if marked(block.value, class_number(digest)) and digest not in seen:
                        seen.add(digest)
                        classes.append(digest)
                        own = np.unique(shingle_hashes(padded(words), [len(padded(words))])[0])
                        sets.append(own.view(np.int64))
                        bits.append(shingle_bits(own))
            if len(seen) > 200_000:
                seen.clear()  # it only saves repeats
            yield pa.RecordBatch.from_arrays([pa.array(classes, pa.binary()), pa.array(sets, pa.list_(pa.int64())), pa.array(bits, pa.binary())], schema=schema)

    return run


def _forest(similarity: float):
    """The links of a spanning forest over one group: the pairs inside a block or across two."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, sets = pdf["c"].to_numpy(), pdf["shingles"].tolist()
        bits = np.stack([np.frombuffer(x, np.uint64) for x in pdf["bits"]])
        size = np.array([len(x) for x in sets])
        right = pdf["block"].to_numpy() == pdf["b"].iloc[0]
        inside = pdf["a"].iloc[0] == pdf["b"].iloc[0]
        slack = (1 - similarity) / (1 + similarity) + 1e-9
        part = np.arange(len(ids))  # the component of each class
        links = []
        for i in np.flatnonzero(right):
            near = np.bitwise_count(bits ^ bits[i]).sum(axis=1) <= slack * (size + size[i])
            near &= (np.arange(len(ids)) < i) if inside else ~right
            for j in np.flatnonzero(near):
                if part[i] != part[j]:
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if both >= similarity * (size[i] + size[j] - both) - 1e-9:
                        links.append((ids[i], ids[j]))
                        part[part == part[i]] = part[j]
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return run


def similar_classes(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(vertex, root) over classes. ``members``: (key, c) of buckets of two or more."""
    sizes = members.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sized = materialise(members.join(sizes, F.col("key") == F.col("k")).drop("k"), "buckets")
    few = sized.where(F.col("n") <= BUCKET_LIMIT)
    x, y = few.select("key", F.col("c").alias("u")), few.select(F.col("key").alias("k"), F.col("c").alias("v"))
    pairs = x.join(y, (F.col("key") == F.col("k")) & (F.col("u") > F.col("v"))).select("u", "v").distinct()
    x = sets.select(F.col("c").alias("cx"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("c").alias("cy"), F.col("shingles").alias("sy"))
    both = F.size(F.array_intersect("sx", "sy"))
    links = (pairs.join(x, F.col("u") == F.col("cx")).join(y, F.col("v") == F.col("cy"))
             .where(both >= F.lit(similarity) * (F.size("sx") + F.size("sy") - both) - F.lit(1e-9)).select("u", "v"))
    many = sized.where(F.col("n") > BUCKET_LIMIT).withColumn("blocks", F.ceil(F.col("n") / F.lit(SIDE)))
    many = many.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks"))).withColumnRenamed("c", "m")
    each = many.join(sets, F.col("m") == F.col("c")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.select("key", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "c", "shingles", "bits")
    return connected_components(links.union(each.groupBy("key", "a", "b").applyInPandas(_forest(similarity), "u long, v long")))


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """Minimum or maximum of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = least(out[:-step], out[step:])
        have += step
    return out


def picked_blocks(texts: list[list[bytes]], block: int = BLOCK, passage: int = PASSAGE):
    """(text number, first word, 128-bit class as two columns) of the picked blocks of texts."""
    width, sizes = passage - block + 1, np.array([len(t) for t in texts])
    word = word_hashes([w for t in texts for w in t])
    if len(word) < passage:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 2), np.int64)
    first = np.cumsum(sizes) - sizes
    key, other = mixed(windows(word, block)), mixed(windows(mixed(word), block, _OTHER))
    # blocks of one text; between two texts lie more than a window's width of others
    edge = np.zeros(len(key) + 1, np.int64)
    long = sizes >= block
    np.add.at(edge, first[long], 1)
    np.add.at(edge, (first + sizes - block + 1)[long], -1)
    own = np.cumsum(edge[:-1]) > 0
    key = np.where(own, key, np.uint64(2**64 - 1))
    whole = _sliding(own.astype(np.uint8), width, np.minimum) > 0
    least = np.where(whole, _sliding(key, width, np.minimum), np.uint64(0))
    # a block is picked if it is the least of some window around it: of the windows' minima, the greatest
    around = np.r_[np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)]
    pick = own & (_sliding(around, width, np.maximum) == key)
    pick[1:] &= ~((key[1:] == key[:-1]) & pick[:-1])  # one of a run of equal blocks
    at = np.flatnonzero(pick)
    text = np.searchsorted(first, at, side="right") - 1
    return text, at - first[text], np.stack([key[at], other[at]], axis=1).view(np.int64)


def _block_classes(raw: str):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(raw)).to_pylist()
            for a, b in groups_of(texts, 1 << 21):
                keys = picked_blocks([t.lower().split() for t in texts[a:b]])[2]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)], names=["k1", "k2"])

    return run


def line_ends(text: bytes) -> np.ndarray:
    """The number of words up to the end of each line."""
    return np.cumsum([len(line.split()) for line in text.split(b"\n")])


def _marked_blocks(block, lost):
    """The marked blocks; ``runs`` only for the texts marked in ``lost``, which may lose lines."""
    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            loses = has_mark(lost.value, batch.column(1).to_numpy(zero_copy_only=False)) if lost else np.zeros(len(texts), bool)
            for a, b in groups_of(texts, 1 << 21):
                split = [t.lower().split() for t in texts[a:b]]
                text, at, keys = picked_blocks(split)
                hit = has_mark(block.value, keys[:, 0])
                text, at, keys = text[hit], at[hit], keys[hit]
                runs = []
                for t, n in zip(*np.unique(text, return_counts=True)):
                    if not loses[a + t]:
                        runs += [[]] * n
                        continue
                    ends = line_ends(texts[a + t])
                    own = at[text == t]
                    lo, hi = np.maximum(own - SIDES, 0), np.minimum(own + BLOCK + SIDES, len(split[t]))
                    first, last = np.searchsorted(ends, lo, side="right"), np.searchsorted(ends, hi - 1, side="right")
                    runs += [[x for n in range(f, z + 1) for x in (n, min(max(int(ends[n]) - w + SIDES, 0), 2 * SIDES + BLOCK))]
                             for w, f, z in zip(own.tolist(), first.tolist(), last.tolist())]
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at),
                     *[pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)], pa.array(runs, pa.list_(pa.int32()))],
                    names=[*_PLACES, "runs"])

    return run


def side_words(word: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The hashes of the words before each block, the nearest first, and of those after it; zeros
    beyond the text's ends."""
    own = (word | np.uint64(1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SIDE_BYTES]
    edge = np.zeros((SIDES, SIDE_BYTES), np.uint8)
    own = np.concatenate([edge, own, edge])
    at = np.r_[np.arange(SIDES - 1, -1, -1), np.arange(SIDES + BLOCK, 2 * SIDES + BLOCK)]
    return [row.tobytes() for row in own[starts[:, None] + at]]


def _marked_sides(block, live):
    """The sides of marked places, from the marked texts."""
    def run(batches):
        for batch in batches:
            batch = marked_rows(batch, live.value, 1)
            texts, hashes = batch.column(2).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in groups_of(texts, 1 << 21):
                split = [t.lower().split() for t in texts[a:b]]
                text, at, keys = picked_blocks(split)
                hit = has_mark(block.value, hashes[text + a] ^ at)
                text, at, keys = text[hit], at[hit], keys[hit]
                sides = [x for t in np.unique(text) for x in side_words(word_hashes(split[t]), at[text == t])]
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at),
                     *[pa.array(np.ascontiguousarray(keys[:, i])) for i in (0, 1)], pa.array(sides, pa.binary())],
                    names=[*_PLACES, "sides"])

    return run


# Words on each side of a block: a passage's first picked block starts at most so many words after
# it, and its last one ends at most so many before its end.
SIDES = PASSAGE - BLOCK
SIDE_BYTES = 5  # of a side word's hash: two words that differ are taken as equal once in 2^40
HOT = 50_000
HOT_RANGE = 50_000
ALL = (1 << BLOCK) - 1


def gone_words(runs: list[int], lines: list[int] | None) -> int:
    """The words of a block and its sides that lie in removed lines, as bits. ``runs``: each line's
    number and the word at which it ends."""
    if not lines:
        return 0
    own, out, at = set(lines), 0, 0
    for line, end in zip(runs[::2], runs[1::2]):
        if line in own:
            out |= (1 << end) - (1 << at)
        at = end
    return out


def halves(bits: int) -> tuple[int, int]:
    """(the block's bits, those of its sides) of the bits of a block with its sides."""
    return bits >> SIDES & ALL, bits & ((1 << SIDES) - 1) | bits >> (SIDES + BLOCK) << SIDES


def reach(sides_gone: int) -> tuple[int, int]:
    """How many words before a block and after it, from the nearest on, lie in lines that stay."""
    left = next((k for k in range(SIDES) if sides_gone >> (SIDES - 1 - k) & 1), SIDES)
    return left, next((k for k in range(SIDES) if sides_gone >> (SIDES + k) & 1), SIDES)


def side_bits(left: int, right: int) -> int:
    return ((1 << left) - 1) << (SIDES - left) | ((1 << right) - 1) << SIDES


def prefixes(side: bytes) -> list[bytes]:
    """The first words of one side, one word, two words and so on, up to the text's end."""
    out = []
    for k in range(SIDE_BYTES, len(side) + 1, SIDE_BYTES):
        if not any(side[k - SIDE_BYTES:k]):
            break
        out.append(side[:k])
    return out


class Earlier:
    """The words around the places of one class so far. A place's equal words are found by walking
    along the prefixes that an earlier place has."""

    def __init__(self):
        self.seen: tuple[set[bytes], set[bytes]] = (set(), set())

    def add(self, sides: bytes, sides_gone: int) -> int:
        """The words, as bits, up to which some earlier place is equal in lines that stay."""
        half, found = SIDES * SIDE_BYTES, []
        for side, seen, stay in zip((sides[:half], sides[half:]), self.seen, reach(sides_gone)):
            if side in seen:  # as with whole copies
                found.append(SIDES)
                continue
            own = prefixes(side)
            k = 0
            while k < len(own) and own[k] in seen:
                k += 1
            found.append(k)
            seen.update(own[k:stay])
        return side_bits(*found)


_PLACES = ["id", "th", "start", "k1", "k2"]
_PLACE_TYPES = "id long, th long, start long, k1 long, k2 long"
_ENDS = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("more", pa.int64())])


def _gone(batches):
    for batch in batches:
        runs, lines = batch.column("runs").to_pylist(), batch.column("lines").to_pylist()
        own = [halves(gone_words(r, x)) if x else (0, 0) for r, x in zip(runs, lines)]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(n) for n in _PLACES], pa.array([x for x, _ in own], pa.int64()), pa.array([x for _, x in own], pa.int64())],
            names=[*_PLACES, "gone", "sides_gone"])


def _equal_words(batches):
    """Rows sorted by class and place; a place that counts comes as a row with its sides' lines, then
    one with their words."""
    kind = place = own = earlier = None
    for batch in batches:
        out = []
        for *key, sides_gone, sides in zip(*[batch.column(n).to_pylist() for n in ("k1", "k2", "id", "th", "start", "sides_gone", "sides")]):
            if key[:2] != kind:
                kind, earlier = key[:2], Earlier()
            if sides is None:
                place, own = key, sides_gone
            elif place == key:
                place = None  # a repeated row is the same place
                more = earlier.add(sides, own)
                if more:
                    out.append((*key[2:], more))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 4)], schema=_ENDS)


_HOT = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("side", pa.int32()),
                  ("k", pa.int32()), ("as_first", pa.int32()), ("as_last", pa.int32()), ("prefix", pa.binary())])
_HOT_TYPES = "part int, kind int, id long, th long, start long, side int, k int, as_first int, as_last int, prefix binary"


def _hot_range(batches):
    """One range of the rows (k1, k2, id, th, start, sides_gone, side, words), sorted by class, side,
    words and place. Kind 0: each place with the words ``k`` that it shares with some earlier place
    of the range, and those it shares with the range's first and last row. Kinds 1 and 2: each
    prefix of the first and the last row, and the least place that has it in lines that stay; no
    other prefix goes on in the next ranges."""
    part = TaskContext.get().partitionId()
    table = pa.Table.from_batches(list(batches))
    size = table.num_rows
    if not size:
        return
    k1, k2, side, th, start = (table[c].to_numpy() for c in ("k1", "k2", "side", "th", "start"))
    no_id, ids = table["id"].is_null().to_numpy(), table["id"].fill_null(0).to_numpy()
    words = np.frombuffer(b"".join(table["words"].to_pylist()), np.uint8).reshape(size, SIDES, SIDE_BYTES)
    stay = np.array([reach(x)[s] for x, s in zip(table["sides_gone"].to_pylist(), side.tolist())])
    order = np.lexsort((start, th, ids, no_id))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    new = np.r_[True, (np.diff(k1) != 0) | (np.diff(k2) != 0) | (np.diff(side) != 0)]
    best, as_first, as_last = (np.zeros(size, np.int32) for _ in range(3))
    ends: list[tuple] = []
    there = np.ones(size, bool)
    for k in range(1, SIDES + 1):
        word = words[:, k - 1]
        new[1:] |= (word[1:] != word[:-1]).any(axis=1)
        there &= word.any(axis=1)  # the text goes on so far
        node = np.cumsum(new) - 1
        least = np.minimum.reduceat(np.where(there & (stay >= k), rank, size), np.flatnonzero(new))
        best[there & (least[node] < rank)] = k
        for kind, at, shared in ((1, 0, as_first), (2, size - 1, as_last)):
            if there[at]:
                shared[node == node[at]] = k
                key = np.array([k1[at], k2[at], side[at]], np.int64).tobytes() + words[at, :k].tobytes()
                ends.append((kind, int(order[least[node[at]]]) if least[node[at]] < size else None, int(side[at]), k, key))

    def rows(kind, places, *rest):
        places = pa.array(places, pa.int64())
        own = [pa.array(c, t) for c, t in zip(rest, _HOT.types[5:])]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(places), pa.int32()), pa.array(kind, pa.int32()),
             *[table[c].combine_chunks().take(places) for c in ("id", "th", "start")], *own], schema=_HOT)

    yield rows(np.zeros(size), np.arange(size), side, best, as_first, as_last, [None] * size)
    if ends:
        kind, places, sides, k, keys = zip(*ends)
        yield rows(kind, places, sides, k, *[[None] * len(ends)] * 2, keys)


def _hot_ends(sides: DataFrame, need: DataFrame, rows: int) -> DataFrame:
    """(id, th, start, more) for the places ``need`` of hot classes. Their sides are sorted by words and cut
    into ranges of some HOT_RANGE rows, anywhere, so no task sees a whole class; a prefix that lies
    in several ranges is one of some range's first or last row, and few."""
    none = F.lit(None).cast("long").alias("sides_gone"), F.lit(None).cast("binary").alias("sides")
    whole = need.select(*_PLACES, "sides_gone", none[1]).union(sides.select(*_PLACES, none[0], "sides")).groupBy(*_PLACES).agg(
        F.max("sides_gone").alias("sides_gone"), F.max("sides").alias("sides")).where("sides_gone is not null and sides is not null")
    half = SIDES * SIDE_BYTES
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("side"), F.substring("sides", 1 + n * half, half).alias("words")) for n in (0, 1)]))
    each = materialise(whole.select(*_PLACES, "sides_gone", each.alias("e")).select(*_PLACES, "sides_gone", "e.side", "e.words"), "hot-sides")
    order = ["k1", "k2", "side", "words", F.col("id").isNull(), "id", "th", "start"]
    ranges = each.repartitionByRange(-(-rows // HOT_RANGE), *order).sortWithinPartitions(*order)
    found = materialise(ranges.mapInArrow(_hot_range, _HOT_TYPES), "hot-ranges")
    ends = found.where("kind > 0")
    least = ends.groupBy(F.col("prefix").alias("p")).agg(F.min(F.when(F.col("th").isNotNull(), _place())).alias("f"))
    least = ends.join(least, F.col("prefix") == F.col("p")).select("part", "kind", F.struct("k", "f").alias("e"))
    out = found.where("kind = 0").drop("kind").withColumn("place", _place())
    for kind, limit in ((1, "as_first"), (2, "as_last")):
        own = least.where(F.col("kind") == kind).groupBy(F.col("part").alias("p")).agg(F.collect_list("e").alias("least"))
        out = out.join(F.broadcast(own), F.col("part") == F.col("p"), "left").drop("p")
        out = out.withColumn("k", F.expr(f"greatest(k, coalesce(size(filter(least, e -> e.k <= {limit} AND e.f < place)), 0))")).drop("least")
    out = out.where("k > 0")
    bits = F.expr(f"shiftleft(shiftleft(1L, k) - 1L, if(side = 0, {SIDES} - k, {SIDES}))")
    return out.groupBy("id", "th", "start").agg(F.sum(bits).alias("more"))


def _place():
    return F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("start").alias("start"))


def passage_ends(read: DataFrame, here: DataFrame, hot: int = HOT) -> DataFrame:
    """(id, th, start, more): the places whose passage goes on beyond the block, and the words, as
    bits, of up to SIDES on each side that some earlier place has as well, in lines that stay.

    Only places with words in lines that stay, and of classes with several of them, send their
    sides. Places of a class go through one task in order, which keeps the distinct words around
    them. Classes of over ``hot`` places are sorted by the words of their sides instead, so no task
    sees the whole class."""
    here = here.where(F.col("gone") != F.lit(ALL))
    live = materialise(here.groupBy(F.col("k1").alias("a"), F.col("k2").alias("b")).agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "live-blocks")
    same = (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))
    need = materialise(here.join(live, same).select(*_PLACES, "sides_gone", (F.col("n") > hot).alias("hot")), "live-places")
    block = read.sparkSession.sparkContext.broadcast(marks(need, F.col("th").bitwiseXOR(F.col("start"))))
    live_texts = read.sparkSession.sparkContext.broadcast(marks(need, F.col("th")))
    sides = read.mapInArrow(_marked_sides(block, live_texts), f"{_PLACE_TYPES}, sides binary")
    many = live.where(F.col("n") > hot)
    any_hot = not many.isEmpty()
    few = sides.join(many.drop("n"), same, "left_anti") if any_hot else sides
    rows = need.where("not hot").select(*_PLACES, "sides_gone", F.lit(None).cast("binary").alias("sides")).union(
        few.select(*_PLACES, F.lit(None).cast("long"), "sides"))
    rows = rows.repartition("k1", "k2").sortWithinPartitions("k1", "k2", F.col("id").isNull(), "id", "th", "start", F.col("sides").isNotNull())
    found = rows.mapInArrow(_equal_words, "id long, th long, start long, more long")
    if not any_hot:
        return found
    rows = 2 * many.agg(F.sum("n")).first()[0]
    return found.union(_hot_ends(sides.join(many.drop("n"), same, "left_semi"), need.where("hot"), rows))


def repeated_blocks(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lines_gone: DataFrame | None = None) -> DataFrame:
    """(id, th, start, first_id, stays, words, more): every picked block that occurs again, by its first
    word; the first occurrence stays. ``lines_gone``: (id, th, line) of the lines that paragraphs
    remove. ``words``: as bits, the block's words of which an earlier occurrence lies in a line that
    isn't removed; ``first_id``: the earliest document that holds words, null if none does. With
    ``lines_gone``, a place whose passage goes on has a second row, without words and first_id:
    ``more``, see ``passage_ends``."""
    read = docs.select(col(id_col).cast("long").alias("id"), text_hash(text_col).alias("th"), text_bytes(text_col).alias("t"))
    again = materialise(
        read.select("t").mapInArrow(_block_classes("t"), "k1 long, k2 long").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1").select(F.col("k1").alias("a"), F.col("k2").alias("b")), "blocks")
    block = docs.sparkSession.sparkContext.broadcast(marks(again, F.col("a")))
    lost = None if lines_gone is None else docs.sparkSession.sparkContext.broadcast(marks(lines_gone, F.col("th")))
    here = read.mapInArrow(_marked_blocks(block, lost), f"{_PLACE_TYPES}, runs array<int>")
    here = here.join(again, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b"))).drop("a", "b")
    if lines_gone is None:
        here = here.withColumn("lines", F.lit(None).cast("array<int>"))
    else:
        gone = lines_gone.groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.collect_set("line").alias("lines"))
        here = here.join(gone, (F.col("th") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")), "left").drop("i", "t")
    here = materialise(here.mapInArrow(_gone, f"{_PLACE_TYPES}, gone long, sides_gone long"), "block-places")
    place = _place()
    # the first place for each set of words gone; a place's earlier ones are all covered by these
    first = here.groupBy("k1", "k2", "gone").agg(F.min(place).alias("f"))
    first = materialise(first.groupBy(F.col("k1").alias("a"), F.col("k2").alias("b")).agg(
        F.array_sort(F.collect_list(F.struct("f", "gone"))).alias("firsts")), "firsts")
    earlier = F.filter("firsts", lambda e: e["f"] < F.col("place"))
    words = F.aggregate(F.col("earlier"), F.lit(0).cast("long"), lambda x, e: x.bitwiseOR(F.lit(ALL).bitwiseXOR(e["gone"])))
    joined = here.withColumn("place", place).join(first, (F.col("k1") == F.col("a")) & (F.col("k2") == F.col("b")))
    joined = joined.withColumn("earlier", earlier).withColumn("words", words)
    holds = F.filter("earlier", lambda e: e["gone"] != F.lit(ALL))
    found = joined.select("id", "th", "start", F.get(holds, F.lit(0))["f"]["id"].alias("first_id"), (F.size("earlier") == 0).alias("stays"), "words",
                          F.lit(0).cast("long").alias("more"))
    if lines_gone is None:
        return found
    none = F.lit(None).cast("long"), F.lit(False), F.lit(0).cast("long")
    return found.union(passage_ends(read, here).select("id", "th", "start", *none, "more"))


_WORD = re.compile(r"[^ \t-\r]+")


_CUT = np.r_[0:BLOCK, -SIDES:0, BLOCK:BLOCK + SIDES]


def cut_words(start: np.ndarray, words: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For each word of a text up to the last one cut: whether it is one of the words of blocks and
    their sides, given by the block's first word and bits."""
    out = np.zeros(SIDES + int(start.max(initial=0)) + BLOCK + SIDES, bool)
    for a in range(0, len(start), _PIECE >> 6):
        b = a + (_PIECE >> 6)
        bits = np.concatenate([words[a:b, None] >> np.arange(BLOCK), more[a:b, None] >> np.arange(2 * SIDES)], axis=1) & 1
        out[(start[a:b, None] + SIDES + _CUT)[bits.astype(bool)]] = True
    return out[SIDES:]


def without(text: str, lines: set[int], cut: np.ndarray) -> str:
    """The text without some lines and without the words that ``cut`` marks. A line that this leaves
    no words goes as well."""
    any_cut = cut.any()
    out, word = [], 0
    for n, line in enumerate(text.split("\n")):
        size = len(line.encode().split()) if any_cut else 0
        hit = np.flatnonzero(cut[word:word + size]).tolist()
        word += size
        if n in lines or (hit and len(hit) == size):
            continue
        spans = [m.span() for m in _WORD.finditer(line)] if hit else []
        for k in reversed(hit):  # with the space before the next word
            end = spans[k + 1][0] if k + 1 < len(spans) else spans[k][1]
            line = line[:spans[k][0]] + line[end:]
        out.append(line)
    return "\n".join(out)


def _remove(text: str, gone: str, cuts: str):
    none = pa.array([], pa.struct([(n, pa.int64()) for n in ("start", "words", "more")]))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            texts, lines = (batch.column(names.index(n)).to_pylist() for n in (text, gone))
            out = []
            for t, own, blocks in zip(texts, lines, batch.column(names.index(cuts))):
                blocks = none if blocks.values is None else blocks.values
                if t is not None and (own or len(blocks)):
                    values = dict(zip((f.name for f in blocks.type), blocks.flatten()))
                    t = without(t, set(own or ()), cut_words(*[values[n].to_numpy() for n in ("start", "words", "more")]))
                out.append(t)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if n == text else batch.column(k) for k, n in enumerate(names)], names=names)

    return run


def _marked_rows(block, key: str, wanted: bool):
    def run(batches):
        for batch in batches:
            yield marked_rows(batch, block.value, batch.schema.names.index(key), wanted)

    return run


def _marked_keys(block):
    """(key, c) of the band columns whose keys are marked."""

    def run(batches):
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            for k in range(1, batch.num_columns):
                key = batch.column(k).to_numpy(zero_copy_only=False)
                hit = has_mark(block.value, key)
                yield pa.RecordBatch.from_arrays([pa.array(key[hit]), pa.array(c[hit])], names=["key", "c"])

    return run


def repeated_paragraphs(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY,
                        min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, line, cluster, first_id, first_line, stays): every paragraph that is repeated, its
    cluster, and the cluster's first occurrence. th: hash of the whole text."""
    spark = docs.sparkSession
    read = docs.select(col(id_col).cast("long").alias("id"), text_hash(text_col).alias("th"), text_bytes(text_col).alias("t"))
    bands = ", ".join(f"b{i} long" for i in range(BANDS))
    found = materialise(read.mapInArrow(_scan(min_words), f"id long, th long, line int, class binary, {bands}"), "paragraphs")
    classes = materialise(
        found.groupBy("class").agg(F.count(F.lit(1)).alias("copies"), F.min("th").alias("th"), *[F.first(f"b{i}").alias(f"b{i}") for i in range(BANDS)])
        .withColumn("c", F.monotonically_increasing_id()), "classes")
    band = [f"b{i}" for i in range(BANDS)]
    shared = materialise(classes.select(F.explode(F.array(*band)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
                         .where("n > 1").select("k"), "shared-keys")
    block = spark.sparkContext.broadcast(marks(shared, F.col("k")))
    sent = classes.select("c", *band).mapInArrow(_marked_keys(block), "key long, c long")
    members = materialise(sent.join(shared, F.col("key") == F.col("k")).select("key", "c"), "members")
    asked = materialise(members.select("c").distinct().withColumnRenamed("c", "m").join(
        classes.select("c", "class", "th"), F.col("c") == F.col("m")).select("c", "class", "th"), "asked")
    first8 = F.conv(F.hex(F.substring("class", 1, 8)), 16, -10).cast("long")
    block = spark.sparkContext.broadcast(marks(asked, first8))
    texts = spark.sparkContext.broadcast(marks(asked, F.col("th")))  # one text of each class is enough
    sets = read.select("th", "t").mapInArrow(_shingle_sets(block, texts, min_words), "class binary, shingles array<long>, bits binary")
    sets = sets.withColumnRenamed("class", "k").join(asked, F.col("k") == F.col("class")).select("c", "shingles", "bits")
    sets = materialise(sets.dropDuplicates(["c"]), "shingles")
    roots = similar_classes(members, sets, similarity)
    clustered = classes.select("class", "c", "copies").join(roots, F.col("c") == F.col("vertex"), "left")
    clustered = clustered.where("copies > 1 or root is not null").select(
        F.col("class").alias("k"), F.coalesce("root", "c").alias("cluster"))
    here = materialise(found.select("id", "th", "line", "class").join(clustered, F.col("class") == F.col("k"))
                       .select("id", "th", "line", "cluster"), "occurrences")
    place = F.struct(F.col("id").isNull().alias("a"), F.col("id").alias("id"), F.col("th").alias("th"), F.col("line").alias("line"))
    # a table of its own: the join may then split a cluster that holds much of the corpus
    first = materialise(here.groupBy(F.col("cluster").alias("k")).agg(F.min(place).alias("f")), "firsts")
    return here.join(first, F.col("cluster") == F.col("k")).select(
        "id", "th", "line", "cluster", F.col("f.id").alias("first_id"), F.col("f.line").alias("first_line"), (place == F.col("f")).alias("stays"))


def remove_repeats(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY,
                   min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """``docs`` with repeated paragraphs and blocks taken out, and the columns ``removed`` (line
    numbers, from 0), ``cut`` (first words, from 0, of the blocks that occur before; of these, the
    words that stay at an earlier place are taken out) and ``kept_in`` (ids of the documents that
    hold the copies that stay). ``whole``: blocks are cut as far as their words stay at an earlier
    place after the paragraphs' removal, and up to the ends of the equal passages; without it, by
    the first place in the texts as they came, and alone."""
    spark = docs.sparkSession
    lines_gone = materialise(repeated_paragraphs(docs, text_col, id_col, similarity, min_words).where("not stays")
                             .select("id", "th", "line", "first_id"), "lines-removed")
    blocks_gone = repeated_blocks(docs, text_col, id_col, lines_gone if whole else None).where("not stays")
    none = F.lit(None).cast("struct<start:bigint,words:bigint,more:bigint>")
    gone = lines_gone.select("id", "th", "line", none.alias("cut"), "first_id").union(
        blocks_gone.select("id", "th", F.lit(None).cast("int"), F.struct("start", "words", "more"), "first_id"))
    lists = materialise(gone.groupBy("id", "th").agg(
        F.array_sort(F.collect_set("line")).alias("lines"), F.array_sort(F.collect_set("cut")).alias("cuts"),
        F.array_sort(F.collect_set("first_id")).alias("ids")), "removed")
    block = spark.sparkContext.broadcast(marks(lists, F.col("th")))
    names = {"removed": "array<int>", "cut": "array<long>", "kept_in": "array<long>"}
    th, *lists_as = fresh(docs, "__th", "__lines", "__cuts", "__ids")
    keep = [col(c) for c in docs.columns if c.lower() not in names]
    hashed = docs.select(*keep, text_hash(text_col).alias(th))
    own = lists.select(F.col("id").alias("__i"), F.col("th").alias("__t"), *[F.col(c).alias(n) for c, n in zip(("lines", "cuts", "ids"), lists_as)])
    some = map_arrow(hashed, _marked_rows(block, th, True)).join(
        own, (col(th) == F.col("__t")) & col(id_col).cast("long").eqNullSafe(F.col("__i")), "left").drop("__i", "__t")
    changed = map_arrow(some, _remove(text_col, lists_as[0], lists_as[1])).select(
        *keep, *[F.coalesce(F.array_distinct(col(c)["start"]) if n == "cut" else col(c), F.array().cast(kind)).alias(n) for c, (n, kind) in zip(lists_as, names.items())])
    rest = map_arrow(hashed, _marked_rows(block, th, False)).select(*keep, *[F.array().cast(kind).alias(n) for n, kind in names.items()])
    return changed.union(rest)
