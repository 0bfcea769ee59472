"""Source divergence audit by single-pass in-memory indexing.

How far do the sources of a language use its words unlike one another? The index of term
frequencies is built in one pass over the texts:

1. *Blocks.* A task reads its documents once and keeps a dictionary for each (language, source):
   a term's occurrences and documents. When the dictionaries hold ``block_entries`` postings, they
   are cut into hash shards and sorted by (language, term), and leave as a run: chunks of at most
   ``CHUNK`` terms go to the shuffle, which holds them on disk. Then the next block begins. So a
   term that a third of all words consist of is one posting a source and block.
2. *Merge.* A shard's chunks arrive in order of their first term and are merged by ranges: when
   ``WINDOW`` entries are open, all terms below the next chunk's first one are complete. A run's chunk
   is opened only when the merge has come to its first term. Terms in enough documents of the language leave as frequencies by source.
3. *Pair corrections.* With smoothed frequencies p, most terms are absent from most sources, where
   p is the source's floor b. The sum over all kept terms for two sources is therefore V times the
   value of the two floors, plus, for each source, a correction by the histogram of its
   frequencies against the other's floor, plus corrections for the terms that both have. The
   last are streamed over the postings in order of terms: a task adds them up by pair, and hands the
   sums on when it holds ``PAIRS`` of them. No posting meets a source that lacks its term.

All arithmetic is in whole numbers. p = 1 + floor(10^9 (count + 2) / (N + 2 V)); the value of two
frequencies is floor((p - q)^2 / (p + q)).

Defined cases: null text, language and source are empty strings; groups whose documents have no
kept term have frequencies 1 + floor(10^9 / V), and value 0 throughout where the language has no kept
term; a long text is cut into pieces of 1 MiB before white space or marks (a task holds its
distinct terms); repeated rows count as often as they occur; ties go to the smaller item in UTF-8
order; extra columns are ignored; an empty table has no rows. Sums stay below 2^63 for fewer than
9 * 10^15 words of a language.
"""

from __future__ import annotations

import bisect
import itertools
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from costsieve.llm.common import col, materialise, text_bytes

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
BLOCK_ENTRIES = 400_000
CHUNK = 1024
WINDOW = 65_536
PIECE = 1 << 20
PAIRS = 1 << 20
# a byte of a term lower-cased, all others blank: ASCII letters and everything from \x80 on
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))

_RUNS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())),
                   ("docs", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("sources", pa.list_(pa.string())),
                   ("of", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])
_RUNS_DDL = ("shard int, lang string, first binary, terms array<binary>, docs array<long>, sizes array<int>, "
             "sources array<string>, of array<int>, counts array<long>")
_FREQUENCIES_DDL = "lang string, term string, source string, count long, total long, head int"


# ------------------------------------------------------------------ blocks and runs
class Block:
    """Postings of the documents read since the last run: (lang, source) -> term -> counts."""

    def __init__(self):
        self.counts: dict[tuple[str, str], Counter] = {}
        self.docs: dict[tuple[str, str], Counter] = {}
        self.entries = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        counts = self.counts.setdefault((lang, source), Counter())
        docs = self.docs.setdefault((lang, source), Counter())
        before, seen, start = len(counts), {}, 0
        while start < len(text):
            end = min(start + PIECE, len(text))
            while end < len(text) and TERM_BYTES[text[end]] != 32:  # a piece ends behind a term
                end += 1
            terms = text[start:end].translate(TERM_BYTES).split()
            counts.update(terms)
            seen.update(dict.fromkeys(terms))
            start = end
        docs.update(seen.keys())  # in the same order as in ``counts``
        self.entries += len(counts) - before

    def run(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The block's postings by hash shard and term, a row for each chunk of at most CHUNK terms."""
        by_lang: dict[str, list[str]] = {}
        for lang, source in self.counts:
            by_lang.setdefault(lang, []).append(source)
        for lang, sources in by_lang.items():
            if any(self.counts[lang, s] for s in sources):
                yield self._lang_run(lang, sources, shards)

    def _lang_run(self, lang: str, sources: list[str], shards: int) -> pa.RecordBatch:
        tables = [self.counts[lang, s] for s in sources]
        keys = pa.array([t for table in tables for t in table], pa.binary()).dictionary_encode()
        terms = keys.dictionary
        seed, by_term = zlib.crc32(lang.encode()), pc.array_sort_indices(terms).to_numpy()
        shard = np.array([zlib.crc32(t, seed) % shards for t in terms.to_numpy(zero_copy_only=False)], np.int64)[by_term]
        place = np.argsort(shard, kind="stable")  # by shard, then by term
        shard, by_term = shard[place], by_term[place]
        number = np.empty(len(terms), np.int64)
        number[by_term] = np.arange(len(terms))
        terms, term = terms.take(pa.array(by_term)), number[keys.indices.to_numpy()]
        code = np.repeat(np.arange(len(tables), dtype=np.int32), [len(t) for t in tables])
        count = np.array([n for table in tables for n in table.values()], np.int64)
        of_docs = np.array([n for s in sources for n in self.docs[lang, s].values()], np.int64)
        docs = np.bincount(term, of_docs, len(terms)).astype(np.int64)
        order = np.argsort(term, kind="stable")
        code, count, sizes = code[order], count[order], np.bincount(term, minlength=len(terms))
        # chunks: the terms of one shard, CHUNK at a time; a term's postings stay together
        starts = np.flatnonzero(np.r_[True, np.diff(shard) != 0])
        within = np.arange(len(terms)) - np.repeat(starts, np.diff(np.r_[starts, len(terms)]))
        cuts = np.r_[np.flatnonzero(within % CHUNK == 0), len(terms)]
        posts = np.r_[0, np.cumsum(sizes)][cuts]
        names = []
        for a, b in zip(posts, posts[1:]):  # only its own sources travel with a chunk
            used, code[a:b] = np.unique(code[a:b], return_inverse=True)
            names.append([sources[k] for k in used])

        def lists(offsets, values, kind):
            return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values if isinstance(values, pa.Array) else pa.array(values, kind))

        return pa.RecordBatch.from_arrays(
            [pa.array(shard[cuts[:-1]], pa.int32()), pa.array([lang] * len(names)), terms.take(pa.array(cuts[:-1])),
             lists(cuts, terms, pa.binary()), lists(cuts, docs, pa.int64()), lists(cuts, sizes, pa.int32()),
             pa.array(names, pa.list_(pa.string())), lists(posts, code, pa.int32()), lists(posts, count, pa.int64())], schema=_RUNS)


def runs(docs: DataFrame, lang: Column, source: Column, text_col: str, shards: int, block_entries: int) -> DataFrame:
    def run(batches):
        block = Block()
        for batch in batches:
            langs, sources, texts = batch.columns
            for a, b, t in zip(langs.to_pylist(), sources.to_pylist(), texts):
                block.add(a, b, t.as_buffer().to_pybytes())
                if block.entries >= block_entries:  # memory is full: the block leaves as a run
                    yield from block.run(shards)
                    block = Block()
        yield from block.run(shards)

    return docs.select(lang.alias("lang"), source.alias("source"), text_bytes(text_col).alias("text")).mapInArrow(run, _RUNS_DDL)


# ------------------------------------------------------------------ the merge
def merged(chunks: Iterator[dict], min_docs: int = 1) -> Iterator[tuple[bytes, int, list[tuple]]]:
    """Merge of the runs of one shard and language: (term, documents, places) in order of terms, of
    the terms in at least ``min_docs`` documents.

    ``chunks`` come by first term. They are merged by ranges of terms: when ``WINDOW`` entries are
    open, all terms below the next chunk's first one are complete and leave. A place is (chunk,
    start, end) of the term's postings; ``counts_of`` adds them up.
    """
    def until(limit):
        parts, rest = [], []
        for chunk, k in window:
            end = len(chunk["terms"]) if limit is None else bisect.bisect_left(chunk["terms"], limit, k)
            if k < end:
                parts.append((chunk, k, end))
            if end < len(chunk["terms"]):
                rest.append((chunk, end))
        window[:] = rest
        documents: dict[bytes, int] = {}
        get = documents.get
        for chunk, k, end in parts:
            for term, n in zip(chunk["terms"][k:end], chunk["docs"][k:end]):
                documents[term] = get(term, 0) + n
        kept: dict[bytes, list[tuple]] = {t: [] for t in sorted([t for t, n in documents.items() if n >= min_docs])}
        for chunk, k, end in parts:
            at = chunk["ends"]
            for i, term in enumerate(chunk["terms"][k:end], k):
                if term in kept:
                    kept[term].append((chunk, at[i - 1] if i else 0, at[i]))
        for term, places in kept.items():
            yield term, documents[term], places

    window: list[tuple] = []  # (chunk, its number of terms that have left)
    entries, full = 0, WINDOW
    for chunk in chunks:
        if entries >= full:
            yield from until(chunk["first"])
            entries = sum(len(c["terms"]) - k for c, k in window)
            full = max(WINDOW, 2 * entries)
        chunk["ends"] = list(itertools.accumulate(chunk["sizes"]))
        window.append((chunk, 0))
        entries += len(chunk["terms"])
    yield from until(None)


def counts_of(places: list[tuple]) -> dict[str, int]:
    counts: dict[str, int] = {}
    for chunk, start, end in places:
        names, of, n = chunk["sources"], chunk["of"], chunk["counts"]
        for i in range(start, end):
            name = names[of[i]]
            counts[name] = counts.get(name, 0) + n[i]
    return counts


def frequencies(run_table: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(lang, term, source, count, total, head) of the terms in at least ``min_docs`` documents of
    their language; ``head`` is 1 on one row of each term, else 0."""
    arrow = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()),
                       ("count", pa.int64()), ("total", pa.int64()), ("head", pa.int32())])

    def chunks_of(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):  # one chunk in Python at a time
                yield {c: x[i].as_py() if i_plain else x[i].values.to_numpy(zero_copy_only=False).tolist() for c, x, i_plain in
                       zip(names, batch.columns, (c in ("shard", "lang", "first") for c in names))}

    def run(batches):
        out: list[list] = [[] for _ in arrow]

        def table():
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(out, arrow)], schema=arrow)

        for (_, lang), chunks in itertools.groupby(chunks_of(batches), key=lambda c: (c["shard"], c["lang"])):
            for term, _, places in merged(chunks, min_docs):
                counts, word = counts_of(places), term.decode("utf-8", "replace")
                total, size = sum(counts.values()), len(counts)
                for c, x in zip(out, ([lang] * size, [word] * size, counts, counts.values(), [total] * size, [1] + [0] * (size - 1))):
                    c += x
                if len(out[0]) >= 20_000:
                    yield table()
                    for c in out:
                        c.clear()
        if out[0]:
            yield table()

    dealt = run_table.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("lang").cast("binary"), "first")
    return dealt.mapInArrow(run, _FREQUENCIES_DDL)


# ------------------------------------------------------------------ values
def smoothed(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (N + 2 V)), exact; null where the language has no terms."""
    wide = "decimal(38,0)"
    return F.when(v > 0, F.call_function("div", (count.cast(wide) + 2) * F.lit(SCALE).cast("decimal(10,0)"), (n + 2 * v).cast(wide)) + 1)


def value_of(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_corrections(batches):
    """Sums of f(p,q) - f(p,b) - f(a,q) + f(a,b) by pair, over rows (lang, term, source, p, floor) in order of terms."""
    schema = pa.schema([("lang", pa.string()), ("one", pa.string()), ("two", pa.string()), ("correction", pa.int64())])
    codes: dict[tuple[str, str], int] = {}
    names: list[tuple[str, str]] = []
    sums: dict[int, int] = {}
    kept = None  # rows of a term that may go on in the next batch

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    def flush():
        pairs = list(sums.items())
        sums.clear()
        left, right = [names[k >> 32] for k, _ in pairs], [names[k & 0xFFFFFFFF] for k, _ in pairs]
        return pa.RecordBatch.from_arrays(
            [pa.array([a[0] for a in left], pa.string()), pa.array([min(a[1], b[1], key=str.encode) for a, b in zip(left, right)], pa.string()),
             pa.array([max(a[1], b[1], key=str.encode) for a, b in zip(left, right)], pa.string()), pa.array([n for _, n in pairs], pa.int64())], schema=schema)

    def add(table, ends):
        """``ends``: for each row, the end of its term's rows."""
        code, p, low = table
        partners = ends - np.arange(len(p)) - 1  # a row meets the later rows of its term
        start = 0
        while start < len(p):
            stop = start + max(1, int(np.searchsorted(np.cumsum(partners[start:]), PAIRS)))
            n = partners[start:stop]
            i = np.repeat(np.arange(start, min(stop, len(p))), n)
            if len(i):
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
                c = f(p[i], p[j]) - f(p[i], low[j]) - f(low[i], p[j]) + f(low[i], low[j])
                key = np.minimum(code[i], code[j]) << 32 | np.maximum(code[i], code[j])
                order = np.argsort(key, kind="stable")
                at = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
                for k, x in zip(key[order][at].tolist(), np.add.reduceat(c[order], at).tolist()):
                    sums[k] = sums.get(k, 0) + x
            start = stop

    def parts(batch, last):
        nonlocal kept
        t = pa.Table.from_batches([batch]) if batch is not None else None
        if kept is not None:
            t = pa.concat_tables([kept, t]) if t is not None else kept
        kept = None
        if t is None or not t.num_rows:
            return
        t = t.combine_chunks()
        lang, term = t.column("lang").to_pylist(), t.column("term").to_pylist()
        change = np.array([k for k in range(1, len(term)) if term[k] != term[k - 1] or lang[k] != lang[k - 1]], np.int64)
        bounds = np.r_[0, change, len(term)]
        if not last:
            kept = t.slice(int(bounds[-2]))
            bounds = bounds[:-1]
        n = int(bounds[-1])
        code = np.empty(n, np.int64)
        for k, group in enumerate(zip(lang[:n], t.column("source").to_pylist()[:n])):
            if group not in codes:
                codes[group] = len(names)
                names.append(group)
            code[k] = codes[group]
        p, low = (t.column(c).to_numpy()[:n].astype(np.int64) for c in ("p", "low"))
        add((code, p, low), np.repeat(bounds[1:], np.diff(bounds)))

    for batch in batches:
        parts(batch, False)
        if len(sums) >= PAIRS:
            yield flush()
    parts(None, True)
    if sums:
        yield flush()


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", *,
          min_docs: int = MIN_DOCS, top: int = TOP, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` compares each source with all others of
    its language, part ``term`` gives the terms that it uses most above the language."""
    lang, source = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = materialise(frequencies(runs(docs, lang, source, text_col, shards, block_entries), shards, min_docs), "frequencies")

    groups = docs.select(lang.alias("lang"), source.alias("source")).distinct()
    by_source = index.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    by_lang = index.groupBy("lang").agg(F.sum("count").alias("n_lang"), F.sum("head").alias("v"))
    n, v = (F.coalesce(c, F.lit(0)) for c in ("n", "v"))
    sizes = groups.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").select(
        "lang", "source", n.alias("n"), v.alias("v"), F.coalesce("n_lang", F.lit(0)).alias("n_lang"))
    sizes = materialise(sizes.withColumn("low", smoothed(F.lit(0), F.col("n"), F.col("v"))), "sizes")

    postings = materialise(index.join(sizes, ["lang", "source"]).select(
        "lang", "term", "source", "low", smoothed(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        smoothed(F.col("total"), F.col("n_lang"), F.col("v")).alias("q")), "postings")
    return _pairs(sizes, postings).unionByName(_terms(postings, top))


def _pairs(sizes: DataFrame, postings: DataFrame) -> DataFrame:
    a, b = sizes.select("lang", "v", F.col("source").alias("one"), F.col("low").alias("low1")), \
        sizes.select("lang", F.col("source").alias("two"), F.col("low").alias("low2"))
    pairs = a.join(b, "lang").where("one <> two")  # these are the rows that the result has
    histogram = postings.groupBy("lang", F.col("source").alias("one"), "p").agg(F.count(F.lit(1)).alias("terms"))
    alone = pairs.join(histogram, ["lang", "one"]).groupBy("lang", "one", "two").agg(
        F.sum(F.col("terms") * (value_of(F.col("p"), F.col("low2")) - value_of(F.col("low1"), F.col("low2")))).alias("correction"))
    both = postings.select("lang", "term", "source", "p", "low").repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(
        _pair_corrections, "lang string, one string, two string, correction long")
    low, high = F.least("one", "two").alias("one"), F.greatest("one", "two").alias("two")
    sums = alone.select("lang", low, high, "correction").unionByName(both).groupBy("lang", "one", "two").agg(
        F.sum("correction").alias("correction"))
    floors = pairs.where("one < two").select("lang", "one", "two", F.coalesce(
        F.col("v") * value_of(F.col("low1"), F.col("low2")), F.lit(0)).alias("floor"))
    found = floors.join(sums, ["lang", "one", "two"], "left").withColumn("value", F.col("floor") + F.coalesce("correction", F.lit(0)))
    ways = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                             F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    both_ways = found.select("lang", "value", ways.alias("way")).select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value")
    return both_ways.withColumn("rank", F.row_number().over(_order()))


def _order():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def _terms(postings: DataFrame, top: int) -> DataFrame:
    """The best terms of each source; every task keeps its own best before the shuffle."""
    above = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                           value_of(F.col("p"), F.col("q")).alias("value"))
    return above.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)
