"""Filter interaction audit by count-weighted decision diagrams.

A document fails a set of filters: its failure mask. All that an audit of filter orders asks for
depends only on how many documents of a part have each mask, so the corpus is read once, copies
are found over a narrow table of digests, and each part's masks are summed before anything is
gathered: at most 2^n masks a part for n filters.

A part's masks make an ordered decision diagram: one level for each filter, a node's low child
holds the documents that pass it and its high child those that fail, equal nodes are one, and each
node carries the sums of its documents (count and any further weights). Two neighbouring levels
are swapped in place, which touches the nodes of these two only. All orders of the filters follow
one from the other by such swaps (plain changes). In each order the all-pass path gives the steps: the
low child's sum is kept, the high child's removed. A filter's removals as the first step are all
of its failures, as the last one those that fail nothing else.

Filters are columns of booleans (``audit``). ``text_audit`` applies five to texts: four look at the
text alone (``text_failures``), the fifth needs the whole table (``copies``).

Defined cases: a null text is an empty one; a null filter value counts as passed; a null part is
the empty string; rows with a null id are never copies and no row is a copy of them; of rows with
one text, those of the smallest id, repeated or not, are no copies; long texts are read in pieces
of 1 MiB (a task holds their distinct words); labels of a repeated id count if any of them is 1;
extra columns are carried or ignored; an empty table has no parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, materialise, text_bytes

# ---- fixed values: the five filters' letters and limits ----
LETTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_UPPER_PERCENT = 2
MARKS = b"#$%&*|"
# ---- end of fixed values ----

PIECE = 1 << 20
MOST_FILTERS = 7
_SPACE = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_CONTINUED = bytes(range(0x80, 0xC0))


# ------------------------------------------------------------------ the diagram
class Diagram:
    """A quasi-reduced decision diagram over ``n`` variables with weight sums in every node.

    A node is [low, high, sums], a leaf [None, None, sums]; equal nodes of a level are one.
    ``order`` lists the variables from the top, ``levels`` their nodes, the leaves last.
    """

    def __init__(self, n: int, weights: dict[int, tuple[int, ...]], width: int):
        self.order = list(range(n))
        leaves: dict[tuple, list] = {}
        layer = [leaves.setdefault(w, [None, None, w]) for w in (tuple(weights.get(mask, (0,) * width)) for mask in range(1 << n))]
        self.levels = [list(leaves.values())]
        while len(layer) > 1:  # a mask's highest bit is the lowest level, so bit 0 ends on top
            half, made = len(layer) // 2, {}
            layer = [_node(made, layer[i], layer[i + half]) for i in range(half)]
            self.levels.insert(0, list(made.values()))

    def swap(self, level: int) -> None:
        """Exchange the variables of ``level`` and the next one, in place: nodes above and below stay."""
        made: dict[tuple[int, int], list] = {}
        for node in self.levels[level]:
            low, high, _ = node
            node[:2] = _node(made, low[0], high[0]), _node(made, low[1], high[1])
        self.levels[level + 1] = list(made.values())
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def path(self) -> list[tuple[int, tuple, tuple]]:
        """(variable, sums that pass, sums that fail) down the all-pass path."""
        out, (node,) = [], self.levels[0]
        for variable in self.order:
            low, high, _ = node
            out.append((variable, low[2], high[2]))
            node = low
        return out


def _node(made: dict, low: list, high: list) -> list:
    """The one node of a level with these children."""
    key = (id(low), id(high))
    if key not in made:
        made[key] = [low, high, tuple(a + b for a, b in zip(low[2], high[2]))]
    return made[key]


def plain_changes(n: int) -> Iterator[int]:
    """The levels to swap, one after the other, that lead through all n! orders."""
    if n < 2:
        return
    inner = list(plain_changes(n - 1))
    down = True
    for k in range(len(inner) + 1):
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if k < len(inner):  # the moving variable stands on top after going down, else at the bottom
            yield inner[k] + (1 if down else 0)
        down = not down


def order_steps(n: int, weights: dict[int, tuple[int, ...]], width: int) -> dict[tuple[int, ...], list]:
    """The all-pass path of each order of the variables."""
    diagram = Diagram(n, weights, width)
    found = {tuple(diagram.order): diagram.path()}
    for level in plain_changes(n):
        diagram.swap(level)
        found[tuple(diagram.order)] = diagram.path()
    return found


def _part_rows(letters: str, weights: dict[int, tuple[int, ...]], width: int) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique fails, further removed sums..., Shapley)."""
    n = len(letters)
    steps = order_steps(n, weights, width)
    fails, unique, total = [0] * n, [0] * n, [0] * n
    for path in steps.values():
        fails[path[0][0]] = path[0][2][0]
        unique[path[-1][0]] = path[-1][2][0]
        for variable, _, removed in path:
            total[variable] += removed[0]
    for order in sorted(steps):
        name = "".join(letters[v] for v in order)
        for k, (v, kept, removed) in enumerate(steps[order], 1):
            yield name, k, kept[0], removed[0], fails[v] - removed[0], unique[v], *removed[1:], total[v]


def audit(df: DataFrame, part: Column, filters: dict[str, Column], weights: dict[str, Column] | None = None) -> DataFrame:
    """One row for each part, order of the filters and step.

    ``filters``: one letter each -> true where a row fails it. ``weights``: further names -> whole
    numbers (0 or 1 for flags), summed over the rows that a step removes. Columns: part,
    filter_order, step, kept, removed, redundant, unique_fails, the weights' names, shapley.
    """
    letters, weights = "".join(sorted(filters)), weights or {}
    if not filters or len(filters) > MOST_FILTERS or any(len(x) != 1 for x in filters):
        raise ValueError(f"between 1 and {MOST_FILTERS} filters with one letter each")
    mask = sum(F.when(filters[x], F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(letters))
    names = [f"w{i}" for i in range(len(weights))]
    rows = df.select(F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
                     *[F.coalesce(w.cast("long"), F.lit(0)).alias(k) for k, w in zip(names, weights.values())])
    sums = rows.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *[F.sum(k).alias(k) for k in names])
    masks = sums.groupBy("part").agg(F.collect_list(F.struct("mask", "n", *names)).alias("masks"))
    counts = ["kept", "removed", "redundant", "unique_fails", *weights, "shapley"]
    schema = "part string, filter_order string, step int, " + ", ".join(f"`{c}` long" for c in counts)
    arrow = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in counts]])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                of_mask = {m["mask"]: (m["n"], *[m[k] for k in names]) for m in row["masks"]}
                made = list(zip(*_part_rows(letters, of_mask, 1 + len(names))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t.type) for x, t in zip([[row["part"]] * len(made[0]), *made], arrow)], schema=arrow)

    return masks.mapInArrow(run, schema)


# ------------------------------------------------------------------ the filters
def text_failures(data: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D. Its words are counted piece by piece."""
    n_words, distinct, start = 0, set(), 0
    while start < len(data):
        end = min(start + PIECE, len(data))
        while end < len(data) and data[end] not in _SPACE:  # a piece ends before white space
            end += 1
        words = data[start:end].split()
        n_words += len(words)
        distinct.update(words)
        start = end
    upper = len(data) - len(data.translate(None, _UPPER))
    points = len(data.translate(None, _CONTINUED))
    return ((n_words < MIN_WORDS)
            | (100 * len(distinct) < MIN_DISTINCT_PERCENT * n_words) << 1
            | (100 * upper > MAX_UPPER_PERCENT * points) << 2
            | (len(data) != len(data.translate(None, MARKS))) << 3)


def _facts(batches):
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        fails, digests = np.empty(len(texts), np.int32), []
        for i, t in enumerate(texts):
            data = t.as_buffer().to_pybytes()
            fails[i] = text_failures(data)
            digests.append(hashlib.sha256(data).digest())
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(fails), pa.array(digests, pa.binary())],
            names=[*batch.schema.names[:-1], "fails", "digest"])


def copies(facts: DataFrame, id_col: str = "id", digest_col: str = "digest") -> DataFrame:
    """``facts`` with the column ``copy``: true where a smaller id has the same digest.

    Least ids are a hash aggregate; only digests of several rows come back, as a written table,
    so the join's hot partitions can be split.
    """
    least = facts.where(col(id_col).isNotNull()).groupBy(digest_col).agg(
        F.min(col(id_col)).alias("least"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(least.where("n > 1").select(digest_col, "least"), "least")
    return facts.join(repeated, digest_col, "left").withColumn(
        "copy", F.coalesce(col(id_col) > F.col("least"), F.lit(False))).drop("least")


def text_audit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", part_col: str = "source") -> DataFrame:
    """The audit of the five text filters A to E in all orders, with the labelled documents that
    each step loses (``good_lost``: quality 1, ``toxic_lost``: toxic 1)."""
    # only the columns in use reach Python, under names of their own
    narrow = docs.select(col(id_col).alias("id"), F.coalesce(col(part_col).cast("string"), F.lit("")).alias("part"), text_bytes(text_col).alias("text"))
    plain = {f.name: f.dataType.simpleString() for f in narrow.schema}
    facts = materialise(narrow.mapInArrow(
        _facts, f"id {plain['id']}, part string, fails int, digest binary"), "facts")
    marks = labels.where(col(id_col).isNotNull()).groupBy(col(id_col).alias("label_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    marked = copies(facts).join(marks.where("good + toxic > 0"), F.col("id") == F.col("label_id"), "left")
    filters = {x: F.col("fails").bitwiseAND(F.lit(1 << i)) != 0 for i, x in enumerate(LETTERS[:4])}
    return audit(marked, F.col("part"), {**filters, LETTERS[4]: F.col("copy")},
                 {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
