"""Byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

*Encoding.* A text is split by the tokenizer's pattern; the transducer reads each piece byte by byte.
Byte pair encoding (always merge the leftmost pair of lowest rank) has a local description: tokens
are the encoding of their bytes if and only if every two neighbours are the encoding of theirs.
So of all splits of a piece's first bytes exactly one is made of tokens whose neighbours agree, and
the ways to go on from here are: after which of these splits the token that is being read began.
Such a set of ways is a state: each way has the tokens that it holds back and a node of the
vocabulary's trie. A byte moves every way along the trie; a way that completes a token that
agrees with the one before it begins the next. What all ways have in common is emitted, so the
lookahead is what they differ in, a few tokens. States are numbered and their moves kept as they are
first needed; when ``STATES`` are known, the table starts anew. At a piece's end, the way that has
just completed a token gives the rest.

The description holds where each token is its own encoding by merges of rising rank, which ``unreachable``
checks once for the whole vocabulary. Tokens that no merges reach are only taken for a piece that
equals one, as the tiktoken library does; other vocabularies that break it are refused.

*Decoding.* A machine reads token by token and holds a state of an incremental UTF-8 automaton
(the bytes of an unfinished character); each move gives the characters that are complete, with U+FFFD
for bytes that can't be part of one. Moves are kept by (state, token).

Ids are kept as binary, little-endian unsigned 32-bit integers, as token files have them.

Defined cases: a null text is an empty one, without ids; bytes that aren't UTF-8 count as U+FFFD; a
text of any length is read piece by piece, a piece of any length byte by byte; null ids decode to
an empty text, ids that the vocabulary lacks and cut ids are errors; extra columns are carried
along; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
import functools
import itertools
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, map_arrow, text_bytes

STATES = 300_000
PIECES = 100_000
LONGEST_KEPT_PIECE = 32
END = 1 << 32
AGREE = 200_000
NONE = 0xFFFFFFFF
ROWS = 512
LONG = 1 << 20
BLOCK = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank (the id), from a file of lines ``base64 rank``."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


# ------------------------------------------------------------------ the merges themselves
def merge_steps(parts: list[bytes], ranks: dict[bytes, int]) -> Iterator[tuple[int, int]]:
    """Merge ``parts`` in place, (rank, place) after each merge."""
    while True:
        rank, at = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=(-1, -1))
        if at < 0:
            return
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
        yield rank, at


@functools.lru_cache(1)
def unreachable(tokens: frozenset) -> frozenset:
    """The tokens that their own bytes don't merge to. Raises where the local description fails."""
    ranks = dict(tokens)
    if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
        raise ValueError(f"the vocabulary lacks {len(lacking)} single bytes")
    out = set()
    for token in ranks:
        parts = [token[i:i + 1] for i in range(len(token))]
        done = [rank for rank, _ in merge_steps(parts, ranks)]
        if done != sorted(done):
            raise ValueError(f"the merges of {token!r} don't rise in rank")
        if len(parts) > 1:
            out.add(token)
    return frozenset(out)


# ------------------------------------------------------------------ the transducer
class Transducer:
    """Encoder of single pieces. ``moves``: 256 * state + byte -> next state, or (next state, emitted ids)."""

    def __init__(self, ranks: dict[bytes, int], lonely: frozenset, states: int = STATES):
        self.ranks, self.most = ranks, states
        self.whole = {t: (ranks[t],) for t in lonely}
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: dict[int, int] = {}
        for token, rank in ranks.items():
            if token not in lonely:
                node = 0
                for b in token:
                    if b not in self.trie[node]:
                        self.trie[node][b] = len(self.trie)
                        self.trie.append({})
                    node = self.trie[node][b]
                self.token_at[node] = rank
        self.edges: dict[int, tuple[list, list]] = {}
        self.agree: dict[int, bool] = {}
        self._start()

    def _start(self) -> None:
        if len(self.agree) >= AGREE:
            self.agree.clear()
        self.states: list[bytes] = []
        self.moves: dict[int, int | tuple] = {}
        self.numbers: dict[bytes, int] = {}
        self._number(_packed(NONE, [((), 0)]))

    def _number(self, state: bytes) -> int:
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        return number

    def _edges(self, token: int) -> tuple[list, list]:
        """The token's first pieces and its last ones while it is merged, as (bytes, rank of the
        merge that makes the piece, rank of the one that takes it up)."""
        if token not in self.edges:
            data = self.bytes_of[token]
            parts, first, last = [data[i:i + 1] for i in range(len(data))], [], []
            first.append((parts[0], -1))
            last.append((parts[-1], -1))
            for rank, at in merge_steps(parts, self.ranks):
                if at == 0:
                    first.append((parts[0], rank))
                if at == len(parts) - 1:
                    last.append((parts[-1], rank))
            self.edges[token] = tuple(
                [(x, born, ends) for (x, born), ends in zip(e, [*(b for _, b in e[1:]), END])] for e in (first, last))
        return self.edges[token]

    def _agrees(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together: no last
        piece of the left one and first piece of the right one, there at one time, merge before
        either is taken up. Of equal ranks, the leftmost pair comes first."""
        if left == NONE:
            return True
        ranks = self.ranks
        for x, x_born, x_ends in self._edges(left)[1]:
            for y, y_born, y_ends in self._edges(right)[0]:
                if y_born >= x_ends or x_born > y_ends:
                    continue
                rank = ranks.get(x + y)
                if rank is not None:
                    time = max(rank, x_born, y_born)
                    if time < x_ends and time <= y_ends:
                        return False
        return True

    def _move(self, number: int, byte: int) -> int | tuple:
        trie, token_at, agree = self.trie, self.token_at, self.agree
        last, ways = _ways(self.states[number])
        new, split = [], None  # one way at most completes a token that agrees
        for held, node in ways:
            to = trie[node].get(byte)
            if to is None:
                continue
            if trie[to]:
                new.append((held, to))
            if split is None and (token := token_at.get(to)) is not None:
                before = held[-1] if held else last
                key = before << 32 | token
                fits = agree.get(key)
                if fits is None:
                    fits = agree[key] = self._agrees(before, token)
                if fits:
                    split = [*held, token]
        if split is not None:
            new.insert(0, (split, 0))
        emitted = []
        if all(held for held, _ in new):  # what all ways begin with is emitted
            first = new[0][0]
            common = len(first)
            for held, _ in new:
                while first[:common] != held[:common]:
                    common -= 1
            if common:
                emitted, last = first[:common], first[common - 1]
                new = [(held[common:], node) for held, node in new]
        if all(held for held, _ in new):
            last = NONE  # the last emitted id only matters to a way that holds nothing back
        to = self._number(_packed(last, new))
        found = self.moves[number << 8 | byte] = (to, emitted) if emitted else to
        return found

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if piece in self.whole:
            return self.whole[piece]
        if len(self.states) >= self.most:
            self._start()
        out: list[int] = []
        state, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(self.states) >= 2 * self.most:  # one endless piece: go on from this state alone
                    now = self.states[state]
                    self._start()
                    state, moves = self._number(now), self.moves
                move = self._move(state, byte)
            if type(move) is int:
                state = move
            else:
                state, ids = move
                out += ids
        held, node = _ways(self.states[state])[1][0]  # a way at the root of the trie comes first
        return (*out, *held) if node == 0 else tuple(out)


def _packed(last: int, ways: list) -> bytes:
    """A state: the last emitted id, and for each way the number of ids held back, these, its node."""
    flat = [last]
    for held, node in ways:
        flat.append(len(held))
        flat += held
        flat.append(node)
    return array("I", flat).tobytes()


def _ways(state: bytes) -> tuple[int, list]:
    flat = memoryview(state).cast("I").tolist()
    ways, i = [], 1
    while i < len(flat):
        end = i + 1 + flat[i]
        ways.append((flat[i + 1:end], flat[end]))
        i = end + 1
    return flat[0], ways


class Encoder:
    """Text -> ids. The ids of the last ``PIECES`` to twice as many different pieces are kept."""

    def __init__(self, ranks: dict[bytes, int], lonely: frozenset, pattern: str):
        self.transducer = Transducer(ranks, lonely)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _blocks(self, text: str) -> Iterator[list[str]]:
        """The text's pieces, of a long text some at a time."""
        if len(text) < LONG:
            yield self.pattern.findall(text)
            return
        pieces = self.pattern.finditer(text)
        while block := [m[0] for m in itertools.islice(pieces, BLOCK)]:
            yield block

    def encode(self, text: str) -> array:
        out = array("I")
        for block in self._blocks(text):
            here = {}  # also those too long to be kept
            if len(self.known) >= PIECES:
                self.older, self.known = self.known, {}
            known = self.known
            for piece in set(block).difference(known):
                ids = self.older.get(piece) or self.transducer.encode(piece.encode())
                if len(piece) <= LONGEST_KEPT_PIECE:
                    known[piece] = ids
                else:
                    here[piece] = ids
            look = (lambda p: here.get(p) or known[p]) if here else known.__getitem__
            out.extend(itertools.chain.from_iterable(map(look, block)))
        return out


# ------------------------------------------------------------------ decoding
def utf8_step(pending: bytes, data: bytes) -> tuple[str, bytes]:
    """One run of the automaton: characters completed by ``data`` and the bytes still pending.

    A lead byte fixes how many bytes follow and the range of the second one (no overlong forms, no
    surrogates, nothing above U+10FFFF). A byte that doesn't fit ends the pending character as U+FFFD
    and is read anew.
    """
    out, have = [], bytearray(pending)
    for b in data:
        if have:
            low, high = _second(have[0]) if len(have) == 1 else (0x80, 0xBF)
            if low <= b <= high:
                have.append(b)
                if len(have) == _length(have[0]):
                    out.append(have.decode())
                    have.clear()
                continue
            out.append("�")
            have.clear()
        if b < 0x80:
            out.append(chr(b))
        elif _length(b):
            have.append(b)
        else:
            out.append("�")
    return "".join(out), bytes(have)


def _length(lead: int) -> int:
    return 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0


def _second(lead: int) -> tuple[int, int]:
    return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))


class Decoder:
    """Ids -> text, token by token. A text's end leaves U+FFFD for an unfinished character."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of = {r: t for t, r in ranks.items()}
        self.moves: dict[bytes, dict[int, tuple[str, bytes]]] = {b"": {}}

    def feed(self, state: bytes, token: int) -> tuple[str, bytes]:
        moves = self.moves.setdefault(state, {})
        if token not in moves:
            moves[token] = utf8_step(state, self.bytes_of[token])
        return moves[token]

    def decode(self, ids: bytes) -> str:
        tokens = array("I")
        tokens.frombytes(ids)
        out, state, moves = [], b"", self.moves
        for t in tokens:
            move = moves[state].get(t)
            if move is None:
                move = self.feed(state, t)
                moves.setdefault(move[1], {})
            text, state = move
            if text:
                out.append(text)
        return "".join(out) + "�" * bool(state)


# ------------------------------------------------------------------ on tables
_MADE: dict[int, tuple] = {}


def _in_worker(kind: str, shared, make):
    """One encoder and decoder for each Python worker and vocabulary."""
    key = (kind, hash(shared))
    if key not in _MADE:
        if len(_MADE) >= 4:
            _MADE.clear()
        _MADE[key] = make()
    return _MADE[key]


def vocabulary(path: str) -> tuple:
    """What tasks need of a vocabulary: its tokens in order of rank, and those no merges reach."""
    ranks = load_ranks(path)
    return tuple(sorted(ranks.items(), key=lambda x: x[1])), unreachable(frozenset(ranks.items()))


def _mapped(df: DataFrame, path: str, source: str, made: dict[str, str], maker, *options) -> DataFrame:
    """``df`` with the columns ``made`` (name -> type), of what ``maker(tokens, lonely, *options)`` gives for the
    bytes of the column ``source``. The vocabulary at ``path`` is some MB at most and is broadcast."""
    words = df.sparkSession.sparkContext.broadcast(vocabulary(path))
    raw = fresh(df, *[f"__raw{i}" for i in range(len(made))])

    def run(batches):
        work = _in_worker(str((maker.__name__, options)), words.value, lambda: maker(*words.value, *options))
        for batch in batches:
            at = [batch.schema.get_field_index(r) for r in raw]
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                found = zip(*[work(t.as_buffer().to_pybytes()) for t in part.column(at[0])])
                for i, values in zip(at, found):
                    part = part.set_column(i, batch.schema.field(i), pa.array(values, batch.schema.field(i).type))
                yield part

    given = df.withColumns({raw[0]: text_bytes(source), **{r: F.lit(None).cast("binary") for r in raw[1:]}})
    found = map_arrow(given, run)
    return found.select(*[col(c) for c in df.columns if c not in made],
                        *[col(r).cast(kind).alias(c) for r, (c, kind) in zip(raw, made.items())])


def _encoding(tokens, lonely, pattern):
    encoder = Encoder(dict(tokens), lonely, pattern)
    return lambda text: (encoder.encode(text.decode("utf-8", "replace")).tobytes(),)


def _decoding(tokens, lonely):
    decoder = Decoder(dict(tokens))
    return lambda ids: (decoder.decode(ids).encode(),)


def _both(tokens, lonely, pattern):
    encode, decode = _encoding(tokens, lonely, pattern), _decoding(tokens, lonely)

    def work(text):
        ids, = encode(text)
        return ids, *decode(ids)

    return work


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """``df`` with ``out_col``: the text's ids (binary). ``path``: rank file on the driver."""
    return _mapped(df, path, text_col, {out_col: "binary"}, _encoding, pattern)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with ``out_col``: the text of the ids."""
    return _mapped(df, path, ids_col, {out_col: "string"}, _decoding)


def round_trip(df: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` and what they decode to, ``decoded``, by one pass of the tasks."""
    return _mapped(df, path, text_col, {"ids": "binary", "decoded": "string"}, _both, pattern)


def n_tokens(ids_col: str = "ids"):
    return (F.octet_length(col(ids_col)) / 4).cast("long")
