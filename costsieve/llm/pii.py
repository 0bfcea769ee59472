"""PII surrogates: every detected entity gets a keyed replacement of its own type and form.

1. Detection, per row: e-mail addresses, bank cards, phone numbers, IPv4 addresses, IBANs, social
   security numbers, secrets assigned to a name, and personal names after a title. A span that lies
   in an earlier type's span is left out. A full name found after a title is found again in the
   same text where it stands without one; a bare surname isn't, as it may be any other word.
2. Entities are keyed by canonical form: addresses in lower case, numbers by their digits (phone
   numbers with their plus), IBANs without blanks. A name is two entities, the given name and the
   surname, in lower case and without title, so "Mrs Ada Byron", "Ada Byron" and "Dr. BYRON" share
   one surname surrogate. One word after a title is a surname. A given name's gender is that of all
   its titles in the corpus, neutral where they differ or say none.
3. The distinct entities of the whole corpus become one table. A surrogate is drawn for each from
   HMAC-SHA256(key, type, entity, attempt): digits for digits, letters of the same script for
   letters; a card keeps its issuer's prefix and has a valid check digit, an IBAN its country and
   valid check digits, an IP address lies in a private range (later in the reserved 240.0.0.0/4), a
   phone number keeps its country code. Addresses of one domain share a domain of the same form and
   top level (it isn't checked whether anyone owns it); reserved example domains stay.
4. Collision checks: two entities of a type never share a surrogate, and none is an entity that
   the corpus itself has, in any spelling. The smallest entity keeps a surrogate that is drawn twice;
   the others draw again with the next attempt, until no collision is left. Later attempts widen the
   form (an appended letter or digit) once it may be exhausted.
5. The table is joined back to the rows that have entities, and each span's own form is put on
   its surrogate: case, brackets, hyphens and blanks, the script of its digits. So the same entity
   has the same surrogate everywhere, and coreference within and between documents stays.

Only rows with entities are shuffled; all others pass through one scan. The entity table is as
large as the number of distinct entities; it is joined, never broadcast by hand or collected.
Detection runs once for the rows with entities and once, up to a row's first entity, for the others:
one pass would have to write the whole corpus in between.

Defined cases: null texts stay null and empty ones empty; a text without entities is unchanged;
very long texts are read whole, in time linear in their length; repeated rows are changed alike; an
empty table gives empty results; a key of any length will do, an empty one is an error.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costsieve.llm.common import col, fresh, map_arrow, materialise

ROUNDS = 64
WIDEN_AFTER = 8
GENDERS = "xfmx"  # by the titles' bits: none, 1 for f, 2 for m, both

# Titles by gender, and given names and surnames of each script to draw from.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora", "Doña", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Sr", "Señor", "Don", "Господин", "Κύριος"],
    "x": ["Dr", "Prof"],
}
GIVEN = {
    ("latin", "f"): ["Alice", "Clara", "Diana", "Elena", "Flora", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Olga", "Paula", "Rosa", "Sara", "Vera"],
    ("latin", "m"): ["Adam", "Bruno", "Carl", "David", "Emil", "Frank", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Oscar", "Paul", "Viktor"],
    ("latin", "x"): ["Alex", "Andrea", "Chris", "Dominique", "Jamie", "Jordan", "Kim", "Lee", "Morgan", "Robin", "Sam", "Sasha", "Taylor", "Toni", "Val", "Yael"],
    ("cyrillic", "f"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("cyrillic", "m"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Иван", "Олег", "Павел"],
    ("cyrillic", "x"): ["Саша", "Женя", "Валя", "Слава"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Χλόη"],
    ("greek", "m"): ["Ανδρέας", "Γιάννης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
    ("greek", "x"): ["Αλέξ", "Χάρις", "Φώτις"],
}
SURNAMES = {
    "latin": ["Albers", "Bauer", "Carter", "Dumont", "Evers", "Fischer", "Garcia", "Hansen", "Iversen", "Jansen", "Keller", "Lopez", "Moreau", "Novak", "Olsen", "Perez",
              "Quinn", "Reyes", "Santos", "Turner", "Ulrich", "Vidal", "Weber", "Young", "Zeller"],
    "cyrillic": ["Белов", "Волков", "Громов", "Жуков", "Зайцев", "Козлов", "Лебедев", "Орлов"],
    "greek": ["Αλεξίου", "Γεωργίου", "Δήμου", "Ιωάννου", "Κωνσταντίνου", "Νικολάου", "Παύλου", "Στεφάνου"],
}
GENDER = {t: g for g, titles in TITLES.items() for t in titles}
_TITLES = "|".join(sorted(GENDER, key=len, reverse=True))
_WORD = r"[^\W\d_][\w'’-]*"
PATTERNS = [
    ("email", re.compile(r"[\w.%+-]+@(?:[\w-]+\.)+[^\W\d_]{2,}"), 0),
    ("secret", re.compile(r"(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_+/=-]{8,})"), 1),
    ("secret", re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9]{20,})\b"), 0),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"), 0),
    ("card", re.compile(r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"), 0),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"
                         r"|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"), 0),
    ("ssn", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), 0),
    ("ip", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"), 0),
    ("name", re.compile(rf"(?<!\w)({_TITLES})\.? ({_WORD}(?: (?!(?:{_TITLES})\b){_WORD})?)"), 2),
]
# What a text has to hold before the patterns of a kind are tried.
_DIGIT = re.compile(r"\d")
_SECRET_HINTS = ("key", "secret", "token", "passw", "akia", "gh", "sk-")
_TITLE_HINTS = tuple(t + end for t in GENDER for end in (" ", ". "))
_ISSUER = re.compile(r"4|5[1-5]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3[4-689]|6(?:011|4[4-9]|5|2)")
# The country codes of one and two digits; all others have three.
_COUNTRY_CODE = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{1,3}")


def luhn_digit(digits: str) -> str:
    """The check digit that follows ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 == 0 else 1)
        total += x - 9 if x > 9 else x
    return str(-total % 10)


def is_card(entity: str) -> bool:
    """An issuer's prefix and a right check digit: other long numbers aren't cards."""
    digits = re.sub(r"\D", "", entity)
    return bool(_ISSUER.match(digits)) and luhn_digit(digits[:-1]) == digits[-1]


def _name_end(text: str, a: int, b: int) -> int:
    """The end of the one or two capitalised words of text[a:b], without a possessive ending."""
    second = text.find(" ", a, b) + 1
    if not text[a].isupper() or not second:
        b = b if text[a].isupper() else a
    elif not text[second].isupper():
        b = second - 1
    b -= 2 if text[max(a, b - 2):b] in ("'s", "’s") else 0
    while b > a and text[b - 1] in "'’-":
        b -= 1
    return b


def spans(text: str) -> Iterator[tuple[int, int, str, str]]:
    """The entities of ``detect`` in the order of their finding."""
    digits = bool(_DIGIT.search(text))
    lower = text.lower()
    hints = {"email": "@" in text, "secret": any(h in lower for h in _SECRET_HINTS),
             "name": any(h in text for h in _TITLE_HINTS)}
    taken = bytearray()  # 1 for the characters of entities
    full: dict[str, str] = {}
    for kind, pattern, group in PATTERNS:
        if not hints.get(kind, digits):
            continue
        for m in pattern.finditer(text):
            a, b = m.span(group)
            if kind == "card" and not is_card(m[0]):
                continue
            if kind == "name":
                b = _name_end(text, a, b)
            if a < b and taken.find(1, a, b) < 0:
                label = f"name-{GENDER[m[1]]}" if kind == "name" else kind
                if kind == "name" and " " in text[a:b]:
                    full.setdefault(text[a:b], label)
                taken = taken or bytearray(len(text))
                taken[a:b] = b"\1" * (b - a)
                yield a, b, label, text[a:b]
    if full:
        again = re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(n) for n in sorted(full, key=len, reverse=True))})(?!\w)")
        for m in again.finditer(text):
            if taken.find(1, *m.span()) < 0:
                yield *m.span(), full[m[0]], m[0]


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, entity) of all entities, in order; spans don't overlap. A name's type says
    its title's gender."""
    return sorted(spans(text))


def lowered(text: str) -> str:
    """Lower case of the same length: a letter whose lower case is longer stays."""
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def entities_of(kind: str, span: str) -> list[tuple[str, str, int]]:
    """(type, canonical form, bits of the title's gender) of a span: two for a full name."""
    if kind.startswith("name-"):
        *given, family = lowered(span).split(" ")
        return [("given", g, max(GENDERS.find(kind[-1]), 0)) for g in given] + [("name", family, 0)]
    if kind == "email":
        form = lowered(span)
    elif kind in ("card", "phone", "ssn"):
        form = "+" * span.startswith("+") + "".join(str(int(c)) for c in span if c.isdecimal())
    elif kind == "iban":
        form = span.replace(" ", "")
    elif kind == "ip":
        form = ".".join(str(int(x)) for x in span.split("."))
    else:
        form = span
    return [(kind, form, 0)]


class Draw:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, entity: str, attempt: int):
        self.seed, self.block, self.left = hmac.new(key, f"{kind}\0{attempt}\0{entity}".encode(), hashlib.sha256).digest(), 0, b""

    def __call__(self, n: int) -> int:
        while len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.block.to_bytes(4, "big")).digest()
            self.block += 1
        x, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return x % n


def script_of(c: str) -> str:
    """The first word of the character's name, as in LATIN SMALL LETTER A."""
    return unicodedata.name(c, "").partition(" ")[0].lower()


@lru_cache(4096)
def _letters(c: str) -> str:
    """Letters of the same script and case near ``c``, whose case can be changed and changed back."""
    like = script_of(c), unicodedata.category(c)
    for size in (0x80, 0x400, 0x4000):
        first = ord(c) // size * size
        near = [x for x in map(chr, range(first, first + size))
                if (script_of(x), unicodedata.category(x)) == like and len(x.upper()) == 1 and x.upper().lower() == x.lower()]
        if len(near) > 1:
            return "".join(near)
    return c


def _same_form(entity: str, draw: Draw, hexadecimal: bool = False) -> str:
    """Digits for digits and letters of the same script and case for letters."""
    out = []
    for c in entity:
        if c.isdecimal():
            out.append(chr(ord(c) - int(c) + draw(10)))
        elif c.isalpha():
            pool = ("ABCDEF" if c.isupper() else "abcdef") if hexadecimal else _letters(c)
            out.append(pool[draw(len(pool))])
        else:
            out.append(c)
    return "".join(out)


def iban_check(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def drawn(key: bytes, kind: str, entity: str, gender: str = "x", attempt: int = 0) -> str:
    """The surrogate of a canonical entity, itself in canonical form."""
    draw = Draw(key, kind, entity, attempt)
    wide = attempt >= WIDEN_AFTER
    if kind == "given" or kind.startswith("name"):
        script = script_of(entity[:1] or "a")
        names = GIVEN.get((script, gender)) if kind == "given" else SURNAMES.get(script)
        if not names:
            return _same_form(entity, draw) + (_same_form(entity[-1:] * 4, draw) if wide else "")
        out = lowered(names[draw(len(names))])
        if attempt == 1:  # the lists are short: a second name, then invented ones
            out += "-" + lowered(names[draw(len(names))])
        elif attempt:
            out += "-" + _same_form(out[0] * 6, draw)
        return out
    if kind == "email":
        local, domain = entity.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        local = _same_form(local, draw) + ("x%d" % draw(10**6) if wide else "")
        if not domain.endswith(("example.com", "example.org", "example.net")):  # reserved already
            domain = f"{_same_form(host, Draw(key, 'domain', domain, 0))}.{top}"
        return f"{local}@{domain}"
    if kind == "ip":
        first = f"10.{draw(256)}" if not wide else f"{240 + draw(15)}.{draw(256)}"
        return f"{first}.{draw(256)}.{1 + draw(254)}"
    if kind == "card":
        prefix = entity[: 1 if entity[0] == "4" else 4]
        out = prefix + _same_form(entity[len(prefix):-1], draw)
        return out + luhn_digit(out)
    if kind == "phone":
        code = "+" + _COUNTRY_CODE.match(entity, 1)[0] if entity.startswith("+") else ""
        return code + _same_form(entity[len(code):], draw) + (f"{draw(1000):03d}" if wide else "")
    if kind == "iban":
        account = _same_form(entity[4:], draw)
        return entity[:2] + iban_check(entity[:2], account) + account
    if kind == "secret":
        fixed = re.match(r"AKIA|gh[pousr]_|sk-", entity)
        head = fixed[0] if fixed else ""
        return head + _same_form(entity[len(head):], draw, bool(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", entity)))
    return _same_form(entity, draw) + (f"{draw(1000):03d}" if wide else "")


def _cased(form: str, new: str) -> str:
    """``new`` with capitals where ``form`` has them; all capitals if form has no others."""
    if len(form) > 1 and form.isupper():
        return new.upper()
    return "".join(c.upper() if i < len(form) and form[i].isupper() else c for i, c in enumerate(new))


def dressed(kind: str, span: str, news: list[str]) -> str:
    """The surrogates of a span's entities in the form of the span."""
    if kind.startswith("name-"):
        return " ".join(new.upper() if len(word) > 1 and word.isupper() else "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
                        for word, new in zip(span.split(" "), news))
    new = news[0]
    if kind == "email":
        (a, x), (b, y) = span.rsplit("@", 1), new.rsplit("@", 1)
        return f"{_cased(a, b)}@{_cased(x, y)}"
    if kind in ("card", "phone", "ssn", "iban"):
        rest = iter(new.lstrip("+"))
        out = [chr(ord(c) - int(c) + int(next(rest))) if c.isdecimal() else next(rest) if c.isalpha() else c for c in span]
        return "".join(out) + "".join(rest)
    return new


def surrogate(key: bytes, kind: str, entity: str, attempt: int = 0) -> str:
    """The surrogate of one span as it would be without collisions."""
    return dressed(kind, entity, [drawn(key, k, e, GENDERS[g], attempt) for k, e, g in entities_of(kind, entity)])


SPANS = "array<struct<start:int,end:int,kind:string,entity:string,keys:array<struct<kind:string,entity:string,gender:int>>>>"


def _span(start: int, end: int, kind: str, entity: str) -> dict:
    keys = [dict(zip(("kind", "entity", "gender"), x)) for x in entities_of(kind, entity)]
    return {"start": start, "end": end, "kind": kind, "entity": entity, "keys": keys}


def _detect(raw: str, where: str):
    """The rows that have entities, with their spans."""

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            found = [detect(t) if t else [] for t in batch.column(names.index(raw)).to_pylist()]
            own = pa.array([[_span(*x) for x in f] for f in found], batch.schema.field(where).type)
            batch = pa.RecordBatch.from_arrays([own if n == where else batch.column(k) for k, n in enumerate(names)], names=names)
            yield batch.filter(pa.array([bool(f) for f in found], pa.bool_()))

    return run


def _clean(raw: str):
    """The rows without entities: a text is read up to its first."""

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index(raw)).to_pylist()
            yield batch.filter(pa.array([not t or next(spans(t), None) is None for t in texts], pa.bool_()))

    return run


def _draw(key: bytes):
    def run(frames):
        for pdf in frames:
            pdf["surrogate"] = [drawn(key, k, e, GENDERS[g], a) for k, e, g, a in
                                zip(pdf["kind"], pdf["entity"], pdf["gender"].tolist(), pdf["attempt"].tolist())]
            yield pdf

    return run


def surrogate_table(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity), both in canonical form: no surrogate comes
    twice for a kind, and none is an entity of that kind. A column ``gender`` may hold title bits."""
    if not key:
        raise ValueError("the surrogate key is empty")
    gender = F.bit_or("gender") if "gender" in entities.columns else F.lit(0)
    known = materialise(entities.groupBy("kind", "entity").agg(gender.alias("gender")), "entities")
    open_ = known.withColumn("attempt", F.lit(0))
    done = None
    for attempt in range(ROUNDS):
        drawn = open_.mapInPandas(_draw(key), "kind string, entity string, gender int, attempt int, surrogate string")
        drawn = materialise(drawn, "surrogates")
        # the one row that keeps a surrogate: the smallest entity, if no earlier round and no entity has it
        first = drawn.groupBy(F.col("kind").alias("k"), F.col("surrogate").alias("s")).agg(F.min("entity").alias("e"))
        taken = known.select(F.col("kind").alias("k"), F.col("entity").alias("s"))
        if done is not None:
            taken = taken.union(done.select("kind", "surrogate"))
        free = first.join(taken.distinct(), ["k", "s"], "left_anti")
        marked = materialise(
            drawn.join(free, (F.col("kind") == F.col("k")) & (F.col("entity") == F.col("e")), "left")
            .select("kind", "entity", "gender", "attempt", "surrogate", F.col("e").isNotNull().alias("keeps")), "surrogates")
        kept = marked.where("keeps").select("kind", "entity", "surrogate")
        done = kept if done is None else done.union(kept)
        again = marked.where("not keeps")
        if again.isEmpty():
            return done
        open_ = again.select("kind", "entity", "gender", (F.col("attempt") + 1).alias("attempt"))
    raise RuntimeError(f"surrogates still collide after {ROUNDS} rounds")


def _replace(raw: str, where: str, pairs: str):
    def run(batches):
        for batch in batches:
            names = batch.schema.names
            out = []
            for text, found, own in zip(*[batch.column(names.index(n)).to_pylist() for n in (raw, where, pairs)]):
                to = {(p["kind"], p["entity"]): p["surrogate"] for p in own}
                parts, at = [], 0
                for s in found:
                    news = [to[k["kind"], k["entity"]] for k in s["keys"]]
                    parts += [text[at:s["start"]], dressed(s["kind"], s["entity"], news)]
                    at = s["end"]
                out.append("".join(parts) + text[at:])
            new = pa.array(out, batch.column(names.index(raw)).type)
            yield pa.RecordBatch.from_arrays([new if n == raw else batch.column(k) for k, n in enumerate(names)], names=names)

    return run


def replace_entities(docs: DataFrame, key: bytes, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The documents with surrogates in their texts and a last column of the number of entities
    (named by ``fresh(docs, "n_entities")``), and the surrogate table."""
    count, row, where, pairs = fresh(docs, "n_entities", "__row", "__spans", "__pairs")
    empty = docs.withColumn(where, F.array().cast(SPANS))
    hits = materialise(map_arrow(empty, _detect(text_col, where))
                       .withColumn(row, F.monotonically_increasing_id()), "with-entities")
    keys = F.flatten(F.transform(col(where), lambda s: s["keys"]))
    each = hits.select(row, F.explode(keys).alias("s")).select(row, "s.*").groupBy(row, "kind", "entity").agg(F.bit_or("gender").alias("gender"))
    table = surrogate_table(each, key)
    own = each.join(table.select(F.col("kind").alias("k"), F.col("entity").alias("e"), "surrogate"),
                    (F.col("kind") == F.col("k")) & (F.col("entity") == F.col("e")))
    own = own.groupBy(F.col(row).alias("__at")).agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias(pairs))
    joined = hits.join(own, col(row) == F.col("__at")).drop("__at")
    changed = map_arrow(joined, _replace(text_col, where, pairs))
    own_columns = [col(c) for c in docs.columns]
    out = changed.select(*own_columns, F.size(col(where)).cast("long").alias(count)).union(
        map_arrow(docs, _clean(text_col)).select(*own_columns, F.lit(0).cast("long").alias(count)))
    return out, table
