"""Canonical entities: one surrogate for all spellings, planted spans as the independent truth of detection."""

import random

import pytest
from helpers import documents

from costsieve.llm import pii as P

KEY = b"a key"


def new_texts(spark, texts):
    out, table = P.replace_entities(documents(spark, list(enumerate(texts))), KEY)
    return [r["text"] for r in sorted(out.collect(), key=lambda r: r["doc_id"])], {(r["kind"], r["entity"]): r["surrogate"] for r in table.collect()}


def digits(s):
    return "".join(c for c in s if c.isdigit())


def test_spellings_of_one_entity_share_a_surrogate(spark):
    groups = [["Jo@x.com", "jo@x.com", "JO@X.COM"],
              ["4845168114407329", "4845-1681-1440-7329", "4845 1681 1440 7329"],
              ["+1 (017) 555-7713", "+1 017 555 7713", "+1.017.555.7713"],
              ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"]]
    new, table = new_texts(spark, [t for g in groups for t in g])
    assert len(table) == len(groups)
    at = 0
    for g in groups:
        mine = new[at:at + len(g)]
        at += len(g)
        assert not set(mine) & set(g)
        assert len({"".join(c for c in x.lower() if c.isalnum()) for x in mine}) == 1
        for old, x in zip(g, mine):  # each span's own form
            assert [c.isdigit() * 2 + c.isupper() or c.isalpha() or c for c in old] == [c.isdigit() * 2 + c.isupper() or c.isalpha() or c for c in x]


def test_names_are_coreferent_in_parts(spark):
    text = "Mrs Ada Byron came. Mr Byron left; Dr. BYRON's bag stayed, Ada Byron said. Byron is a place"
    (new, other), table = new_texts(spark, [text, "Dr Ada Lee"])
    given, family = table["given", "ada"].title(), table["name", "byron"].title()
    assert given in P.GIVEN["latin", "f"]  # a title elsewhere says the gender
    assert new == f"Mrs {given} {family} came. Mr {family} left; Dr. {family.upper()}'s bag stayed, {given} {family} said. Byron is a place"
    assert other == f"Dr {given} {table['name', 'lee'].title()}"


def test_titles_that_differ_give_a_neutral_name(spark):
    _, table = new_texts(spark, ["Mr Kim Lee", "Mrs Kim Roe", "Herr Jo Roe", "Dr Max Roe"])
    assert table["given", "kim"].title() in P.GIVEN["latin", "x"] and table["given", "max"].title() in P.GIVEN["latin", "x"]
    assert table["given", "jo"].title() in P.GIVEN["latin", "m"]


@pytest.mark.parametrize("text,kind", [
    ("δοκιμή@παράδειγμα.ελ", "email"), ("田中@例え.jp", "email"), ("пример@почта.рф", "email"), ("Mr Łukasz Żak", "name-m"),
    ("Mrs Đorđević", "name-f"), ("Mrs Παπαδόπουλος", "name-f"), ("Κυρία Ελένη Νίκου", "name-f"), ("Mr Պետրոս Սարգսյան", "name-m")])
def test_every_script(text, kind):
    [(a, b, found, entity)] = P.detect(text)
    assert found == kind and text[a:b] == entity
    new = P.surrogate(KEY, kind, entity)
    assert [P.script_of(c) for c in new if c.isalpha()][0] == [P.script_of(c) for c in entity if c.isalpha()][0]
    if kind == "email":  # no letter but the top level's is certain to stay, and none leaves its script
        assert new.rsplit(".")[-1] == entity.rsplit(".")[-1] and len(new) == len(entity)
        assert [P.script_of(c) for c in new] == [P.script_of(c) for c in entity] and new.split("@")[0] != entity.split("@")[0]
    else:
        assert len(new.split()) == len(entity.split()) and all(w[0].isupper() for w in new.split())
    assert [k for _, _, k, _ in P.detect(text.replace(entity, new))] == [kind]


@pytest.mark.parametrize("span", ["word", "Mr lower", "Dr. x", "Mrs ", "the Mr", "Herr 12"])
def test_no_name_without_a_capital(span):
    assert P.detect(span) == []


def test_drawn_numbers_are_valid():
    for i in range(200):
        iban = P.surrogate(KEY, "iban", f"DE89{3704004405320130 + i}00")
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "DE"
        card = P.surrogate(KEY, "card", "4845-1681-1440-7329", i)
        assert P.is_card(card) and card[0] == "4"
        ip = [int(x) for x in P.surrogate(KEY, "ip", "8.8.4.4", i).split(".")]
        assert ip[0] == 10 if i < P.WIDEN_AFTER else 240 <= ip[0] < 255
        assert P.surrogate(KEY, "phone", "+49 30 1234567", i).startswith("+49 ")
    assert P.surrogate(KEY, "ssn", "١٢٣-٤٥-٦٧٨٩").isascii() is False


def test_addresses_of_a_domain_stay_together():
    new = [P.surrogate(KEY, "email", e) for e in ("ann@corp.de", "Bob@Corp.de", "ann@other.de")]
    assert len({x.split("@")[1].lower() for x in new}) == 2


def test_canonical_form_of_a_dressed_surrogate_is_the_drawn_one():
    for kind, span in (("email", "Jo.É@Mail.Corp.de"), ("card", "4845 1681 1440 7329"), ("phone", "+1 (017) 555-7713"), ("phone", "212-555-0182"),
                       ("ssn", "123-45-6789"), ("iban", "GB82 WEST 1234 5698 7654 32"), ("name-f", "ADA Byron"), ("name-m", "O'Brien"), ("ip", "8.8.4.4")):
        for attempt in range(12):
            entities = P.entities_of(kind, span)
            news = [P.drawn(KEY, k, e, P.GENDERS[g], attempt) for k, e, g in entities]
            assert [(k, e) for k, e, _ in P.entities_of(kind, P.dressed(kind, span, news))] == [(k, n) for (k, _, _), n in zip(entities, news)]


def test_detection_against_planted_spans():
    """Texts put together from filler and entities: the spans are known without any pattern."""
    rng = random.Random(5)
    filler = ["the", "report", "of", "2024", "and", "Version", "3.14", "costs", "1,234", "a-b", "Ελλάδα", "文字", "x_y", "(see", "below)", "Misses", "Droll", "17:30"]
    given, family = ["Ada", "Łukasz", "Émile", "Anna", "Ωρα"], ["Byron", "Żak", "O'Neil", "Weber-Lee", "Белова"]
    for _ in range(300):
        text, spans = "", []
        for _ in range(rng.randint(1, 30)):
            kind = rng.choice(["", "", "email", "card", "phone", "ssn", "ip", "iban", "name", "secret"])
            head = tail = ""
            if not kind:
                entity = rng.choice(filler)
            elif kind == "email":
                entity = f"{rng.choice(['jo', 'é.ü', 'A+b', '山田'])}{rng.randint(0, 99)}@{rng.choice(['mail.corp', 'x', '例え'])}.{rng.choice(['com', 'de', 'рф'])}"
            elif kind == "card":
                body = "4" + "".join(str(rng.randint(0, 9)) for _ in range(14))
                entity = body + next(str(d) for d in range(10) if sum(x - 9 * (x > 9) for x in [int(c) * (2 - i % 2) for i, c in enumerate(f"{body}{d}")]) % 10 == 0)
                entity = rng.choice(["", "-"]).join([entity[i:i + 4] for i in range(0, 16, 4)])
            elif kind == "phone":
                entity = rng.choice(["+49 30 {:07d}", "({:03d}) 555-0100", "212-555-{:04d}"]).format(rng.randint(100, 999))
                entity = entity.replace("+49 30 0000", "+49 30 1234 ")
            elif kind == "ssn":
                entity = f"{rng.randint(100, 999)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}"
            elif kind == "ip":
                entity = ".".join(str(rng.randint(0, 255)) for _ in range(4))
            elif kind == "iban":
                entity = "DE89 3704 0044 0532 0130 00"
            elif kind == "name":
                title = rng.choice(["Mr", "Mrs.", "Dr", "Prof."])
                head, entity = title + " ", rng.choice([rng.choice(family), rng.choice(given) + " " + rng.choice(family)])
                kind = {"Mr": "name-m", "Mrs.": "name-f"}.get(title, "name-x")
            else:
                head, entity = "token=", "".join(rng.choice("0123456789abcdef") for _ in range(20))
            text += head
            if kind:
                spans.append((len(text), len(text) + len(entity), kind, entity))
            text += entity + tail + rng.choice([", ", "; ", ",\n"])
        assert P.detect(text) == spans
        assert bool(spans) == (next(P.spans(text), None) is not None)


def test_long_text_with_many_entities():
    text = " ".join(f"u{i}@corp.de" for i in range(30_000))
    assert len(P.detect(text)) == 30_000
