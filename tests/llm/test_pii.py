import hashlib
import math
import random
import re

import pytest

from ledgerline.llm import pii, skew
from ledgerline.llm.staging import read

SCHEMA = "doc_id long, text string, doc string, terms string, key string"


def luhn(digits):
    total = 0
    for k, c in enumerate(digits[::-1]):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def brute(text):
    text = text or ""

    def digits(s):
        return re.sub("[^0-9]", "", s)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(len(p) < 1000 and int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text) if good(m[0])] for k, (p, good) in kinds.items()}


def check(got, texts):
    for r in got:
        found = brute(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(map(len, found.values()))
        base = [s for spans in found.values() for s in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans.split(",")[: len(base)] == (base or [r.spans.split(",")[0]])[: len(base)]


def test_against_brute_force(spark, data):
    docs = read(spark, data, "documents")
    check(pii.digest_columns(pii.find(docs)).collect(), {r.doc_id: r.text for r in docs.collect()})


def test_random_texts(spark):
    random.seed(4)
    bits = ["a", "b.c", "@", "@x.y", ".", "-", "+", "1", "22", "255", "256", "1.2.3.4", "0001.2.3", " ", "(", ")", "4111 1111 1111 1111", "4390698575873170", "+1 (743) 555-3824", "\n", "é", "🙂", "_", "%"]
    texts = {k: "".join(random.choice(bits) for _ in range(random.randint(0, 25))) for k in range(4000)}
    texts |= {4000: None, 4001: "", 4002: "1" * 5000, 4003: "a" * 50_000 + "@", 4004: "a@" * 5000, 4005: "1." * 20_000, 4006: "word " * 50_000 + "x@y.zz"}
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in texts.items()], SCHEMA)
    got = pii.digest_columns(pii.find(docs)).collect()
    assert len(got) == len(texts)
    check(got, texts)


COMMON = ["river", "house", "spring", "wall", "garden", "letter", "window", "stone"]


def prose(n=12):
    return " ".join(random.choice(COMMON) for _ in range(n))


def word_places(text):
    covered = {i for p in SPAN_PATTERNS(text) for i in range(*p)}
    places, at = [], 0
    while at < len(text):
        if not text[at].isalpha():
            at += 1
            continue
        end = at
        while end < len(text) and text[end].isalpha():
            end += 1
        if end - at >= 3 and not covered & set(range(at, end)):
            places.append((at, end))
        at = end
    return places


def SPAN_PATTERNS(text):
    return [tuple(map(int, s.split(":")[1:])) for found in brute(text).values() for s in found]


def brute_terms(texts):
    """Terms that exceed the thresholds, with whether they reveal a value, from sets of texts."""
    unique = {t or "" for t in texts}
    near, has, where = {}, {}, {}
    for text in unique:
        for w in {text[a:b].lower() for a, b in [m.span() for m in re.finditer(r"[^\W\d_]{3,}", text)]}:
            has.setdefault(w, set()).add(text)
        words = word_places(text)
        for kind, found in brute(text).items():
            for span in found:
                start, end = map(int, span.split(":")[1:])
                value = text[start:end].lower() if kind in ("email", "ip") else re.sub(r"[\x20().-]", "", text[start:end])
                beside = [p for p in words if p[1] <= start][-5:] + [p for p in words if p[0] >= end][:5]
                for entity in (f"{kind}:{value}", f"{kind}:*"):
                    for a, b in beside:
                        near.setdefault((text[a:b].lower(), entity), set()).add(text)
                        where.setdefault(entity, set()).add(text)
    out = {}
    for (term, entity), both in near.items():
        n, n_term = len(both), len(has[term])
        if n >= 2 and n / n_term >= 0.5 and math.log2(n * len(unique) / (n_term * len(where[entity]))) >= 3:
            out[term] = out.get(term, False) or not entity.endswith(":*")
    return out


def check_terms(spark, texts):
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in texts.items()], SCHEMA)
    expected = brute_terms(texts.values())
    for r in pii.find(docs).collect():
        text = texts[r.doc_id] or ""
        spans = [("term" if expected[text[a:b].lower()] else "hint", a, b) for a, b in word_places(text) if text[a:b].lower() in expected]
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in ("term", "hint")] == sorted(spans, key=lambda s: (s[0] == "hint", s[1]))
    return expected


@pytest.mark.parametrize("size", [1 << 24, 0])
def test_term_spans_against_brute_force(spark, data, monkeypatch, size):
    """With a size of 0, joins with terms go by salted keys."""
    monkeypatch.setattr(skew, "BROADCAST_BYTES", size)
    assert check_terms(spark, {r.doc_id: r.text for r in read(spark, data, "documents").collect()}) is not None
    random.seed(8)
    texts = {}
    for k in range(120):
        owner = random.randrange(9)
        address = random.choice([f"box{owner}@mail.example", f"10.0.{owner}.1", f"+1 (555) 010-00{owner}0", f"new{k}@mail.example"])
        middle = f" Owner{'abcdefghi'[owner]}son {address} " + ("https://x.example/" + "z" * 300 + " " if k % 3 else " ") if k % 2 else " "
        texts[k] = prose(random.randrange(20)) + middle + prose(random.randrange(20)) + random.choice(["", " Ownerason", " été déjà"])
    texts |= {200: None, 201: "", 202: texts[1], 203: texts[1]}
    texts |= {300 + k: prose(15) + f" filler{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}" for k in range(300)}
    found = check_terms(spark, texts)
    assert True in found.values()


def test_revealing_terms_go_and_common_ones_stay(spark):
    random.seed(6)
    texts = [f"{prose()} Mr Okonkwo at okonkwo@mail.example {prose()} {k}x" for k in range(6)] + [f"{prose()} once Okonkwo said" for _ in range(2)]
    texts += [f"{prose(30)} {k}y" for k in range(200)]
    # Copies of one text are one text, so this name is supported by one only.
    texts += ["Zanzibar wrote from copy@mail.example to us"] * 20
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], SCHEMA)
    assert {r.term for r in pii.revealing_terms(docs).collect()} == {"okonkwo"}
    new = {r.doc_id: r for r in pii.mask(docs).collect()}
    assert pii.mask(docs).columns == docs.columns
    for k, text in enumerate(texts):
        assert "Okonkwo" not in new[k].text and "@" not in new[k].text
        if k >= 8 and "@" not in text:
            assert new[k].text == text
    assert "[EMAIL]" in new[0].text and "[TERM]" in new[7].text
    assert "Zanzibar" in new[len(texts) - 1].text


def test_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None, "", "", ""), (1, "", "", "", ""), (1, "", "", "", ""), (None, "a@b.cc", None, None, None)], SCHEMA)
    assert sorted((r.text for r in pii.mask(docs).collect()), key=repr) == sorted([None, "", "", "[EMAIL]"], key=repr)
    assert pii.find(docs.limit(0)).count() == 0 and pii.mask(docs.limit(0)).count() == 0
    assert pii.masked("abc1.2.3.4def", [(1, 3, 10)]) == "abc[IP]def"
    assert pii.masked("0123456789", [(0, 1, 4), (1, 2, 6), (2, 8, 9)]) == "0[EMAIL]67[CARD]9"


def test_terms_of_a_value_are_removed_and_terms_of_a_kind_generalised(spark):
    random.seed(7)
    # One name beside another address in every text: no address comes twice.
    texts = [f"{prose()} Okafor box{k}@mail{k}.example {prose()}" for k in range(4)]
    texts += [f"{prose(20)} river house wall stone Quillfeather same@mail.example garden letter window spring river {prose(20)}" for k in range(4)]
    # One text is too few.
    texts += [f"{prose()} Lonely once@mail.example {prose()}"]
    texts += [f"{prose(30)} {k}y" for k in range(200)]
    docs = spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], SCHEMA)
    assert {(r.term, r.entity) for r in pii.revealing_terms(docs).collect()} == {("okafor", "email:*"), ("quillfeather", "email:*"), ("quillfeather", "email:same@mail.example")}
    new = {r.doc_id: r.text for r in pii.mask(docs).collect()}
    assert all("[Name] [EMAIL]" in new[k] for k in range(4)) and all("[TERM] [EMAIL]" in new[k] for k in range(4, 8)) and "Lonely" in new[8]
