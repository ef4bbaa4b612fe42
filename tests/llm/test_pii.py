"""Personal data against the patterns as written, and terms that reveal an entity."""

import hashlib
import random
import re

from featuremill.llm.pii import KINDS, entities, find_personal_data, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return (sum(d[::2]) + sum(2 * x - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def brute(t):
    n = lambda m: sum(c in "0123456789" for c in m[0])
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 12 <= n(m) <= 19 and luhn(m[0])]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 9 <= n(m) <= 15]
    return sorted(out)


def test_patterns():
    rng = random.Random(2)
    pieces = ["a", "b_", "%", "@", ".", "-", "+", " ", "1", "25", "256", "4111 1111 1111 1111", "ü", "(", ")", "\n", "00", "x@y.zz", "10.0.0.1"]
    for _ in range(5000):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        assert entities(t) == brute(t), t
    assert len(entities("a@b.c_d@e.f")) == 2
    long = "1" * 200_000 + "." + "a." * 50_000 + "a@" * 100_000
    assert entities(long) == []


def test_terms_that_reveal(spark):
    rows = [(k, f"The member {w} wrote from Zanzibar to joe@mail.org about nothing in particular today {k}") for k, w in enumerate(["one", "two", "six", "ten"])]
    rows += [(10 + k, f"A letter about nothing in particular wrote the member today {k}") for k in range(20)]
    rows += [(40, "secretword only@here.org"), (41, "secretword only@here.org"), (42, None), (42, None), (None, "+49 30 1234567")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, terms int")
    got = find_personal_data(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    text = dict(rows)
    terms = {text[0][x.start : x.end].lower() for x in by[0].terms}
    assert "zanzibar" in terms and "nothing" not in terms and "wrote" not in terms
    assert all(by[k].terms is None for k in (10, 40, 41, 42))
    for i, t in rows:
        spans = brute(t or "")
        assert by[i].base_sha256 == hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
    clean = {r.doc_id: r.text for r in sanitise(docs).collect()}
    assert "Zanzibar" not in clean[0] and "[email]" in clean[0] and clean[10] == text[10] and clean[42] is None
    assert find_personal_data(docs.limit(0)).count() == 0


def test_terms_of_an_entity_in_one_text(spark):
    rows = [(k, f"some common words stand in every letter about the weather {k}") for k in range(300)]
    rows += [(500, "some common words about Quillfeather and one@only.org in the weather")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.terms for r in find_personal_data(docs).collect()}
    assert [rows[-1][1][x.start : x.end] for x in got[500] if x.end - x.start > 3] == ["Quillfeather"]
    assert all(v is None for k, v in got.items() if k != 500)


def test_terms_far_from_the_entity_and_in_other_documents(spark, monkeypatch):
    from featuremill.llm import sieve

    rows = [(k, f"some common words stand in every letter about the weather {k}") for k in range(1500)]
    far = "Bo Quillfeather " + "some common words " * 20 + "two@only.org"
    rows += [(5000, far), (5001, "the letter says Quillfeather and some words"), (None, far)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (sieve.SIEVE_BITS, 8):
        monkeypatch.setattr(sieve, "SIEVE_BITS", bits)
        got = {r.doc_id: r for r in find_personal_data(docs).collect()}
        marked = {k: [(rows[1500 + i][1][x.start : x.end], x.start) for x in got[k].terms] for i, k in enumerate((5000, 5001, None))}
        assert marked == {5000: [("Bo", 0), ("Quillfeather", 3)], None: [("Bo", 0), ("Quillfeather", 3)], 5001: [("Quillfeather", 16)]}


def test_disclosure_against_brute_force(spark):
    """Random texts with copies, repeated rows, several entities in a text and entities of several texts."""
    import math

    from featuremill.llm.pii import DISCLOSE, SURE, _words, free_words

    rng = random.Random(5)
    mails = [f"p{k}@mail{k % 3}.org" for k in range(12)]
    rows = []
    for k in range(1200):
        ws = [f"w{int(rng.paretovariate(0.7)) % 3000}" for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.05:
            ws += rng.sample(mails, rng.randrange(1, 3))
        rng.shuffle(ws)
        rows.append((k, " ".join(ws)))
    rows += [(2000 + k, rows[rng.randrange(300)][1]) for k in range(400)] + rows[:20] + [(None, rows[7][1]), (None, None)]
    texts = {t or "" for _, t in rows}
    n = len(texts)
    held = {t: {f"{k}:{t[s:e]}" for s, k, e in entities(t)} for t in texts}
    terms = {t: {w for w, _, _ in free_words(t, entities(t))} for t in texts}
    df = {}
    for t in texts:
        for w in _words(t):
            df[w] = df.get(w, 0) + 1
    disclosure = {}
    for e in {e for x in held.values() for e in x}:
        inside = [t for t in texts if e in held[t]]
        for w in {w for t in inside for w in terms[t]}:
            both = sum(w in terms[t] for t in inside)
            told = math.log(both * n / (len(inside) * (df[w] + 1))) / math.log(n / len(inside))
            if df[w] + 1 <= SURE * both:
                disclosure[w] = max(told, disclosure.get(w, 0))
    found = {w for w, x in disclosure.items() if x >= DISCLOSE}
    assert 5 < len(found) < len(df)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = find_personal_data(docs).collect()
    assert len(got) == len(rows)
    want = {(i, tuple((s, e) for w, s, e in free_words(t or "", entities(t or "")) if w in found)) for i, t in rows}
    assert {(r.doc_id, tuple((x.start, x.end) for x in r.terms or [])) for r in got} == want


def test_long_digit_runs():
    assert entities("1.2.3." + "0" * 5000 + "1") == [(0, 1, 5007)]
    assert entities("1.2.3." + "9" * 5001) == []
    assert entities("+" + "1" * 5000) == []


def test_planted_terms_are_found_and_rare_words_of_other_texts_are_not(spark):
    """Names that stand with an entity only are marked; rare words that stand beside it once, but in other texts, too, are not."""
    rng = random.Random(11)
    common = [f"c{k}" for k in range(300)]
    rows, names, rare = [], [], []
    for k in range(60):
        names.append(f"name{k}")
        own = [f"{names[-1]} wrote to person{k}@mail.org " + " ".join(rng.sample(common, 20)) for _ in range(rng.randrange(1, 4))]
        rare.append(f"rare{k}")
        own[0] += f" {rare[-1]}"
        rows += own + [f"{rare[-1]} " + " ".join(rng.sample(common, 20)) for _ in range(rng.randrange(2, 5))]
    rows += [" ".join(rng.sample(common, 20)) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    marked = {rows[r.doc_id][x.start : x.end] for r in find_personal_data(docs).collect() for x in r.terms or []}
    assert set(names) <= marked and not marked & set(rare) and not marked & set(common)
