"""Surrogates against a plain Python version, and their promises one by one."""

import hashlib
import random

import pytest
import regex

from folio.llm import pii

RNG = random.Random(9)


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def plain_feistel(tokens, key, moved):
    half = len(tokens) // 2
    x, y = tokens[:half], tokens[half:]
    for r in range(pii.ROUNDS):
        seed = hashlib.sha256(f"{key}:{r}:{','.join(y)}".encode()).hexdigest()
        x, y = y, [moved(t, int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:12], 16)) for i, t in enumerate(x)]
    return x + y


def plain_moved(ch, amount):
    alphabet = "0123456789" if ch.isdigit() else "abcdefghijklmnopqrstuvwxyz"
    return alphabet[(alphabet.index(ch) + amount) % len(alphabet)]


def plain_octet(x, amount):
    if len(x) > 1 and x[0] == "0":
        return str((int(x) + amount) % (10 if len(x) == 2 else 100)).zfill(len(x))
    return str((int(x) + amount) % 256 if int(x) < 256 else 256 + (int(x) - 256 + amount) % 744)


def plain_recoded(text, key):
    new = iter(plain_feistel([c for c in text if c.isalnum()], key, plain_moved))
    return "".join(next(new) if c.isalnum() else c for c in text)


def luhn(head):
    return -sum(int(d) if i % 2 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(head))) % 10


def plain_draw(kind, unit, attempt, key="k"):
    own = sha(key, kind, attempt)
    if kind.startswith(("family", "given")):
        h = hashlib.sha256(f"{own}|{unit}".encode()).hexdigest()
        script = kind.rsplit("-", 1)[1]
        if kind.startswith("given"):
            names = pii.GIVEN[script, kind[6]]
            if attempt == 0:
                return names[int(h[:12], 16) % len(names)].lower()
        n = min(16, attempt + (4 if kind.startswith("family") else 1))
        own = "".join(pii.SYLLABLES[script][int(h[4 * k : 4 * k + 4], 16) % len(pii.SYLLABLES[script])] for k in range(n))
        return own + (pii.ENDINGS[script, kind[6]] if kind.startswith("given") else "")
    if kind == "ip":
        return ".".join(plain_feistel(unit.split("."), own, plain_octet))
    if kind == "email":
        top = "." + unit.rsplit(".", 1)[1]
        return plain_recoded(unit[: -len(top)], own) + top
    if kind == "phone":
        code = regex.match(pii._COUNTRY, unit).group()
        return code + plain_recoded(unit[len(code) :], own)
    if kind == "card":
        new = plain_recoded(unit[:-1], own)
        return new + str((int(unit[-1]) - luhn(unit[:-1]) + luhn(new)) % 10)
    return plain_recoded(unit, own)


def plain_units(value):
    kind = next(k for k, p in pii.PATTERNS.items() if regex.fullmatch(p, value))
    if kind != "name":
        return [(kind, value.lower() if kind == "email" else value if kind == "ip" else regex.sub(r"[^0-9+]", "", value))]
    _, *names = value.split(" ")
    script = lambda w: "cyrillic" if regex.match(r"\p{IsCyrillic}", w) else "greek" if regex.match(r"\p{IsGreek}", w) else "latin"
    out = [(f"family-{script(names[-1])}", names[-1].lower())]
    if len(names) > 1:
        out.append((f"given-{'f' if regex.match(pii.FEMALE, value) else 'm'}-{script(names[0])}", names[0].lower()))
    return out


def plain_surrogates(units):
    """The draws of all distinct units after the collision check."""
    drawn = {u: (0, plain_draw(*u, 0)) for u in units}
    for attempt in range(1, pii.TRIES + 1):
        first = {}
        for kind, unit in sorted(drawn):
            first.setdefault((kind, drawn[kind, unit][1]), unit)
        clash = [u for u, (_, s) in drawn.items() if (u[0], s) in drawn or first[u[0], s] != u[1]]
        if not clash:
            return {u: s for u, (_, s) in drawn.items()}
        for u in clash:
            drawn[u] = (attempt, plain_draw(*u, attempt))
    raise AssertionError("the fixture has too few free values")


def name_case(word, s):
    return s.upper() if len(word) > 1 and word.upper() == word else s[0].upper() + s[1:]


def plain_replace(texts):
    found = [[m.group() for m in regex.finditer(pii.ANY, t or "")] for t in texts]
    drawn = plain_surrogates({u for own in found for e in own for u in plain_units(e)})
    out = []
    for text, own in zip(texts, found):
        if not own:
            out.append(text)
            continue
        persons = {}
        for kind, unit in sorted({u for e in own for u in plain_units(e)}):
            if kind.startswith(("family", "given")):
                persons.setdefault(unit, drawn[kind, unit])
        bare = lambda gap, persons=persons: regex.sub(rf"(?<![\p{{L}}\p{{M}}]){pii._NAME_WORD}", lambda m: name_case(m.group(), persons[m.group().lower()]) if m.group().lower() in persons else m.group(), gap)
        new, at = "", 0
        for m in regex.finditer(pii.ANY, text):
            value, units = m.group(), plain_units(m.group())
            s = drawn[units[0]]
            if len(units) == 2 or units[0][0].startswith("family"):
                title, *names = value.split(" ")
                s = " ".join([title, *([name_case(names[0], drawn[units[1]])] if len(names) > 1 else []), name_case(names[-1], s)])
            elif units[0][0] == "email":
                s = "".join(b.upper() if a.isupper() else b for a, b in zip(value, s))
            elif units[0][0] != "ip":
                digits = iter(regex.sub("[^0-9]", "", s))
                s = "".join(next(digits) if c in "0123456789" else c for c in value)
            new += bare(text[at : m.start()]) + s
            at = m.end()
        out.append(new + bare(text[at:]))
    return out


WORDS = "the of lumber Smith and to John it Bob".split()
PIECES = [
    "Mr John Smith", "Mr Smith", "Ms Ida Smith", "Frau Müller-Lüdenscheidt", "Г-жа Анна Иванова", "Г-н Иванова", "Mr O'Brien", "MR SMITH", "Mr SMITH", "Monsieur Παπάς", "Herrn. Karl Papa",
    "the.72@mail3.example.com", "Bob+x@Example.org", "bob+x@example.org", "a@b.c", "x@y..z", "+1 (017) 555-7713", "+10175557713", "+49 171 2345678", "+420171234567",
    "169.122.221.182", "010.0.0.1", "00.1.999.300", "1.2.3.4.5", "4111 1111 1111 1111", "4111111111111111", "4952935900253052", "123-45-6789", "123-45-67890",
]


def mixed_texts():
    texts = [" ".join(RNG.choice(PIECES if RNG.random() < 0.4 else WORDS) for _ in range(RNG.randint(1, 14))) for _ in range(80)]
    return [*texts, *PIECES, *(f"Mr {c}{d}ro Olf met Ms {c}{d}na Ulf" for c in "BCDF" for d in "aeiou"), None, "", "plain words", "@ Mr + 12.3"]


def test_surrogates_match_plain_python(spark):
    texts = mixed_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["text"] for r in pii.replace(df, "k").collect()}
    want = plain_replace(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert any(plain_draw(*u, 0) != s for u, s in plain_surrogates({u for t in texts for m in regex.finditer(pii.ANY, t or "") for u in plain_units(m.group())}).items())  # something was drawn again


def test_one_person_has_one_name_and_other_columns_stay(spark):
    texts = ["Mr John Smith met Mr Smith. John Smith left, and so did Johnson.", "card 4111 1111 1111 1111 or 4111111111111111", "a@b.org"]
    rows = [(i, t, "h", "f", ["a"], None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h string, _found string, _again array<string>, found string")
    out = pii.replace(df, "k")
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()))
    assert all(r[2:] == ("h", "f", ["a"], None) for r in got)
    given, family = regex.match(r"Mr (\w+) (\w+) met Mr \2\. \1 \2 left, and so did Johnson\.$", got[0][1]).groups()
    assert given in pii.GIVEN["latin", "m"] and family != "Smith"
    a, b = regex.match(r"card ([\d ]{19}) or (\d{16})$", got[1][1]).groups()
    assert a.replace(" ", "") == b and luhn(b[:-1]) == int(b[-1]) and b != "4111111111111111"
    with pytest.raises(ValueError):
        pii.replace(df, "k", found="found")


def test_full_formats_stay_distinct(spark, monkeypatch):
    monkeypatch.setattr(pii, "TRIES", 2)
    values = [f"{c}@{d}.org" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]  # all there are
    df = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")
    held = df.select("doc_id", pii.F.explode(pii.units(pii.F.col("text"))).alias("u")).select("u.kind", "u.unit")
    assert pii.redrawn(held, "k", tries=2).count() == 0
    assert len({r["text"] for r in pii.replace(df, "k").collect()}) == len(values)


def test_names_outgrow_their_first_space(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])  # 16 family names in the first attempt
    letters = "cdfghjklmn"
    names = [f"{a}o{b}i".capitalize() for a in letters for b in letters]
    df = spark.createDataFrame([(i, f"Mr {n}") for i, n in enumerate(names)], "doc_id long, text string")
    got = [r["text"] for r in pii.replace(df, "k").collect()]
    assert len(set(got)) == len(names) and all(regex.match(r"Mr B[abe]+$", x) for x in got)


def test_long_entities_and_texts(spark):
    texts = ["a@" + "b." * 4000 + "com", "word " * 200_000 + "a@" + "b." * 20_000 + "com Mr Bob", "." * 100_000 + "1" * 100_000]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert all(len(got[i]) == len(texts[i]) and got[i] != texts[i] for i in (0,)) and got[2] == texts[2]
    assert got[1].startswith("word " * 200_000) and got[1].count(".b") < 4000 and not got[1].endswith(" Mr Bob")
