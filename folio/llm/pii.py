"""Personal data: surrogate generation.

Detected entities are replaced by keyed surrogates of the same type and format. An entity consists of units, and a unit
is drawn by itself, so whatever mentions it gets the same surrogate in every document (coreference):

* addresses of mail (case aside), phone, social security and card numbers (digits alone, so spacing doesn't matter) and
  network addresses pass a Feistel network of ROUNDS rounds over their letters, digits or octets, whose shifts are
  SHA-256 of the key and the other half. It is a bijection on each format: marks, top-level domains and country codes
  stay, octets keep their zero padding, and a card's last digit keeps its distance from the valid check digit.
* a name keeps its title; its family name and its given name are units of their own. A given name comes from a list by
  gender (as the title says) and script, a family name is composed of syllables of the script, both drawn by SHA-256 of
  the key and the unit. `Mr John Smith` and `Mr Smith` therefore share a family name. Where a text has a name with a
  title, its capitalised words that equal that given or family name are replaced too.

Collision check: over the distinct units of the whole table, a surrogate that is itself a unit of the table, or that two
units share, is drawn again with the next attempt, until none is left. Attempts of names have more syllables each time,
so their space outgrows any table. A format without free values left (say, all two-letter addresses of one domain stand
in the table) returns to its first attempt, which is a bijection: distinct units stay distinct, though a surrogate is
then another's unit. Only units that were drawn again are looked up by join; all others are computed in place.

All work is built-in functions. Texts are searched once to stage the rows with entities, with numbers of their own, and
once more to pass the others by; patterns are possessive, so time and stack don't grow faster than the text. In a text
with names, each of its words is compared with those names that stand there without a title too.

Nulls stay null, empty texts empty; repeated rows get equal results; equal surrogates (ties) go to the unit first by code
point; an empty table gives an empty result; other columns pass `replace` by, whatever their names. Row order isn't kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.llm.shared import discard, let, staged

_TITLE = r"(?:Mrs?|Ms|Miss|Herrn?|Frau|Monsieur|Madame|Señora?|Г-н|Г-жа)\.?"
_NAME_WORD = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]++(?:-\p{Lu}[\p{L}\p{M}]++)*+"
#: Kinds in the order in which they are tried at one place. Repeats of groups are possessive: others recurse once a repeat.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "name": rf"(?<!\p{{L}}){_TITLE}\x20{_NAME_WORD}(?:\x20{_NAME_WORD})?",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What a text with an entity holds; much faster to look for than the entities.
_SIGNS = ("@", "Mr", "Ms", "Miss", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Г-н", "Г-жа")
_DIGITS = r"[0-9](?:[.-][0-9]|[0-9]{3})|\+[0-9]"
ROUNDS = 8
#: Draws before a format counts as full. Names have room long before.
TRIES = 16
#: Parts into which the units of documents are dealt when they are joined with those drawn again.
SALTS = 16
#: Syllables of a family name in its first attempt, and the most that one SHA-256 gives.
LEAST_SYLLABLES, MOST_SYLLABLES = 4, 16
#: Country codes of one and two digits, as the numbering plan assigns them; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"
#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    ("latin", "f"): "Alma Berta Clara Dora Elsa Frida Greta Hanna Ida Julia Karin Lena Mara Nora Olga Paula".split(),
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leo Max Nils Oscar Paul".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Лидия Мария".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Иван Лев Олег".split(),
    ("greek", "f"): "Άννα Δάφνη Ελένη Ζωή Ίρις Μαρία Νίκη Σοφία".split(),
    ("greek", "m"): "Άρης Δήμος Ηλίας Θάνος Λουκάς Νίκος Πέτρος Στέλιος".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li lo ma me mi mo na ne no ra re ri ro sa se ta te va".split(),
    "cyrillic": "ба бе во га да де за ка ке ла ле ли ма ми мо на не но ра ре ри ро са се си та те ти ва ви зо па".split(),
    "greek": "βα βε γα δα δε ζα ζο κα κε λα λε λι μα με μι μο να νε νι ρα ρε ρι ρο σα σε τα τε τι φα φο χα χο".split(),
}
#: Endings of composed given names, by script and gender.
ENDINGS = {("latin", "f"): "na", ("latin", "m"): "don", ("cyrillic", "f"): "на", ("cyrillic", "m"): "дон", ("greek", "f"): "να", ("greek", "m"): "δος"}
FEMALE = r"^(?:Mrs|Ms|Miss|Frau|Madame|Señora|Г-жа)"
_LETTERS, _FIGURES = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_NONE = "array<string>"


def kind_of(value: Column) -> Column:
    kind = F.lit("card")
    for name in ("ssn", "phone", "ip", "name", "email"):
        kind = F.when(value.rlike(f"^(?:{PATTERNS[name]})$"), F.lit(name)).otherwise(kind)
    return kind


def _empty() -> Column:
    return F.from_json(F.lit("[]"), _NONE)


# --- draws -----------------------------------------------------------------------------------------------------------


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _moved(ch: Column, amount: Column) -> Column:
    """A small letter or digit moved by amount inside its alphabet."""
    letter, figure = F.instr(F.lit(_LETTERS), ch), F.instr(F.lit(_FIGURES), ch)
    in_letters = F.lit(_LETTERS).substr(F.pmod(letter - 1 + amount, F.lit(26)).cast("int") + 1, F.lit(1))
    return F.when(letter > 0, in_letters).otherwise(F.lit(_FIGURES).substr(F.pmod(figure - 1 + amount, F.lit(10)).cast("int") + 1, F.lit(1)))


def _moved_octet(x: Column, amount: Column) -> Column:
    """An octet moved inside its class: 0 to 255, two or three digits with a leading zero, or 256 to 999."""
    value, padded = x.cast("int"), x.rlike("^0[0-9]")
    least = F.when(~padded & (value > 255), 256).otherwise(0)
    size = F.when(padded, F.when(F.length(x) == 2, 10).otherwise(100)).when(value > 255, 744).otherwise(256)
    plain = (least + F.pmod(value - least + amount, size)).cast("string")
    return F.when(padded, F.lpad(plain, F.length(x), "0")).otherwise(plain)


def _feistel(tokens: Column, key: Column, moved) -> Column:
    """tokens (an array) with every one moved by amounts that depend on the key and, over the rounds, on all others."""

    def step(acc: Column, r: Column) -> Column:
        seed = F.sha2(F.concat_ws(":", key, r.cast("string"), F.array_join(acc["y"], ",")), 256)
        fresh = let(seed, lambda h: F.transform(acc["x"], lambda t, i: moved(t, _number(F.substring(F.sha2(F.concat_ws(":", h, i.cast("string")), 256), 1, 12)))))
        return F.struct(acc["y"].alias("x"), fresh.alias("y"))

    def run(t: Column) -> Column:
        half = F.floor(F.size(t) / 2).cast("int")
        start = F.struct(F.slice(t, F.lit(1), half).alias("x"), F.slice(t, half + 1, F.size(t) - half).alias("y"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda acc: F.concat(acc["x"], acc["y"]))

    return let(tokens, run)


def _filled(gaps: Column, new: Column) -> Column:
    """Gaps and what stands between them, as one string; there is one gap more."""
    return F.array_join(F.zip_with(gaps, new, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")


def _recoded(text: Column, key: Column) -> Column:
    """Letters and digits enciphered, marks in their places."""
    return _filled(F.split(text, "[a-z0-9]", -1), _feistel(F.regexp_extract_all(text, F.lit("[a-z0-9]"), F.lit(0)), key, _moved))


def _check_digit(digits: Column) -> Column:
    """The digit that makes a card number of digits valid."""
    figures = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("[0-9]"), F.lit(0)), lambda d, i: F.when(i % 2 == 1, d.cast("int")).otherwise(F.lit("0246813579").substr(d.cast("int") + 1, F.lit(1)).cast("int")))
    return F.pmod(-F.aggregate(figures, F.lit(0), lambda acc, x: acc + x), F.lit(10))


def _by_kind(kind: Column, table: dict[str, list[str]]) -> Column:
    """The list that belongs to a kind."""
    items = F.lit("")
    for name, own in table.items():
        items = F.when(kind == name, F.lit(" ".join(own))).otherwise(items)
    return F.split(items, " ")


def _pick(items: Column, n: Column) -> Column:
    return F.get(items, F.pmod(n, F.size(items)).cast("int"))


def _named(kind: Column, digest: Column, attempt: Column) -> Column:
    """A name's surrogate in small letters, drawn by a SHA-256."""
    names = [(f"given-{gender}-{script}", script, gender) for script, gender in GIVEN]
    syllables = _by_kind(kind, {f"family-{x}": own for x, own in SYLLABLES.items()} | {name: SYLLABLES[script] for name, script, _ in names})
    given = _by_kind(kind, {name: GIVEN[script, gender] for name, script, gender in names})
    ending = F.get(_by_kind(kind, {name: [ENDINGS[script, gender]] for name, script, gender in names}), F.lit(0))
    count = F.least(attempt + F.when(kind.startswith("family"), LEAST_SYLLABLES).otherwise(1), F.lit(MOST_SYLLABLES))
    composed = let(syllables, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda k: _pick(s, _number(digest.substr(k * 4 + 1, F.lit(4))))), ""))
    listed = let(given, lambda g: F.lower(_pick(g, _number(F.substring(digest, 1, 12)))))
    return F.when(kind.startswith("given") & (attempt == 0), listed).otherwise(F.concat(composed, ending))


def draw(kind: Column, unit: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a unit (as of `units`) in an attempt, in small letters and without spacing."""
    own = F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string")), 256)

    def drawn(k: Column) -> Column:
        before = F.when(kind == "phone", F.regexp_extract(unit, _COUNTRY, 0)).otherwise(F.lit(""))
        after = F.when(kind == "email", F.regexp_extract(unit, r"(\.[a-z0-9-]+)$", 1)).when(kind == "card", F.right(unit, F.lit(1))).otherwise(F.lit(""))
        core = unit.substr(F.length(before) + 1, F.length(unit) - F.length(before) - F.length(after))

        def joined(parts: Column) -> Column:
            new = parts["new"]
            last = F.pmod(parts["after"].cast("int") - _check_digit(parts["core"]) + _check_digit(new), F.lit(10)).cast("string")
            return F.concat(parts["before"], new, F.when(kind == "card", last).otherwise(parts["after"]))

        coded = let(F.struct(before.alias("before"), core.alias("core"), after.alias("after")), lambda p: F.struct(p["before"].alias("before"), p["core"].alias("core"), p["after"].alias("after"), _recoded(p["core"], k).alias("new")))
        octets = F.array_join(_feistel(F.split(unit, r"\."), k, _moved_octet), ".")
        out = F.when(kind == "ip", octets).otherwise(let(coded, joined))
        return F.when(kind.rlike("^(family|given)-"), let(F.sha2(F.concat_ws("|", k, unit), 256), lambda h: _named(kind, h, attempt))).otherwise(out)

    return let(own, drawn)


# --- entities and their units ----------------------------------------------------------------------------------------


def holds_entity(text: Column) -> Column:
    body = F.coalesce(text, F.lit(""))
    sign = body.rlike(_DIGITS)
    for word in _SIGNS:
        sign = body.contains(word) | sign
    return sign & body.rlike(ANY)


def entities(text: Column) -> Column:
    """All entities of a text, leftmost first, not overlapping."""
    return F.when(holds_entity(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(_empty())


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def units(value: Column) -> Column:
    """The units of an entity as structs kind, unit: the family name before the given one, or a single one."""

    def of_names(parts: Column) -> Column:
        gender = F.when(value.rlike(FEMALE), "f").otherwise("m")
        family = F.lower(F.element_at(parts, -1))
        own = F.struct(F.concat(F.lit("family-"), _script(family)).alias("kind"), family.alias("unit"))
        given = F.lower(F.element_at(parts, 2))
        return F.when(F.size(parts) == 2, F.array(own)).otherwise(F.array(own, F.struct(F.concat(F.lit("given-"), gender, F.lit("-"), _script(given)).alias("kind"), given.alias("unit"))))

    def by_kind(kind: Column) -> Column:
        plain = F.when(kind == "email", F.lower(value)).when(kind == "phone", F.concat(F.lit("+"), F.regexp_replace(value, "[^0-9]", ""))).when(kind == "ip", value).otherwise(F.regexp_replace(value, "[^0-9]", ""))
        return F.when(kind == "name", let(F.split(value, r"\x20"), of_names)).otherwise(F.array(F.struct(kind.alias("kind"), plain.alias("unit"))))

    return let(kind_of(value), by_kind)


def _dressed_name(word: Column, surrogate: Column) -> Column:
    """A name's surrogate in the case of word."""
    return F.when((F.length(word) > 1) & (F.upper(word) == word), F.upper(surrogate)).otherwise(F.initcap(surrogate))


def dressed(value: Column, surrogates: Column) -> Column:
    """The surrogates of an entity's units in the format of its text."""
    first, kind = F.element_at(surrogates, 1), kind_of(value)
    by_digit = _filled(F.split(value, "[0-9]", -1), F.regexp_extract_all(first, F.lit("[0-9]"), F.lit(0)))
    chars = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    cased = F.array_join(F.zip_with(chars(value), chars(first), lambda v, s: F.when(v.rlike("[A-Z]"), F.upper(s)).otherwise(s)), "")

    def named(parts: Column) -> Column:
        family = _dressed_name(F.element_at(parts, -1), first)
        given = F.when(F.size(parts) > 2, F.concat(_dressed_name(F.element_at(parts, 2), F.get(surrogates, F.lit(1))), F.lit(" "))).otherwise(F.lit(""))
        return F.concat(F.get(parts, F.lit(0)), F.lit(" "), given, family)

    return let(kind, lambda k: F.when(k == "name", let(F.split(value, r"\x20"), named)).when(k == "ip", first).when(k == "email", F.when(F.lower(value) == value, first).otherwise(cased)).otherwise(by_digit))


# --- the collision check ---------------------------------------------------------------------------------------------


def _format(kind: Column, unit: Column) -> Column:
    """The format on which a draw is a bijection."""
    kept = F.when(kind == "email", F.regexp_extract(unit, r"(\.[a-z0-9-]+)$", 1)).when(kind == "phone", F.regexp_extract(unit, _COUNTRY, 0)).otherwise(F.lit(""))
    shape = F.regexp_replace(F.regexp_replace(unit, "[a-z]", "a"), "[0-9]", "0")
    return F.concat_ws("|", kind, F.when(kind == "ip", F.lit("")).otherwise(shape), kept)


def redrawn(distinct: DataFrame, key: str, tries: int = TRIES) -> DataFrame:
    """kind, unit, surrogate of the units whose first surrogate met another unit or surrogate; distinct: kind and unit."""
    fresh = lambda attempt: draw(F.col("kind"), F.col("unit"), key, attempt)
    current = staged(distinct.select("kind", "unit", F.lit(0).alias("attempt"), fresh(F.lit(0)).alias("surrogate")), "pii-drawn")
    for attempt in range(1, tries + 2):
        # every surrogate's first owner keeps it, unless it is a unit itself
        claims = current.select("kind", F.col("surrogate").alias("word"), F.col("unit").alias("owner"), F.lit(False).alias("real")).union(current.select("kind", "unit", "unit", F.lit(True)))
        taken = claims.groupBy("kind", "word").agg(F.min(F.when(~F.col("real"), F.col("owner"))).alias("first"), F.max("real").alias("real"), F.count("*").alias("n")).filter("n > 1")
        clash = staged(current.withColumnRenamed("surrogate", "word").join(taken, ["kind", "word"]).filter(F.col("real") | (F.col("unit") != F.col("first"))).select("kind", "unit", F.lit(True).alias("again")), "pii-clash")
        if clash.isEmpty():
            discard(clash)
            break
        if attempt <= tries:
            drawn = current.join(clash, ["kind", "unit"], "left")
            nxt = drawn.select("kind", "unit", F.when(F.col("again"), attempt).otherwise(F.col("attempt")).alias("attempt"), F.when(F.col("again"), fresh(F.lit(attempt))).otherwise(F.col("surrogate")).alias("surrogate"))
        else:  # formats without free values return to the bijection
            full = clash.filter(~F.col("kind").rlike("^(family|given)-")).select(_format(F.col("kind"), F.col("unit")).alias("format")).distinct().withColumn("again", F.lit(True))
            drawn = current.withColumn("format", _format(F.col("kind"), F.col("unit"))).join(full, "format", "left")
            nxt = drawn.select("kind", "unit", F.when(F.col("again"), 0).otherwise(F.col("attempt")).alias("attempt"), "surrogate")
        nxt = staged(nxt, "pii-drawn")
        discard(current)
        discard(clash)
        current = nxt
    return current.filter("attempt > 0").select("kind", "unit", "surrogate")


# --- replacing -------------------------------------------------------------------------------------------------------


def _untitled(gap: Column, persons: Column) -> Column:
    """A stretch between entities with the words replaced that name persons (structs unit, surrogate)."""
    pattern = rf"(?<![\p{{L}}\p{{M}}]){_NAME_WORD}"
    words = F.regexp_extract_all(gap, F.lit(pattern), F.lit(0))

    def replaced(found: Column) -> Column:
        met = F.array_intersect(F.transform(found, lambda w: F.lower(w)), F.transform(persons, lambda p: p["unit"]))

        def filled(here: Column) -> Column:
            new = F.transform(found, lambda w: F.when(F.array_contains(here, F.lower(w)), _dressed_name(w, F.get(F.filter(persons, lambda p: p["unit"] == F.lower(w)), F.lit(0))["surrogate"])).otherwise(w))
            return F.when(F.size(here) > 0, _filled(F.split(gap, pattern, -1), new)).otherwise(gap)

        return let(met, filled)

    return let(words, replaced)


def replace(df: DataFrame, key: str, text: str = "text", found: str | None = None) -> DataFrame:
    """df with every entity of text replaced; with the column found, the entities that stood there.

    The key is the caller's secret: who has it can draw the same surrogates again. found may not name a column of df.
    """
    if found in df.columns:
        raise ValueError(f"{found} is a column already")
    columns = [F.col(f"`{c}`") for c in df.columns]
    body = F.col(f"`{text}`")
    seen = df.filter(holds_entity(body)).select(F.struct(*columns).alias("row"), entities(body).alias("found"))
    marked = staged(seen.withColumn("units", F.transform("found", units)).withColumn("id", F.monotonically_increasing_id()), "pii-marked")
    held = marked.select("id", F.explode(F.array_distinct(F.flatten("units"))).alias("u")).select("id", "u.kind", "u.unit")
    again = redrawn(held.select("kind", "unit").distinct(), key)
    salted = again.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    maps = held.withColumn("salt", F.pmod("id", F.lit(SALTS)).cast("int")).join(salted, ["kind", "unit", "salt"])
    maps = maps.groupBy("id").agg(F.collect_list(F.struct("kind", "unit", "surrogate")).alias("again"))  # a document's own units
    rows = marked.join(maps, "id", "left")

    def drawn(u: Column) -> Column:
        other = F.get(F.filter(F.col("again"), lambda x: (x["kind"] == u["kind"]) & (x["unit"] == u["unit"])), F.lit(0))["surrogate"]
        return F.coalesce(other, draw(u["kind"], u["unit"], key, F.lit(0)))

    new = F.transform(F.arrays_zip("found", "units"), lambda x: dressed(x["found"], F.transform(x["units"], drawn)))
    named = F.array_sort(F.array_distinct(F.filter(F.flatten("units"), lambda u: u["kind"].rlike("^(family|given)-"))))
    persons = F.transform(named, lambda u: F.struct(u["unit"].alias("unit"), drawn(u).alias("surrogate")))
    gaps = F.split(F.col("row")[text], ANY, -1)
    gaps = let(persons, lambda p: F.when(F.size(p) > 0, F.transform(gaps, lambda g: _untitled(g, p))).otherwise(gaps))
    own = [(_filled(gaps, new) if c == text else F.col("row")[c]).alias(c) for c in df.columns]
    others = df.filter(~holds_entity(body)).select(*columns, *([_empty().alias(found)] if found else []))
    return others.union(rows.select(*own, *([F.col("found").alias(found)] if found else [])))


#: For the query alone; a user brings a key of their own.
QUERY_KEY = "an example key"


def op8_surrogates(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = replace(docs, QUERY_KEY, found="found")
    count = lambda kind: F.size(F.filter("found", lambda x: kind_of(x) == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(count, PATTERNS), "text")
