"""Secret scans: base patterns, and two character Markov models compared by log-likelihood ratio.

The models are first-order chains over ALPHABET, one of random strings and one of ordinary ones. They are trained on
labelled samples (`samples`): of about SAMPLE_TEXTS texts of the table, the values of base matches are random and all
other runs of letters, digits and `+/_-` are ordinary, as are identifiers joined from neighbouring words, each string
once; strings of rules (SAMPLES of each label) stand beside them, so that a table without secrets or identifiers gives a
model too. Training is a count of character pairs in Spark; only the table of len(ALPHABET) squared log ratios, in thousandths of a nat, reaches the driver, and it goes into
the plan as a literal. Scanning is one projection of built-in functions: no shuffle, no Python.

Rules for the added kind `markov`, all of them:

1. What a base match covers is left out, and so are UUIDs (8-4-4-4-12 hexadecimal digits, anywhere in a run).
2. Of what is left, a run of `[A-Za-z0-9+/_-]` with up to two `=` behind it is scored if it has LEAST characters.
3. A character that repeats the one before it, and a mark behind a mark, is no evidence for a random string.
4. Log ratios are summed along the run, from 0 again where the sum falls to 0. A stretch ends at the sum's peak once the
   sum has fallen by DROP or to 0, or the run ends; it is reported if the peak is EVIDENCE nats or more. So a secret
   that `/`, `-` or `_` join to ordinary words is found, and so are several in one run.
5. A reported stretch takes in the letters and digits next to it, and `=` behind it.

Nulls and empty texts have no spans; repeated rows get equal results; an empty table gives an empty result; positions
are code points, ends exclusive; spans with one start (ties) stand in the order of KINDS. Other columns pass `scan` and
`mask` by, whatever their names; one with the name of the column that `scan` adds is an error, as nothing is overwritten.
Texts cost time in proportion to their length, also with very many matches; one run costs its length times the stretches
reported of it. The strings that the models learn from are cut to SAMPLE_CHARS characters; what is scanned is not.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.shared import let

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: An equal result for long runs, without listing every short one.
LONG_HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12
RUN = r"[A-Za-z0-9+/_-]{12,}={0,2}"
UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
NO_UUID = "_" * 36
#: In thousandths of a nat.
EVIDENCE, DROP = 16_000, 7_000
#: Bounds of the training sample: strings of rules for each label, texts of the table (about), and characters of a string.
SAMPLES, SAMPLE_TEXTS, SAMPLE_CHARS = 4000, 1000, 64
#: Runs of the sample that are ordinary strings, and words of which every JOINEDth is joined with the next one.
SAMPLE_RUN, SAMPLE_WORD, JOINED = r"[A-Za-z0-9+/_-]{4,}={0,2}", r"[A-Za-z]{3,}", 16
#: ALPHABET's last characters, which aren't letters or digits.
MARKS = 5

VERBS = "get set find load read write make parse build check update remove open close start stop send fetch print merge query verify resize extract".split()
NOUNS = "user name file path token count index value config server client record message request response buffer table column order status session document proxy factory service object key type text json xml job box abstract bean element target window".split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """n random strings (label 1: digests in several alphabets) and n ordinary ones (label 0: identifiers, numbers), from rules."""
    ids = spark.range(n)
    i = F.col("id")

    def pick(items: list[str], at: Column) -> Column:
        return F.get(F.array(*map(F.lit, items)), F.pmod(at, F.lit(len(items))).cast("int"))

    a, b, c = pick(VERBS, i), pick(NOUNS, F.floor(i / len(VERBS))), pick(NOUNS, F.floor(i / 3))
    snake = F.concat_ws("_", a, b, c, b)
    shape = F.pmod(i, F.lit(8))
    digest = F.sha2(F.concat(F.lit("sample"), i.cast("string")), 256)
    figures = F.translate(digest, "abcdef", "")
    ordinary = (
        F.when(shape == 0, F.concat(a, F.initcap(b), F.initcap(c)))
        .when(shape == 1, snake)
        .when(shape == 2, F.concat_ws("-", a, b, c))
        .when(shape == 3, F.concat_ws("/", F.lit("src"), b, c, snake))
        .when(shape == 4, F.concat(F.upper(F.concat_ws("_", b, c)), F.lit("_"), F.pmod(i, F.lit(100))))
        .when(shape == 5, F.concat(a, b, c, F.lit("20"), F.substring(figures, 1, 2)))
        .when(shape == 6, figures)
        .otherwise(F.concat(b, F.lit("-20"), F.substring(figures, 1, 2), F.lit("-0"), F.substring(figures, 3, 1), F.lit("-1"), F.substring(figures, 4, 1)))
    )
    coded = F.base64(F.unhex(digest))
    bare = F.translate(coded, "+/=", "")
    random = (
        F.when(shape < 2, coded)
        .when(shape == 2, F.translate(coded, "+/=", "-_"))
        .when(shape == 3, bare)
        .when(shape == 4, F.upper(F.substring(digest, 1, 40)))
        .when(shape == 5, F.lower(bare))
        .when(shape == 6, F.upper(bare))
        .otherwise(F.translate(coded, "+/=0123456789", ""))
    )
    return ids.select(ordinary.alias("text"), F.lit(0).alias("label")).union(ids.select(random.alias("text"), F.lit(1).alias("label")))


def _joined_words(text: Column) -> Column:
    """Identifiers of neighbouring words of a text, in seven styles by turns."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))

    def joined(words: Column) -> Column:
        def one(k: Column) -> Column:
            a, b, style = F.get(words, k * JOINED), F.get(words, k * JOINED + 1), F.pmod(k, F.lit(7))
            return (
                F.when(style == 0, F.concat(a, capital(b)))
                .when(style == 1, F.concat(capital(a), capital(b)))
                .when(style == 2, F.upper(F.concat_ws("_", a, b)))
                .when(style == 3, F.concat_ws("_", a, b))
                .when(style == 4, F.concat_ws("-", a, b))
                .when(style == 5, F.concat_ws("/", a, b))
                .otherwise(F.concat(a, k.cast("string")))
            )

        return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 2) / JOINED).cast("int")), one)).otherwise(F.slice(words, F.lit(1), F.lit(0)))

    return let(F.regexp_extract_all(text, F.lit(SAMPLE_WORD), F.lit(0)), joined)


def samples(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """text, label: the strings that the table itself gives, each once, and those of rules.

    Texts are drawn by a hash of doc_id and length, so the work is bounded; equal ones of a doc_id are drawn together.
    """
    n = df.count()
    bound = f"{min(2**32 - 1, SAMPLE_TEXTS * 2**32 // max(1, n)):08x}"
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    draw = F.substring(F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.length(body).cast("string"))), 1, 8)
    drawn = df.filter(draw <= bound).select(body.alias("body"))
    parted = drawn.select("body", _base(F.col("body")).alias("base"))
    values = parted.select(F.explode("base").alias("x")).select(F.col("x.value").alias("text"), F.lit(1).alias("label"))
    ordinary = lambda rest: F.concat(F.regexp_extract_all(rest, F.lit(SAMPLE_RUN), F.lit(0)), _joined_words(rest))
    runs = parted.select(F.explode(let(_without(F.col("body"), F.col("base")), ordinary)).alias("text"), F.lit(0).alias("label"))
    own = values.union(runs).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "label").distinct()
    return own.union(labelled_samples(df.sparkSession))


def train(labelled: DataFrame) -> list[int]:
    """1000 * (log P(b|a, random) - log P(b|a, ordinary)) by index(a) * len(ALPHABET) + index(b), add-one smoothed, rule 3 applied."""
    size = len(ALPHABET)
    chars = labelled.select("label", F.filter(F.split("text", ""), lambda c: c != "").alias("c"))
    pairs = chars.select("label", F.explode(F.transform("c", lambda c, i: F.struct(c.alias("a"), F.get(F.col("c"), i + 1).alias("b")))).alias("p"))
    counts = pairs.groupBy("label", F.instr(F.lit(ALPHABET), F.col("p.a")).alias("a"), F.instr(F.lit(ALPHABET), F.col("p.b")).alias("b")).count()
    table = {label: [[1.0] * size for _ in range(size)] for label in (0, 1)}
    for row in counts.filter("a > 0 AND b > 0").collect():  # at most 2 * size^2 rows, whatever the samples' number
        table[row["label"]][row["a"] - 1][row["b"] - 1] += row["count"]
    out = []
    for i in range(size):
        random, ordinary = table[1][i], table[0][i]
        ratios = [round(1000 * (log(random[j] / sum(random)) - log(ordinary[j] / sum(ordinary)))) for j in range(size)]
        out += [min(0, r) if i == j or min(i, j) >= size - MARKS else r for j, r in enumerate(ratios)]
    return out


#: Numbers of an array that are added one after another, and characters of a piece of a text.
STRIDE, PIECE = 256, 4096


def _running(values: Column, combine) -> Column:
    """The running sums, or maxima, of an array of ints, by combine(so far, value), which is associative with 0 as its start.

    An array that grows by a value is copied each time, so values are taken in strides, and then the strides' totals.
    """
    empty = F.from_json(F.lit("[]"), "array<int>")
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
    grown = lambda acc, x: F.concat(acc, F.array(combine(last(acc), x)))

    def strides(own: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / STRIDE).cast("int")), lambda k: F.slice(own, k * STRIDE + 1, F.lit(STRIDE)))
        return let(F.transform(cut, lambda c: F.aggregate(c, empty, grown)), joined)

    def joined(parts: Column) -> Column:
        before = F.aggregate(F.transform(parts, last), F.array(F.lit(0)), grown)  # one more than there are strides
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda p, so_far: F.transform(p, lambda v: combine(so_far, v))))

    return let(values, lambda own: F.when(F.size(own) > 0, strides(own)).otherwise(empty))


def _runs(text: Column, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, end, value (of a group), by code points."""

    def positioned(found: Column) -> Column:
        # found: len and value of each match, with gap, the length of the text between it and the match before
        ends = _running(F.transform(found, lambda x: x["gap"] + x["len"]), lambda a, b: a + b)
        return F.zip_with(found, ends, lambda x, end: F.struct((end - x["len"]).alias("start"), end.alias("end"), x["value"].alias("value")))

    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    found = F.zip_with(
        F.transform(gaps, lambda g: F.length(g)),
        F.arrays_zip(whole.alias("m"), values.alias("v")),
        lambda g, x: F.struct(g.alias("gap"), F.length(x["m"]).alias("len"), x["v"].alias("value")),
    )
    none = F.from_json(F.lit("[]"), "array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), let(found, positioned)).otherwise(none)


_SPAN = "array<struct<start:int,end:int,rank:int,value:string>>"


def _base(body: Column) -> Column:
    """The base matches, as structs start, end, rank (index into KINDS) and value, by start and then by kind."""

    def kept(rows: Column, rank: int, least: int) -> Column:
        return F.transform(F.filter(rows, lambda x: F.length(x["value"]) >= least), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rank).alias("rank"), x["value"].alias("value")))

    found = F.concat(kept(_runs(body, ASSIGN, 2), 0, 8), kept(_runs(body, ACCESS), 1, 16), kept(_runs(body, LONG_HEX), 2, 32))
    return F.array_sort(found, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["rank"] - y["rank"]))


def _over(body: Column, found: Column, mark) -> Column:
    """body with every one of found (by start) replaced by mark(length); those that overlap count as one.

    Text is taken from pieces of PIECE characters, as a place far into a text is found by walking there.
    """
    def part(pieces: Column, start: Column, end: Column) -> Column:
        """The text from start to end."""
        within = lambda k: F.get(pieces, k).substr(F.greatest(start - k * PIECE, F.lit(0)) + 1, F.least(end, (k + 1) * PIECE) - F.greatest(start, k * PIECE))
        held = F.sequence(F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))
        return F.when(end > start, F.array_join(F.transform(held, within), "")).otherwise(F.lit(""))

    def marked(x: Column) -> Column:
        pieces, last = x["pieces"], x["seen"]

        def one(span: Column, k: Column) -> Column:
            at = F.coalesce(F.get(last, k - 1), F.lit(0))  # the end of what is replaced before
            return F.when(span["start"] >= at, F.concat(part(pieces, at, span["start"]), mark(span["end"] - span["start"]))).otherwise(mark(F.greatest(F.lit(0), span["end"] - at), False))

        rest = part(pieces, F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0)), F.length(body))
        return F.concat(F.array_join(F.transform(found, one), ""), rest)

    pieces = F.regexp_extract_all(body, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    seen = _running(F.transform(found, lambda x: x["end"]), F.greatest)
    return F.when(F.size(found) > 0, let(F.struct(pieces.alias("pieces"), seen.alias("seen")), marked)).otherwise(body)


def _without(body: Column, found: Column) -> Column:
    """body with blanks where the base matches stand, its length kept."""
    return _over(body, found, lambda n, first=True: F.repeat(F.lit(" "), n))


def stretches(run: Column, model: list[int], evidence: int = EVIDENCE, drop: int = DROP) -> Column:
    """What rules 3 to 5 report of a run, as structs start, end inside it."""
    table, size = F.lit(model), len(ALPHABET)

    def step(acc: Column, ch: Column) -> Column:
        b = F.instr(F.lit(ALPHABET), ch) - 1
        score = F.when(acc["prev"] >= 0, F.get(table, acc["prev"] * size + b)).otherwise(0)

        def moved(x: Column) -> Column:
            total = x["total"]
            peak, till = F.greatest(acc["peak"], total), F.when(total > acc["peak"], acc["i"] + 1).otherwise(acc["till"])
            ends = (total <= 0) | ((acc["peak"] >= evidence) & (peak - total >= drop))
            found = F.when(ends & (acc["peak"] >= evidence), F.concat(acc["out"], F.array(F.struct(acc["from"].alias("from"), acc["till"].alias("till"))))).otherwise(acc["out"])
            return F.struct(
                (acc["i"] + 1).alias("i"),
                b.alias("prev"),
                F.when(ends, 0).otherwise(total).alias("total"),
                F.when(ends, acc["i"]).otherwise(acc["from"]).alias("from"),
                F.when(ends, 0).otherwise(peak).alias("peak"),
                F.when(ends, acc["i"]).otherwise(till).alias("till"),
                found.alias("out"),
            )

        return let(F.struct((acc["total"] + score).alias("total")), moved)

    none = F.from_json(F.lit("[]"), "array<struct<from:int,till:int>>")
    start = F.struct(*(F.lit(v).alias(k) for k, v in (("i", 0), ("prev", -1), ("total", 0), ("from", 0), ("peak", 0), ("till", 0))), none.alias("out"))
    end = lambda acc: F.when(acc["peak"] >= evidence, F.concat(acc["out"], F.array(F.struct(acc["from"].alias("from"), acc["till"].alias("till"))))).otherwise(acc["out"])

    def grown(x: Column) -> Column:
        before = F.length(F.regexp_extract(F.reverse(run.substr(F.lit(1), x["from"])), "^[A-Za-z0-9]*", 0))
        after = F.length(F.regexp_extract(run.substr(x["till"] + 1, F.length(run)), "^[A-Za-z0-9]*=*", 0))
        return F.struct((x["from"] - before).alias("start"), (x["till"] + after).alias("end"))

    chars = F.filter(F.split(F.regexp_replace(run, UUID, NO_UUID), ""), lambda c: c != "")
    return F.array_distinct(F.transform(F.aggregate(chars, start, step, end), grown))


def spans(text: Column, model: list[int]) -> Column:
    """All spans of a text, as structs start, rank (index into KINDS), end, by start and then by kind."""
    body = F.coalesce(text, F.lit(""))

    def slim(rows: Column) -> Column:
        return F.transform(rows, lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end")))

    def with_base(found: Column) -> Column:
        inside = lambda x: F.transform(stretches(x["value"], model), lambda y: F.struct((x["start"] + y["start"]).alias("start"), F.lit(3).alias("rank"), (x["start"] + y["end"]).alias("end")))
        added = let(_without(body, found), lambda rest: F.flatten(F.transform(_runs(rest, RUN), inside)))
        return F.sort_array(F.concat(slim(found), added))

    return let(_base(body), with_base)


def scan(df: DataFrame, text: str = "text", out: str = "secrets", model: list[int] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """Adds out: the array of spans. The model is trained on df if none is given."""
    if out.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {out} already; name another one to add")
    return df.withColumn(out, spans(F.col(f"`{text}`"), model or train(samples(df, doc_id, text))))


def mask(df: DataFrame, text: str = "text", mark: str = "[SECRET]", model: list[int] | None = None, doc_id: str = "doc_id") -> DataFrame:
    """The same rows with every span of text replaced by mark; spans that overlap become one."""
    body = F.col(f"`{text}`")
    marked = lambda n, first=True: F.lit(mark if first else "")
    return df.withColumn(text, let(spans(body, model or train(samples(df, doc_id, text))), lambda found: _over(body, found, marked)))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan(docs).drop("text")
    count = lambda rank: F.size(F.filter("secrets", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.filter("secrets", lambda x: x["rank"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("secrets")).alias("spans"),
    )


def _found_sql(name: str, pattern: str, group: int = 0, table: str = "t") -> str:
    """Matches of a pattern with their places, as a named subquery."""
    quoted = pattern.replace("'", "''")
    return f"""{name} AS (
  SELECT rid, v, (till - length(m))::BIGINT AS s, till::BIGINT AS e FROM (
    SELECT rid, ms[k] AS m, vs[k] AS v, sum(length(gaps[k]) + length(ms[k])) OVER (PARTITION BY rid ORDER BY k) AS till FROM (
      SELECT rid, ms, vs, gaps, unnest(range(1, len(ms) + 1)) AS k FROM (
        SELECT rid, regexp_extract_all(body, '{quoted}', 0) AS ms, regexp_extract_all(body, '{quoted}', {group}) AS vs, string_split_regex(body, '{quoted}') AS gaps
        FROM {table} WHERE regexp_matches(body, '{quoted}')))))"""


_NAMED = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
_AT = f"instr('{ALPHABET}', "
ORACLE = f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
{_found_sql('f0', ASSIGN, 2)},
{_found_sql('f1', ACCESS)},
{_found_sql('f2', LONG_HEX)},
base AS (SELECT rid, s, e, 0 AS kind, v FROM f0 WHERE length(v) >= 8 UNION ALL SELECT rid, s, e, 1, v FROM f1 WHERE length(v) >= 16 UNION ALL SELECT rid, s, e, 2, v FROM f2),
cuts AS (SELECT rid, s, e, kind, coalesce(max(e) OVER (PARTITION BY rid ORDER BY s, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM base),
parts AS (SELECT rid, string_agg(CASE WHEN s >= seen THEN substr(body, seen + 1, s - seen) || repeat(' ', e - s) ELSE repeat(' ', greatest(0, e - seen)) END, '' ORDER BY s, kind) AS head, max(e) AS till
  FROM cuts JOIN t USING (rid) GROUP BY rid),
bare AS MATERIALIZED (SELECT t.rid, t.doc_id, t.body AS whole, CASE WHEN p.rid IS NULL THEN t.body ELSE p.head || substr(t.body, p.till + 1) END AS body FROM t LEFT JOIN parts p ON p.rid = t.rid),
words AS (SELECT i, {VERBS!r}[i % {len(VERBS)} + 1] AS a, {NOUNS!r}[i // {len(VERBS)} % {len(NOUNS)} + 1] AS b, {NOUNS!r}[i // 3 % {len(NOUNS)} + 1] AS c, sha256('sample' || i) AS d FROM range({SAMPLES}) r(i)),
coded AS (SELECT i, a, b, c, d, to_base64(unhex(d)) AS k, translate(d, 'abcdef', '') AS f, translate(to_base64(unhex(d)), '+/=', '') AS l FROM words),
drawn AS (SELECT rid, body FROM bare WHERE md5(concat(doc_id::VARCHAR, '|', length(whole)))[1:8] <= (SELECT format('{{:08x}}', least(4294967295, {SAMPLE_TEXTS * 2**32} // greatest(1, count(*)))) FROM documents)),
samples AS (
  SELECT 0 AS label, CASE i % 8 WHEN 0 THEN a || upper(b[1]) || b[2:] || upper(c[1]) || c[2:] WHEN 1 THEN a || '_' || b || '_' || c || '_' || b WHEN 2 THEN a || '-' || b || '-' || c
    WHEN 3 THEN 'src/' || b || '/' || c || '/' || a || '_' || b || '_' || c || '_' || b WHEN 4 THEN upper(b || '_' || c) || '_' || (i % 100) WHEN 5 THEN a || b || c || '20' || f[1:2] WHEN 6 THEN f
    ELSE b || '-20' || f[1:2] || '-0' || f[3] || '-1' || f[4] END AS x FROM coded
  UNION ALL SELECT 1, CASE WHEN i % 8 < 2 THEN k WHEN i % 8 = 2 THEN translate(k, '+/=', '-_') WHEN i % 8 = 3 THEN l WHEN i % 8 = 4 THEN upper(d[1:40]) WHEN i % 8 = 5 THEN lower(l) WHEN i % 8 = 6 THEN upper(l)
    ELSE translate(k, '+/=0123456789', '') END FROM coded
  UNION ALL (SELECT DISTINCT label, x[1:{SAMPLE_CHARS}] FROM (SELECT 0 AS label, unnest(regexp_extract_all(body, '{SAMPLE_RUN}')) AS x FROM drawn
    UNION ALL SELECT 0, CASE k % 7 WHEN 0 THEN a || upper(b[1]) || b[2:] WHEN 1 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] WHEN 2 THEN upper(a || '_' || b) WHEN 3 THEN a || '_' || b WHEN 4 THEN a || '-' || b WHEN 5 THEN a || '/' || b ELSE a || k END
      FROM (SELECT k, w[k * {JOINED} + 1] AS a, w[k * {JOINED} + 2] AS b FROM (SELECT w, unnest(range(0, (len(w) - 2) // {JOINED} + 1)) AS k FROM (SELECT regexp_extract_all(body, '{SAMPLE_WORD}') AS w FROM drawn) WHERE len(w) > 1))
    UNION ALL SELECT 1, v FROM base JOIN drawn USING (rid)))),
counted AS (SELECT label, {_AT}x[j]) AS a, {_AT}x[j + 1]) AS b, count(*) AS n FROM (SELECT label, x, unnest(range(1, length(x))) AS j FROM samples) GROUP BY ALL),
grid AS (SELECT l.i AS label, p.i AS a, q.i AS b, 1.0::DOUBLE + coalesce(n, 0) AS n FROM range(2) l(i), range(1, {len(ALPHABET) + 1}) p(i), range(1, {len(ALPHABET) + 1}) q(i) LEFT JOIN counted c ON c.label = l.i AND c.a = p.i AND c.b = q.i),
share AS (SELECT label, a, b, ln(n / sum(n) OVER (PARTITION BY label, a)) AS p FROM grid),
ratio AS MATERIALIZED (SELECT x.a, x.b, CASE WHEN x.a = x.b OR least(x.a, x.b) > {len(ALPHABET) - MARKS} THEN least(0, round(1000 * (x.p - y.p))::BIGINT) ELSE round(1000 * (x.p - y.p))::BIGINT END AS r FROM share x JOIN share y ON x.a = y.a AND x.b = y.b AND x.label = 1 AND y.label = 0),
{_found_sql('f3', RUN, table='bare')},
letters AS (SELECT rid, s, j, {_AT}m[j]) AS a, {_AT}m[j + 1]) AS b FROM (SELECT rid, s, regexp_replace(v, '{UUID}', '{NO_UUID}', 'g') AS m, unnest(range(1, length(v))) AS j FROM f3)),
scored AS (SELECT rid, s, j, r, sum(r) OVER (PARTITION BY rid, s ORDER BY j) AS p FROM letters JOIN ratio USING (a, b)),
hopeful AS (SELECT rid, s FROM (SELECT rid, s, p - least(0, min(p) OVER (PARTITION BY rid, s ORDER BY j)) AS rise FROM scored) GROUP BY ALL HAVING max(rise) >= {EVIDENCE}),
steps AS MATERIALIZED (SELECT rid, s, j, r FROM scored JOIN hopeful USING (rid, s)),
walk AS (
  SELECT rid, s, 0 AS j, 0::BIGINT AS total, 0 AS since, 0::BIGINT AS peak, 0 AS till, NULL::INTEGER AS f, NULL::INTEGER AS g FROM hopeful
  UNION ALL
  SELECT rid, s, j, CASE WHEN ends THEN 0 ELSE x END, CASE WHEN ends THEN j ELSE since END, CASE WHEN ends THEN 0 ELSE greatest(peak, x) END, CASE WHEN ends THEN j WHEN x > peak THEN j + 1 ELSE till END,
    CASE WHEN ends AND peak >= {EVIDENCE} THEN since END, CASE WHEN ends AND peak >= {EVIDENCE} THEN till END
  FROM (SELECT w.rid, w.s, k.j::INTEGER AS j, w.total + k.r AS x, w.since, w.peak, w.till, (w.total + k.r <= 0 OR (w.peak >= {EVIDENCE} AND greatest(w.peak, w.total + k.r) - w.total - k.r >= {DROP})) AS ends
    FROM walk w JOIN steps k ON k.rid = w.rid AND k.s = w.s AND k.j = w.j + 1)),
ended AS (SELECT rid, s, f, g FROM walk WHERE f IS NOT NULL
  UNION ALL SELECT rid, s, since, till FROM walk w WHERE peak >= {EVIDENCE} AND NOT EXISTS (SELECT 1 FROM steps k WHERE k.rid = w.rid AND k.s = w.s AND k.j = w.j + 1)),
grown AS (SELECT DISTINCT rid, s + f - length(regexp_extract(reverse(v[1:f]), '^[A-Za-z0-9]*')) AS s, s + g + length(regexp_extract(substr(v, g + 1), '^[A-Za-z0-9]*=*')) AS e FROM ended JOIN f3 USING (rid, s)),
spans AS (SELECT rid, s, e, kind FROM base UNION ALL SELECT rid, s, e, 3 FROM grown),
g AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  string_agg({_NAMED}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg({_NAMED}[kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN g USING (rid)
"""
