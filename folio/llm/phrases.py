"""Phrase collocations by vertical inverted lists of positions.

Texts become blocks of words of one language: a block numbers its words by position, with a gap between pieces, and keeps
a posting of each position. A phrase's inverted list holds the positions at which it starts; its length is the phrase's
frequency in the block, and the sum over blocks the exact frequency. Lists of k words are extended to k + 1 by a
merge-join of their positions, k further, with the postings of adjacent words; only where the phrase's tail is itself live
one position on.

Phrases that may be frequent are told from others in two steps a level. Blocks send a hash and a length of each
extended list, and hashes that reach the threshold set bits in a sieve of bounded size, which is broadcast: the wider the
table, the more lists pass it, but none that is frequent is stopped. Lists that pass are stored with their phrases, and
frequencies are then counted by language and phrase in full, in packs. Postings that no live list covers are dropped, so later
levels read little. A block holds so many words that its lists fit a worker, whatever its documents' lengths, and a phrase
of all documents is one row a block in the shuffle. Blocks are packed before they leave a worker and stored a few a file, as
Spark reads a file's rows some thousands at once; workers unpack one at a time.

Scores come from joins of a phrase with its first and last parts, which are frequent too, in decimals that hold all
products. A phrase is dropped if one of the next length that holds it has its frequency, as any longer one then has too.

Null texts are empty; null languages are `und`; texts without words and empty tables add nothing. Repeated rows count each
time. Ties stand by frequency, then phrase, by bytes. Very long texts go on in the next block at the end of a piece. Words
may hold any other character, zeros too. Extra columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import discard, staged

LEAST, LONGEST, BEST = 100, 5, 2000
#: Words that a task holds before it closes its open blocks, of whatever languages.
BLOCK = 400_000
#: Bits of a sieve, at most, as a power of two, and bits a hash that sets one.
SIEVE_BITS, BITS_A_HASH = 28, 64
#: Bits of a hash: fewer of them make the shuffle smaller, and let some lists pass that aren't frequent.
HASH_BITS = 48

_ENDS = re.compile(rb"[.,;:!?\x0A-\x0D]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)

#: words: the words of codes, joined by line ends, which no word holds; steps and codes: the postings, by position, as
#: distances, which compress well;
#: lists: the live lists' positions, one list after another, and sizes: the lists' lengths; phrases: their phrases, joined
#: likewise. All binaries are packed.
BLOCKS = "lang string, n long, words binary, steps binary, codes binary, phrases binary, sizes binary, lists binary"
_BLOCKS = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in BLOCKS.split(", ")])
#: Blocks of a file, at most.
A_FILE = 8


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True) if data else b""


def _unpack(data: bytes) -> bytes:
    return pa.decompress(pa.py_buffer(data)[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True) if data else b""


def _block(**row) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{c: _pack(x) if isinstance(x, bytes) else x for c, x in row.items()}], _BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch], read=_unpack) -> Iterator[dict]:
    """Rows one at a time, with their binaries unpacked."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {c: read(x) if isinstance(x, bytes) else x for c, x in batch.slice(at, 1).to_pylist()[0].items()}


def blocks(documents: DataFrame, text: str = "text", lang: str = "lang", most: int = BLOCK) -> DataFrame:
    """The documents' words as blocks, without lists."""

    def closed(name: str, known: dict, codes: array, bounds: array) -> pa.RecordBatch:
        sizes = np.diff(np.array([0, *bounds]))
        gaps = np.repeat(np.arange(len(sizes)), sizes)  # a free position behind each piece
        return _block(lang=name, n=len(codes), words=b"\n".join(known), steps=_steps(np.arange(len(codes)) + gaps), codes=np.array(codes, "<i4").tobytes(), phrases=b"", sizes=b"", lists=b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[dict, array, array]] = {}
        n = 0
        for batch in batches:
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary())):
                for piece in _ENDS.split(body.as_py().lower()):  # bytes: A-Z alone change
                    words = piece.split()  # at blanks and tabs, as no other white space is left
                    if not words:
                        continue
                    known, codes, bounds = held.setdefault(name, ({}, array("i"), array("i")))
                    codes.extend([known.setdefault(w, len(known)) for w in words])
                    bounds.append(len(codes))
                    n += len(words)
                    if n >= most:
                        while held:
                            name_, parts = held.popitem()
                            yield closed(name_, *parts)
                        n = 0
        while held:
            name_, parts = held.popitem()
            yield closed(name_, *parts)

    rows = documents.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, BLOCKS)


def _steps(positions: np.ndarray) -> bytes:
    return np.diff(positions, prepend=0).astype("<i4").tobytes()


def _hashes(parts: list[np.ndarray], lang: str) -> np.ndarray:
    """A hash of HASH_BITS bits of each row of words, given their own hashes."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), _word_hash([lang.encode()])[0], np.uint64)
        for p in parts:
            out = (out ^ p) * _MIX
            out ^= out >> np.uint64(29)
    return out >> np.uint64(64 - HASH_BITS)


def _word_hash(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


class Sieve:
    """A bitmap of hashes; holds(hashes) is true for all that were put in, and for some others."""

    def __init__(self, bits: int, cells: np.ndarray, values: np.ndarray):
        self.bits, self.map = bits, np.zeros(1 << max(0, bits - 6), np.uint64)
        self.map[cells] = values.view(np.uint64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(HASH_BITS - self.bits)
        return (self.map[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def sieve(hashes: DataFrame, n: int) -> Sieve:
    """hashes (a long column h, n rows) as a sieve, which has at most 2 ** SIEVE_BITS bits however many there are."""
    bits = min(SIEVE_BITS, max(12, (n * BITS_A_HASH).bit_length()))
    places = hashes.select(F.expr(f"shiftrightunsigned(h, {HASH_BITS - bits})").alias("place"))
    cells = places.groupBy(F.expr("CAST(shiftright(place, 6) AS INT)").alias("cell")).agg(F.expr("bit_or(shiftleft(1L, CAST(place & 63 AS INT)))").alias("value"))
    got = cells.toArrow()  # bounded: a row a cell
    return Sieve(bits, got["cell"].to_numpy().astype(np.int64), got["value"].to_numpy())


def _at(positions: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted position stands among sorted ones, -1 where it doesn't: a merge-join."""
    if not len(positions):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(positions, wanted), len(positions) - 1)
    return np.where(positions[at] == wanted, at, -1)


def extended(row, k: int, words_sieve: Sieve | None):
    """The lists of k words that extend a block's lists; for k = 2 they extend its postings.

    Gives the block's words, its postings (positions and codes), and of the new lists the positions at which they start,
    these positions' places among the postings, the list of each, and the hash of each list. Words that the sieve stops
    count as gaps.
    """
    words = row["words"].split(b"\n")
    positions, codes = np.cumsum(np.frombuffer(row["steps"], "<i4"), dtype=np.int32), np.frombuffer(row["codes"], "<i4")
    own = _word_hash(words)
    if words_sieve is not None:
        live = words_sieve.holds(_hashes([own], row["lang"]))[codes]
        positions, codes = positions[live], codes[live]
    if k == 2:
        starts = positions
    else:
        starts = np.sort(np.frombuffer(row["lists"], "<i4"))
    ends = _at(positions, starts + (k - 1))
    kept = ends >= 0
    if k > 2:
        kept &= _at(starts, starts + 1) >= 0
    starts = starts[kept]
    heads = _at(positions, starts)
    parts = [own[codes[_at(positions, starts + i)]] for i in range(k)] if len(starts) else [np.empty(0, np.uint64)] * k
    hashes, number = np.unique(_hashes(parts, row["lang"]), return_inverse=True)
    return words, positions, codes, starts, heads, number, hashes


def list_hashes(state: DataFrame, k: int, words_sieve) -> DataFrame:
    """h and n: the hash and length of each block's extended lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = words_sieve.value if words_sieve else None
        for row in _rows(batches):
            *_, number, hashes = extended(row, k, held)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(np.bincount(number, minlength=len(hashes)))], ["h", "n"])

    return state.select("lang", "words", "steps", "codes", "lists").mapInArrow(run, "h long, n long")


def extend(state: DataFrame, k: int, words_sieve, lists_sieve) -> DataFrame:
    """Blocks with their lists of k words that pass the sieve, and the postings that these cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, passing = words_sieve.value if words_sieve else None, lists_sieve.value
        for row in _rows(batches):
            words, positions, codes, starts, heads, number, hashes = extended(row, k, held)
            passes = passing.holds(hashes)[number]
            if not passes.any():
                continue
            starts, heads, number = starts[passes], heads[passes], number[passes]
            order = np.argsort(number, kind="stable")
            starts, heads, number = starts[order], heads[order], number[order]
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            sizes = np.diff(np.append(first, len(number)))
            covered = np.zeros(len(positions), bool)
            for i in range(k):
                covered[heads + i] = True
            phrases = b"\n".join(b" ".join(words[c] for c in codes[h : h + k].tolist()) for h in heads[first].tolist())
            used, fresh = np.unique(codes[covered], return_inverse=True)
            yield _block(lang=row["lang"], n=row["n"], words=b"\n".join(words[c] for c in used.tolist()), steps=_steps(positions[covered]), codes=fresh.astype("<i4").tobytes(), phrases=phrases, sizes=sizes.astype("<i4").tobytes(), lists=starts.astype("<i4").tobytes())

    return state.drop("phrases", "sizes").mapInArrow(run, BLOCKS)


def counted_words(state: DataFrame) -> DataFrame:
    """lang, phrase and n: the length of each word's list in each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            listed = row["words"].decode().split("\n")
            yield pa.RecordBatch.from_arrays([pa.repeat(row["lang"], len(listed)), pa.array(listed), pa.array(np.bincount(np.frombuffer(row["codes"], "<i4"), minlength=len(listed)))], ["lang", "phrase", "n"])

    return state.select("lang", "words", "codes").mapInArrow(run, "lang string, phrase string, n long")


#: Packs that lists are dealt to for counting, at least, and frequent hashes a pack otherwise; packs of a task, at most;
#: phrases that a task adds up before it sends them.
PACKS, PACK, PACKS_A_TASK, HELD = 64, 2000, 25, 200_000


def counted_lists(state: DataFrame, n: int, least: int) -> DataFrame:
    """lang, phrase and n of the lists of all blocks that are frequent together; n hashes are.

    A task adds up what its blocks hold and sends phrases (joined by line ends) and lengths in packs by a hash of the
    phrase; a task adds the packs that meet in it, and holds the different phrases of these alone.
    """
    packs = max(PACKS, n // PACK)
    tasks = max(state.sparkSession.sparkContext.defaultParallelism, -(-packs // PACKS_A_TASK))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for row in _rows(batches):
            for phrase, size in zip(row["phrases"].split(b"\n"), np.frombuffer(row["sizes"], "<i4").tolist()):
                held[row["lang"], phrase] += size
            if len(held) > HELD:
                yield from sent(held)
                held.clear()
        yield from sent(held)

    def sent(held: Counter) -> Iterator[pa.RecordBatch]:
        by_pack: dict[tuple, tuple[list, list]] = {}
        for (lang, phrase), size in held.items():
            phrases, sizes = by_pack.setdefault((zlib.crc32(phrase) % packs, lang), ([], []))
            phrases.append(phrase)
            sizes.append(size)
        if by_pack:
            rows = [{"pack": pack, "lang": lang, "phrases": b"\n".join(x), "sizes": np.array(y, "<i8").tobytes()} for (pack, lang), (x, y) in by_pack.items()]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("pack", pa.int64()), ("lang", pa.string()), ("phrases", pa.binary()), ("sizes", pa.binary())]))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for row in _rows(batches, bytes):
            for phrase, size in zip(row["phrases"].split(b"\n"), np.frombuffer(row["sizes"], "<i8").tolist()):
                total[row["lang"], phrase] += size
        kept = [{"lang": lang, "phrase": phrase.decode(), "n": n} for (lang, phrase), n in total.items() if n >= least]
        yield pa.RecordBatch.from_pylist(kept, pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())]))

    rows = state.select("lang", "phrases", "sizes").mapInArrow(packed, "pack long, lang string, phrases binary, sizes binary")
    return rows.repartition(tasks, "pack").mapInArrow(added, "lang string, phrase string, n long")


def _frequent(lists: DataFrame, keys: list[str], least: int) -> DataFrame:
    return lists.groupBy(*keys).agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _hash_column(words: DataFrame) -> DataFrame:
    """h of single words, as the blocks calculate it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.empty(len(batch), np.uint64)
            own = _word_hash([p.encode() for p in batch["phrase"]])
            for lang, at in batch.groupby("lang").indices.items():
                out[at] = _hashes([own[at]], lang)
            yield pd.DataFrame({"h": out.view(np.int64)})

    return words.select("lang", "phrase").mapInPandas(run, "h long")


def frequencies(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size and n of all phrases that are frequent, and lang and n of all words."""
    spark = documents.sparkSession
    share = spark.sparkContext.broadcast
    state = staged(blocks(documents, text, lang), "phrases-blocks", A_FILE)
    words = staged(state.groupBy("lang").agg(F.sum("n").alias("n")), "phrases-words")
    levels = [staged(_frequent(counted_words(state), ["lang", "phrase"], least), "phrases-1")]
    words_sieve = share(sieve(_hash_column(levels[0]), levels[0].count()))
    for k in range(2, longest + 1):
        hashes = staged(_frequent(list_hashes(state, k, words_sieve), ["h"], least).select("h"), "phrases-hashes")
        n = hashes.count()
        if not n:
            discard(hashes)
            break
        passing = share(sieve(hashes, n))
        longer = staged(extend(state, k, words_sieve, passing), "phrases-lists", A_FILE)
        for used in (passing, words_sieve):
            if used:
                used.destroy()
        discard(hashes)
        discard(state)
        state, words_sieve = longer, None
        levels.append(staged(counted_lists(state, n, least), f"phrases-{k}"))
    discard(state)
    out = None
    for k, level in enumerate(levels, 1):
        sized = level.select("lang", "phrase", F.lit(k).alias("size"), "n")
        out = sized if out is None else out.unionByName(sized)
    return out, words


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(19,0)")


def scored(found: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n and score of phrases of at least two words, by their lowest cut."""
    parts = F.split("phrase", " ")
    cuts = found.filter("size > 1").select("lang", "phrase", "size", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    halves = cuts.withColumns({"left": F.array_join(F.slice(parts, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(parts, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    known = found.select("lang", "phrase", "n")
    with_left = halves.join(known.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
    with_both = with_left.join(known.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"]).join(words, "lang")
    products = {"above": (_whole("a") * _whole("n")).cast("decimal(33,0)") * F.lit(1000).cast("decimal(4,0)"), "below": _whole("l") * _whole("r")}
    cut = with_both.withColumns(products).withColumn("score", F.expr("above div below"))
    lowest = F.min(F.struct("score", "k", "l", "r")).alias("x")
    return cut.groupBy("lang", "phrase", "size", "a", "n").agg(lowest).select("lang", "phrase", "size", "a", "x.l", "x.r", "n", "x.score")


def whole_ones(found: DataFrame, percent: int = 100) -> DataFrame:
    """lang and phrase of phrases of at least two words that no longer one holds at that share of their frequency."""
    parts = F.split("phrase", " ")
    inner = F.array(F.array_join(F.slice(parts, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(parts, F.lit(2), F.col("size") - 1), " "))
    held = found.filter("size > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return found.filter("size > 1").join(held, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("n"))).select("lang", "phrase")


def collocations(documents: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, text: str = "text", lang: str = "lang") -> DataFrame:
    """Each language's best phrases with their place."""
    found, words = frequencies(documents, least, longest, text, lang)
    kept = scored(found, words).join(whole_ones(found), ["lang", "phrase"])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    grams = " UNION ALL ".join(f"SELECT lang, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM pieces)" for k in range(1, LONGEST + 1))
    return rf"""WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    pieces AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM cut),
    words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    f AS MATERIALIZED (SELECT lang, p, count(*) AS a FROM ({grams}) GROUP BY lang, p HAVING count(*) >= {LEAST}),
    c AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM f WHERE len(p) > 1),
    s AS (SELECT c.lang, c.p, c.a, k, x.a AS l, y.a AS r, n, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score FROM c JOIN f x ON x.lang = c.lang AND x.p = c.p[1:k] JOIN f y ON y.lang = c.lang AND y.p = c.p[k + 1:len(c.p)] JOIN words v ON v.lang = c.lang),
    m AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS cut FROM s),
    i AS (SELECT lang, p, a, len(p) AS size, unnest(range(2, len(p))) AS size_in FROM f WHERE len(p) > 2),
    h AS (SELECT lang, q, max(a) AS longer FROM (SELECT lang, a, p[j:j + size_in - 1] AS q FROM (SELECT *, unnest(range(1, size - size_in + 2)) AS j FROM i)) GROUP BY lang, q),
    o AS (SELECT m.lang, array_to_string(p, ' ') AS phrase, a, l, r, n, score FROM m LEFT JOIN h ON h.lang = m.lang AND h.q = m.p WHERE cut = 1 AND (longer IS NULL OR 100 * longer < 100 * a))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o QUALIFY rank <= {BEST}"""


ORACLE = _oracle()
