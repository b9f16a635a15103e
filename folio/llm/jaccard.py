"""N-gram Jaccard join: a grouped prefix join of documents by their sets of 5-word shingles.

Two sets link when 100 * |A & B| >= 80 * |A | B|. If the shingles of every set stand in one global order, two linked
sets share a shingle within short prefixes, so documents are joined on prefix shingles and pairs are verified on whole
sets. The order puts shingles that many documents share last, by a counting sketch over all documents; any order gives
the same links, a good one keeps passages that many documents share out of the prefixes.

Steps, each a Spark job over slim rows:

1. Documents with equal sets are one class, represented by the smallest doc_id.
2. Classes with identical prefixes and set size are one group; only groups are joined.
3. Every shingle's groups are paired with one centre (per class of sizes), which is linear. Verified pairs give
   components. The centre is drawn by a hash of the group and of one of a few salts, so a group meets several centres of
   a large set of near copies.
   Then groups meet centres of the largest other component that shares a shingle, once more, so what belongs to a large
   set is mostly in it before the last step.
4. What remains are groups that share a prefix shingle and don't lie whole in one component: all pairs of them that pass
   the filters are expanded into their classes, and the classes of different components are filtered and verified too;
   so are those of one group. So no link between components is lost, while the inside of a large set of near copies is
   never expanded into all pairs.

Pairs are filtered by sizes, by the places of the shared shingle, and by parity: of two bitmaps that hold for each of
BITS buckets of shingles whether their number is odd, the bits that differ are at most the shingles that differ. Large
sets are filtered by what their prefixes share: they can't have more in common than that and the longer rest.

Sets of up to three shingles link with equal sets alone, so they have no prefixes. Classes of many copies (at least
HOT_SHARE of all documents, which bounds their number) are joined with their documents by broadcast; other skewed joins
are left to adaptive execution.

Texts are shingled anew where they are needed, rather than sets being stored: a set takes more bytes than its text.
Shingles are identified by 64-bit hashes and classes by 128-bit ones.

A very long text is shingled whole, in memory in proportion. Equal texts (ties) have one component, named by the smallest
doc_id. Null, empty and blank texts have an empty set, no links and themselves as component. Rows with a null doc_id take no
part and get a null component. Rows of one doc_id are one node: what any of them links with is in its component, and
n_shingles is each row's own.
An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import discard, staged

WORDS = 5
#: Counters of the sketch, for shingles whose hash is in the lowest part; prefixes hardly reach beyond.
SKETCH = 1 << 22
SKETCH_PART = 0.3
CHUNK = 1 << 18
#: Parts of a chunk of the sketch that one task adds, about; of more, sums of parts are added first.
ADDED = 256
#: Classes and groups that a task remembers having met; all are forgotten when there are more, and some rows come twice.
MET = 500_000
#: Stands for a null doc_id inside pandas batches.
NO_ID = -(2**63)
#: A counter of this much or more, and of twice the usual one, puts its shingles behind all others.
FREQUENT = 32
#: Sets up to this size have no link but equal sets.
ALONE = 3
#: Share of documents from which a class is joined by broadcast, and the copies that it has at least.
HOT_SHARE, HOT_COPIES = 1e-4, 4096

#: Salts by which centres are drawn: about so many of them does a group in a large set of near copies meet.
SALTS = 12
#: Centres that a group meets at a shingle before the last step, in components of so many classes at least.
TURNS, LARGE = 4, 32
#: Sets larger than this are filtered by the number of prefix shingles that they share, as a parity map of theirs is full.
WIDE = 1000
#: Documents that are shingled at once.
BATCH = 256
#: Bits of a set's parity map.
BITS = 1024
_BIT_COLUMNS = [f"b{k}" for k in range(BITS // 64)]

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)
_LIMIT = np.uint64(int(SKETCH_PART * 2**64))
_WIDTH = np.uint64(int(SKETCH_PART * 2**64) // SKETCH + 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes; remembers the hashes of words."""

    def __init__(self, most_words: int = 300_000):
        self.most_words, self.seen = most_words, {}

    def many(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The set of each text; the arithmetic is done on all of them at once."""
        if len(self.seen) > self.most_words:
            self.seen = {}
        seen, split = self.seen, []
        for text in texts:
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            for word in set(words).difference(seen):
                seen[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
            split.append(words)
        n = np.array([len(w) for w in split], np.int64)
        h = _mix(np.fromiter(map(seen.__getitem__, chain.from_iterable(split)), np.uint64, int(n.sum())))
        windows = self._rolled(h, WORDS)
        ends = np.cumsum(n)
        out = []
        for end, k in zip(ends.tolist(), n.tolist()):
            own = windows[end - k : end - WORDS + 1] if k >= WORDS else self._rolled(h[end - k : end], k)
            own = np.sort(own)
            fresh = np.ones(len(own), bool)
            fresh[1:] = own[1:] != own[:-1]
            out.append(own[fresh])
        return out

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    @staticmethod
    def _rolled(h: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of size words."""
        if not size or len(h) < size:
            return np.empty(0, np.uint64)
        runs = len(h) - size + 1
        whole = np.full(runs, np.uint64(size))
        for k in range(size):
            whole = (whole * _MULTIPLIER) ^ h[k : k + runs]
            whole = _mix(whole) if k == size - 1 else whole ^ (whole >> _HALF)
        return whole


def _signed(x: np.ndarray | np.uint64):
    return np.asarray(x, np.uint64).view(np.int64)


def _prints(sets: list[np.ndarray]) -> np.ndarray:
    """Two numbers (sets, 2) that stand for each set."""
    out = np.zeros((len(sets), 2), np.int64)
    full = [k for k, s in enumerate(sets) if len(s)]
    if full:
        flat = np.concatenate([sets[k] for k in full])
        starts = np.cumsum([0] + [len(sets[k]) for k in full])[:-1]
        out[full, 0] = _signed(np.add.reduceat(_mix(flat ^ np.uint64(1)), starts))
        out[full, 1] = _signed(np.bitwise_xor.reduceat(_mix(flat * _MULTIPLIER), starts))
    return out


def _parities(sets: list[np.ndarray]) -> np.ndarray:
    """The parity maps (sets, BITS / 64)."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = (np.concatenate(sets) & np.uint64(BITS - 1)).astype(np.int64) if sets else np.empty(0, np.int64)
    odd = np.bincount(owner * BITS + place, minlength=len(sets) * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sets), BITS // 64)


_own: list[Shingler] = []


def _shingler() -> Shingler:
    """This process's shingler: a worker keeps the words that it has met from task to task."""
    if not _own:
        _own.append(Shingler())
    return _own[0]


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    shingler = _shingler()
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            rows = batch.iloc[at : at + BATCH]
            yield rows, shingler.many(rows["text"])


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each document (doc_id, n, fp_a, fp_b and its parity map), and the task's part of the sketch as compressed chunks."""
    sketch, seen = np.zeros(SKETCH, np.uint32), set()
    for rows, sets in _shingled(batches):
        prints = _prints(sets)
        low = []
        for shingles, key in zip(sets, map(tuple, prints.tolist())):
            if key not in seen:
                if len(seen) >= MET:
                    seen.clear()
                seen.add(key)
                low.append(shingles[: np.searchsorted(shingles, _LIMIT)])
        if low:
            places, n = np.unique((np.concatenate(low) // _WIDTH).astype(np.int64), return_counts=True)
            sketch[places] += n.astype(np.uint32)
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy(), "n": [len(x) for x in sets], "fp_a": prints[:, 0], "fp_b": prints[:, 1]})
        out[_BIT_COLUMNS] = _parities(sets)
        out["chunk"], out["counts"] = -1, None
        yield out
    none = [0] * (4 + len(_BIT_COLUMNS))
    parts = [(*none, k, zlib.compress(part.tobytes(), 1)) for k in range(SKETCH // CHUNK) if (part := sketch[k * CHUNK : (k + 1) * CHUNK]).any()]
    yield pd.DataFrame(parts, columns=["doc_id", "n", "fp_a", "fp_b", *_BIT_COLUMNS, "chunk", "counts"])


def _summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The chunks' sums as one byte a counter: 0 if not frequent, else the number of bits."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch["chunk"], batch["counts"]):
            part = np.frombuffer(zlib.decompress(counts), np.uint32)
            sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
    # in a large table every counter is shared by many rare shingles: their usual sum says nothing
    rows = [(k, np.where(s < max(FREQUENT, 2 * np.median(s)), 0, np.ceil(np.log2(s + 1.0))).astype(np.uint8).tobytes()) for k, s in sums.items()]
    yield pd.DataFrame(rows, columns=["chunk", "levels"])


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's parts of chunks as one part a chunk."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch["chunk"], batch["counts"]):
            part = np.frombuffer(zlib.decompress(counts), np.uint32)
            sums[k] = np.minimum(sums[k].astype(np.uint64) + part, 2**32 - 1).astype(np.uint32) if k in sums else part
    yield pd.DataFrame([(k, zlib.compress(x.tobytes(), 1)) for k, x in sums.items()], columns=["chunk", "counts"])


def _levels(counted: DataFrame) -> np.ndarray:
    """SKETCH bytes, however many documents there are; parts are added as a tree, so no task reads those of all tasks."""
    out = np.zeros(SKETCH, np.uint8)
    chunks = SKETCH // CHUNK
    parts = counted.filter("chunk >= 0").select("chunk", "counts")
    n = parts.count() // chunks
    while n > ADDED:
        n = -(-n // ADDED)
        dealt = parts.withColumn("_deal", F.pmod(F.xxhash64("counts"), F.lit(n)))
        parts = staged(dealt.repartition(chunks * n, "chunk", "_deal").drop("_deal").mapInPandas(_added, "chunk int, counts binary"), "join-sketch")
    parts = parts.repartition(chunks, "chunk").mapInPandas(_summed, "chunk int, levels binary")
    for row in parts.collect():
        out[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["levels"], np.uint8)
    return out


def ordered(shingles: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Shingles in the global order: rare ones by hash, then frequent ones by level and hash."""
    n_low = int(np.searchsorted(shingles, _LIMIT))
    level = levels[(shingles[:n_low] // _WIDTH).astype(np.int64)]
    if not level.any():
        return shingles
    common = level > 0
    heavy = shingles[:n_low][common]
    return np.concatenate([shingles[:n_low][~common], shingles[n_low:], heavy[np.argsort(level[common], kind="stable")]])


def prefix_length(n: int) -> int:
    return n - -(-4 * n // 5) + 1


def _postings(levels):
    """Rows (token, grp, n, pos) once a group and task, and rows with pos -1 that name a class of a group."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = levels.value
        groups, classes = set(), set()
        for _, sets in _shingled(batches):
            tokens, grps, sizes, places, prints = [], [], [], [], []
            for shingles, (fp_a, fp_b) in zip(sets, _prints(sets).tolist()):
                n = len(shingles)
                if n <= ALONE or (fp_a, fp_b) in classes:
                    continue
                if len(classes) >= MET:
                    classes.clear()
                    groups.clear()
                classes.add((fp_a, fp_b))
                prefix = ordered(shingles, table)[: prefix_length(n)]
                grp = int(_signed(_mix(np.bitwise_xor.reduce(_mix(prefix ^ np.uint64(7)), keepdims=True) ^ np.uint64(n)))[0])
                tokens.append(np.array([fp_a], np.int64))
                grps.append(np.array([grp], np.int64))
                sizes.append(np.array([n], np.int32))
                places.append(np.array([-1], np.int32))
                prints.append(np.array([fp_b], np.int64))
                if grp not in groups:
                    groups.add(grp)
                    k = len(prefix)
                    tokens.append(_signed(prefix))
                    grps.append(np.full(k, grp, np.int64))
                    sizes.append(np.full(k, n, np.int32))
                    places.append(np.arange(k, dtype=np.int32))
                    prints.append(np.zeros(k, np.int64))
            if tokens:
                yield pd.DataFrame({"token": np.concatenate(tokens), "grp": np.concatenate(grps), "n": np.concatenate(sizes), "pos": np.concatenate(places), "fp_b": np.concatenate(prints)})

    return run


def _fits(n1, pos1, n2, pos2):
    """Whether two sets may still link, this being the first shingle in order that they share."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    rest = F.least(n1 - pos1, n2 - pos2)
    return (5 * small >= 4 * large) & (9 * rest >= 4 * (n1 + n2))


def _may_link(x: str, y: str):
    """Whether two sets may link by the parity maps of the aliases x and y."""
    differ = sum((F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in _BIT_COLUMNS), F.lit(0))
    return 9 * differ <= F.col(f"{x}.n") + F.col(f"{y}.n")


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    shingler, last, ours = _shingler(), None, None  # last: the left text, as a doc_id may have several
    for batch in batches:
        links = []
        for at in range(0, len(batch), BATCH):
            rows = batch.iloc[at : at + BATCH]
            for a, b, text_a, theirs in zip(rows["a"], rows["b"], rows["text_a"], shingler.many(rows["text_b"])):
                if ours is None or text_a != last:
                    last, ours = text_a, shingler(text_a)
                common = len(np.intersect1d(ours, theirs, assume_unique=True))
                if 100 * common >= 80 * (len(ours) + len(theirs) - common):
                    links.append((a, b))
        yield pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of representatives whose sets link, as a staged table. Of a doc_id with several texts any may link."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = docs.join(needed, "doc_id", "left_semi").withColumn("_hash", F.xxhash64("text")).dropDuplicates(["doc_id", "_hash"])
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    both = pairs.join(right, "b").join(left, "a")
    return staged(both.mapInPandas(_verified, "a long, b long"), "jaccard-links")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node that each node of an edge (a, b) reaches.

    A round moves each node to the neighbour that a hash puts first, and from there once more, and keeps the edges between
    different ends, each once. So edges inside a set that is found already go, rather than being joined in every round; the
    hashes let chains, too, shrink by a share a round. The moves are put together from the last one back, as each is
    smaller than the one before.
    """
    ends = lambda df, a, b: df.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    left, moves = staged(ends(edges, F.col("a"), F.col("b")), "components-edges"), []
    while not moves or not left.isEmpty():
        drawn = lambda c: F.struct(F.xxhash64(c).alias("draw"), F.col(c).alias("to"))
        both = left.select("a", "b").union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        once = both.groupBy(F.col("a").alias("node")).agg(F.min(drawn("b")).alias("near")).select("node", F.least("near", drawn("node"))["to"].alias("to"))
        once = staged(once, "components-moves")
        onward = once.select(F.col("node").alias("to"), F.col("to").alias("onward"))
        moves.append(staged(once.join(onward, "to").select("node", F.col("onward").alias("to")), "components-moves"))
        discard(once)
        moved = lambda end: moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to"))
        fresh = staged(ends(left.join(moved("a"), "a").join(moved("b"), "b"), F.col("a_to"), F.col("b_to")), "components-edges")
        discard(left)
        left = fresh
    found = moves[-1]
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("to"), F.col("to").alias("last"))
        found = move.join(later, "to", "left").select("node", F.coalesce("last", "to").alias("to"))
    found = staged(found, "components-labels")
    for table in (left, *moves):
        discard(table)
    return found.join(found.groupBy("to").agg(F.min("node").alias("component")), "to").select("node", "component")


def _joined(found: DataFrame, edges: DataFrame) -> DataFrame:
    """found (node, component) with more edges (a, b): components are put together, and what lies inside one isn't met again."""
    nodes = staged(found.union(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))), "components-nodes")
    of = lambda end: nodes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))
    wider = components(edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b")))
    return nodes.join(wider.select(F.col("node").alias("component"), F.col("component").alias("wider")), "component", "left").select("node", F.coalesce("wider", "component").alias("component"))


def _one_node(known: DataFrame, several: DataFrame, classes: DataFrame) -> DataFrame:
    """Edges (a, b) between the representatives of all classes that share a doc_id of several."""
    own = known.join(several, "doc_id", "left_semi").select("doc_id", "fp_a", "fp_b").distinct()
    reps = staged(own.join(classes.select("fp_a", "fp_b", "rep"), ["fp_a", "fp_b"]).select("doc_id", "rep").distinct(), "jaccard-reps")
    least = reps.groupBy("doc_id").agg(F.min("rep").alias("a"))
    return staged(reps.join(least, "doc_id").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct(), "jaccard-one-node")


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """members with comp, their representative's component."""
    return members.join(found, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")


def _inside(members: DataFrame, heads: DataFrame) -> DataFrame:
    """Each group's head with the group's other classes."""
    x, y = heads.alias("x"), members.alias("y")
    pairs = x.join(y, (F.col("x.grp") == F.col("y.grp")) & (F.col("x.rep") != F.col("y.rep")) & _may_link("x", "y"))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))


def _around(shared: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads of groups with those of their shingles' centres."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.25))).cast("int")
    draw = F.xxhash64("grp", F.pmod("token", F.lit(SALTS)))
    lists = shared.withColumn("size_class", size_class)
    lists = lists.withColumn("c", F.min(F.struct(draw, "grp", "n", "pos")).over(Window.partitionBy("token", "size_class")))
    met = lists.filter((F.col("c.grp") != F.col("grp")) & _fits(F.col("c.n"), F.col("c.pos"), F.col("n"), F.col("pos")))
    return _met(met, heads)


def _nearby(shared: DataFrame, heads: DataFrame, placed: DataFrame) -> DataFrame:
    """Heads of groups with those of centres in other components, drawn in the largest one of a shingle's list.

    A group that belongs to a large component but links with none of the few centres that it met meets TURNS more at each
    shingle, rather than every group of the component in the last step. Components of less than LARGE classes are left to it.
    """
    sizes = placed.groupBy("comp").agg(F.count("*").alias("size"))
    own = heads.select("grp", "rep").join(placed.select("rep", "comp"), "rep").join(sizes, "comp").select("grp", "comp", "size")
    lists = _apart(shared.join(own, "grp"), "comp").withColumn("largest", F.max("size").over(Window.partitionBy("token"))).filter(F.col("largest") >= LARGE)
    place = F.struct(-F.col("size"), "comp", F.xxhash64("grp", "token", "turn"), "grp", "n", "pos")
    lists = lists.withColumn("turn", F.explode(F.sequence(F.lit(1), F.lit(TURNS))))
    lists = lists.withColumn("c", F.min(place).over(Window.partitionBy("token", "turn")))
    met = lists.filter((F.col("c.comp") != F.col("comp")) & _fits(F.col("c.n"), F.col("c.pos"), F.col("n"), F.col("pos")))
    return _met(met, heads)


def _met(met: DataFrame, heads: DataFrame) -> DataFrame:
    """Heads of groups with those of the centres c that they meet often enough, as far as they may link."""
    # what links with a set of n meets it at n / 9 shingles or more, a salt's share of which stands here; the rest is left to the last step
    met = met.groupBy(F.col("c.grp").alias("centre"), "grp", "n").count().filter(F.col("count") * 36 * SALTS >= F.col("n")).select("centre", "grp")
    x, y = heads.alias("x"), heads.alias("y")
    pairs = met.join(x, F.col("centre") == F.col("x.grp")).join(y, (met["grp"] == F.col("y.grp")) & _may_link("x", "y"))
    return pairs.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).filter("a <> b")


def _apart(df: DataFrame, column: str) -> DataFrame:
    """The rows of shingles that different values of column share."""
    token = Window.partitionBy("token")
    return df.withColumn("low", F.min(column).over(token)).withColumn("high", F.max(column).over(token)).filter("low <> high").drop("low", "high")


def _across(shared: DataFrame, placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes of different components that share a prefix shingle or a group and pass all filters.

    A group is named by its smallest class. One of a single class has that one's parity map, so its pairs need no
    further filter; others are expanded.
    """
    groups = placed.groupBy("grp").agg(F.first("n").alias("n"), F.min("rep").alias("head"), F.min("comp").alias("comp"), (F.min("comp") != F.max("comp")).alias("mixed"), (F.count("*") > 1).alias("many"), *(F.first(b).alias(b) for b in _BIT_COLUMNS))
    groups = staged(groups, "jaccard-groups")
    columns = ["token", "head", "comp", "mixed", "many", "n", "pos", *_BIT_COLUMNS]
    token = Window.partitionBy("token")
    lists = shared.drop("n").join(groups, "grp").select(*columns)
    lists = staged(lists.withColumn("low", F.min("comp").over(token)).withColumn("high", F.max("comp").over(token)).withColumn("any", F.max("mixed").over(token)).filter("low <> high OR any").drop("low", "high", "any"), "jaccard-lists")
    x, y = lists.alias("x"), lists.alias("y")
    fits = _fits(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"))
    met = x.join(
        y,
        (F.col("x.token") == F.col("y.token"))
        & ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.head") < F.col("y.head"))))
        & ((F.col("x.comp") != F.col("y.comp")) | F.col("x.mixed") | F.col("y.mixed"))
        & (5 * F.col("x.n") >= 4 * F.col("y.n"))
        & (fits | (F.col("x.n") > WIDE))
        & (F.col("x.many") | F.col("y.many") | _may_link("x", "y")),
    ).groupBy(F.col("x.head").alias("a"), F.col("y.head").alias("b"), F.col("x.n").alias("n"), F.col("y.n").alias("m"), (F.col("x.many") | F.col("y.many")).alias("many"))
    most = F.col("shared") + F.ceil(F.greatest("n", "m") * 4 / 5) - 1
    pairs = met.agg(F.count("*").alias("shared"), F.max(fits).alias("fits")).filter(F.col("fits") & ((F.col("n") <= WIDE) | (9 * most >= 4 * (F.col("n") + F.col("m")))))
    pairs = staged(pairs.select("a", "b", "many"), "jaccard-group-pairs")
    discard(lists)
    out = pairs.filter(~F.col("many")).select("a", "b")
    several = groups.filter("many").select("grp", "head", "mixed")
    if several.isEmpty():
        return out
    members = placed.join(groups.select("grp", "head", "mixed"), "grp")
    left, right = members.alias("x"), members.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & _may_link("x", "y")
    ends = [F.col("x.rep").alias("a"), F.col("y.rep").alias("b")]
    opened = pairs.filter("many").join(left, F.col("a") == F.col("x.head")).join(right, (F.col("b") == F.col("y.head")) & apart).select(*ends)
    inside = members.filter("mixed")
    inside = inside.alias("x").join(inside.alias("y"), (F.col("x.grp") == F.col("y.grp")) & (F.col("x.rep") < F.col("y.rep")) & apart).select(*ends)
    return out.union(opened).union(inside).distinct()


def join(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = documents.sparkSession
    source = documents.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    docs = source.filter(F.col("doc_id") != NO_ID)
    bit_schema = ", ".join(f"{b} long" for b in _BIT_COLUMNS)
    counted = staged(source.mapInPandas(_counted, f"doc_id long, n long, fp_a long, fp_b long, {bit_schema}, chunk int, counts binary"), "jaccard-counted")
    rows = counted.filter("chunk < 0").select("doc_id", "n", "fp_a", "fp_b")
    levels = spark.sparkContext.broadcast(_levels(counted))  # SKETCH bytes
    known = counted.filter((F.col("chunk") < 0) & (F.col("n") > 0) & (F.col("doc_id") != NO_ID))
    classes = staged(known.groupBy("fp_a", "fp_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), *(F.first(b).alias(b) for b in _BIT_COLUMNS)), "jaccard-classes")
    raw = staged(docs.mapInPandas(_postings(levels), "token long, grp long, n int, pos int, fp_b long"), "jaccard-postings")
    members = staged(raw.filter("pos < 0").select(F.col("token").alias("fp_a"), "fp_b", "grp", "n").distinct().join(classes, ["fp_a", "fp_b"]).select("grp", "n", "rep", *_BIT_COLUMNS), "jaccard-members")
    shared = staged(_apart(raw.filter("pos >= 0").select("token", "grp", "n", "pos"), "grp").distinct(), "jaccard-shared")  # several tasks may have met a group
    discard(raw)
    first = F.row_number().over(Window.partitionBy("grp").orderBy("rep"))
    heads = staged(members.withColumn("_n", first).filter("_n = 1").drop("_n"), "jaccard-heads")
    links = _links(staged(_inside(members, heads).union(_around(shared, heads)).distinct(), "jaccard-pairs"), docs)
    prints = F.struct("fp_a", "fp_b")
    several = staged(rows.filter(F.col("doc_id") != NO_ID).groupBy("doc_id").agg(F.min(prints).alias("low"), F.max(prints).alias("high")).filter("low <> high").select("doc_id"), "jaccard-several")
    repeated = not several.isEmpty()
    if repeated:
        links = links.union(_one_node(known, several, classes))
    found = components(links)
    nearby = _links(staged(_nearby(shared, heads, _placed(members, found)).distinct(), "jaccard-pairs"), docs)
    if not nearby.isEmpty():
        found = staged(_joined(found, nearby), "jaccard-found")
    # the rest: groups that share a prefix shingle across components
    second = _links(staged(_across(shared, _placed(members, found)), "jaccard-pairs"), docs)
    for table in (shared, members):
        discard(table)
    final = found if second.isEmpty() else _joined(found, second)
    labelled = staged(classes.join(final, F.col("rep") == F.col("node"), "left").filter("copies > 1 OR node IS NOT NULL").select("fp_a", "fp_b", "copies", F.coalesce("component", "rep").alias("component")), "jaccard-labelled")
    known = F.when(F.col("doc_id") != NO_ID, F.col("doc_id"))
    own = F.coalesce(F.when(F.col("n") > 0, F.col("component")), "doc_id")
    hot = F.col("copies") >= max(HOT_COPIES, int(rows.count() * HOT_SHARE))
    large = F.broadcast(labelled.filter(hot).drop("copies"))  # 1 / HOT_SHARE rows at most
    out = rows.join(large, ["fp_a", "fp_b"]).union(rows.join(large, ["fp_a", "fp_b"], "left_anti").join(labelled.filter(~hot).drop("copies"), ["fp_a", "fp_b"], "left"))
    labelled = labelled.drop("copies")
    if repeated:  # an empty row follows the other texts of its doc_id
        others = rows.filter("n > 0").join(several, "doc_id", "left_semi").join(labelled, ["fp_a", "fp_b"]).groupBy("doc_id").agg(F.min("component").alias("others"))
        out = out.join(others, "doc_id", "left").withColumn("component", F.coalesce("component", "others"))
        own = F.coalesce("component", "doc_id")
    return out.select(known.alias("doc_id"), F.col("n").alias("n_shingles"), F.when(known.isNotNull(), own).alias("component_id"))


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS reach FROM w UNION SELECT e.b, r.reach FROM r JOIN e ON e.a = r.a WHERE r.reach < e.b),
c AS (SELECT a, min(reach) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.a = w.doc_id
"""
