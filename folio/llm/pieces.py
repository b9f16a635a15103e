"""SentencePiece encoding and decoding by vectorised merge rounds.

A text becomes a blank mark, then itself with blanks as marks; it is cut into words before each run of marks, as no piece
has a mark behind another letter, and each distinct word is encoded once. The words of a batch lie in one flat array of
symbols, cut again wherever two neighbours stand side by side in no piece. Each round takes every word's smallest pair
rank, merges the leftmost pairs of that rank that don't overlap, all words at once, looks up the pairs around the merged
symbols, and drops words in which no pair is left; a word takes at most as many rounds as it has different ranks.

Merging all pairs of a rank at once equals merging one after another unless a merged symbol makes a pair of no larger rank
with its neighbour. The vocabulary tells which pieces can do that (longer pieces that stand before one of their parts, and
runs of marks, which have equal scores); a word in which it happens is merged through that rank from left to right, in
time in proportion to its length.

Decoding gathers the pieces' letters; bytes that are no whole character are read as U+FFFD each.

Null texts are empty; an empty text has no ids but the end id. Blanks, tabs, line ends and zeros are kept. Letters outside
the vocabulary are their UTF-8 bytes. Very long texts, and very long words, are encoded whole. Ties of rank go to the
left. Repeated rows give equal results, an empty table gives none. Both functions work on columns, so no name can clash.
Null ids decode to an empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Words that lie in one array.
AT_ONCE = 20_000
#: Letters of texts that are cut into words at once, if no text is longer.
LETTERS = 1_000_000
#: Ids that are looked up in one array.
GATHERED = 1_000_000
#: Longer words aren't remembered from batch to batch.
SHORT = 64
#: Words that a worker remembers, at most; all are forgotten when there are more.
REMEMBERED = 450_000

_WIDE = 1 << 21  # more than all pieces and code points together
_NONE = np.iinfo(np.int32).max
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class _Places:
    """Where numbers stand in a list, by open addressing; find works on arrays."""

    def __init__(self, numbers: np.ndarray):
        self.bits = max(4, (4 * len(numbers)).bit_length())
        self.keys, self.at = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        rest = np.arange(len(numbers))
        slot = self._slot(numbers)
        while len(rest):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.at[slot[free]] = numbers[rest[free]], rest[free]  # the last of equal slots stays
            lost = self.keys[slot] != numbers[rest]
            rest, slot = rest[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, numbers: np.ndarray) -> np.ndarray:
        """The place of each number, -1 for those that aren't there."""
        slot = self._slot(numbers)
        held = self.keys[slot]
        out = np.where(held == numbers, self.at[slot], -1)
        open_ = np.flatnonzero((held != numbers) & (held >= 0))
        while len(open_):
            slot_ = (slot[open_] + 1) & ((1 << self.bits) - 1)
            slot[open_] = slot_
            held = self.keys[slot_]
            same = held == numbers[open_]
            out[open_[same]] = self.at[slot_[same]]
            open_ = open_[~same & (held >= 0)]
        return out


class Pieces:
    """The tables of a BPE vocabulary with byte fallback, whose normalizer changes blanks alone."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        probe = " a  \tﬁ\n"
        if sp.normalize(probe) != MARK + probe.replace(" ", MARK) or any(map(sp.is_unused, range(sp.get_piece_size()))):
            raise ValueError("the model normalizes texts or has unused pieces")
        self.size, self.end, self.unknown = sp.get_piece_size(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(self.size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.bytes = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.letters = [b""] * self.size
        for i in plain:
            self.letters[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        self.letters[self.unknown] = " ⁇ ".encode()
        self.byte_of = {int(i): b for b, i in enumerate(self.bytes)}
        for i, b in self.byte_of.items():
            self.letters[i] = bytes([b])
        self.spelling = _Strings(self.letters)
        self.decimals = _Strings([b" %d" % i for i in range(self.size)])
        self.marked = np.array([x[:1] == b" " and i != self.unknown for i, x in enumerate(self.letters)])
        for i in self.byte_of:
            self.marked[i] = False
        scores = np.array([sp.get_score(i) for i in range(self.size)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)

        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size  # of a code point: its piece, else one of its own
        made: dict[int, int] = {}
        beside: set[int] = set()
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
            for k in range(1, len(piece)):
                left, right = self._part(piece[:k]), self._part(piece[k:])
                if left is not None and right is not None:
                    made[left * _WIDE + right] = i
                beside.add(ord(piece[k - 1]) * _WIDE + ord(piece[k]))
        pairs = np.fromiter(made, np.int64, len(made))
        self.pairs, self.makes = _Places(pairs), np.fromiter(made.values(), np.int32, len(made))
        self.made = made
        self.beside = _Places(np.fromiter(beside, np.int64, len(beside)))
        #: Pieces that can make a pair of no larger rank than their own.
        self.hasty = np.zeros(self.size, bool)
        left, right = pairs // _WIDE, pairs % _WIDE
        for part in (left, right):
            known = part < self.size
            early = self.rank[self.makes[known]] <= self.rank[part[known]]
            self.hasty[part[known][early]] = True
        #: Words behind a blank mark, without it, and others; both remember their ids as bytes.
        self.behind: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        self.lines = not any("\n" in p for p in self.ids)
        self.newline = self._spelt(self.symbol[[10]]).astype("<i4").tobytes()
        self.cuts = _WORDS if not any(MARK in p.lstrip(MARK) for p in self.ids) else re.compile("(?s).+")

    def _part(self, part: str) -> int | None:
        known = self.ids.get(part)
        return self.size + ord(part) if known is None and len(part) == 1 else known

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 for none."""
        keys = left.astype(np.int64) * _WIDE + right
        at = self.pairs.find(keys)
        return np.where(at >= 0, self.makes[at], -1)

    def ranks(self, pieces: np.ndarray) -> np.ndarray:
        return np.where(pieces < 0, _NONE, self.rank[pieces])

    # --- encoding ----------------------------------------------------------------------------------------------------

    def _sweep(self, symbols: list[int], rank: int) -> list[int]:
        """Merges of a rank from left to right, each followed by those of no larger rank that it makes possible."""
        made, order, done = self.made, self.rank, []
        rest = symbols[::-1]  # its last is next
        while rest:
            done.append(rest.pop())
            while True:
                before = made.get(done[-2] * _WIDE + done[-1], -1) if len(done) > 1 else -1
                after = made.get(done[-1] * _WIDE + rest[-1], -1) if rest else -1
                options = [(int(order[p]), side, p) for side, p in enumerate((before, after)) if p >= 0 and order[p] <= rank]
                if not options:
                    break
                _, side, piece = min(options)
                if side:
                    rest.pop()
                else:
                    done.pop()
                done[-1] = piece
        return done

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words, one after another, and the word of each."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), sizes)
        keys = points[:-1] * _WIDE + points[1:]
        joined = (self.beside.find(keys) >= 0) & (word[:-1] == word[1:])
        part = np.concatenate(([0], np.cumsum(~joined))) if len(points) else word  # parts of words that no merge joins
        symbols = self.symbol[points]
        makes = np.full(len(symbols), -1, np.int32)
        makes[:-1][joined] = self.pair(symbols[:-1][joined], symbols[1:][joined])
        ranks = self.ranks(makes)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(symbols):
            first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            length = np.diff(np.append(first, len(symbols)))
            least = np.minimum.reduceat(ranks, first)
            alive = np.repeat(least < _NONE, length)
            if not alive.all():
                done.append((part[~alive], word[~alive], symbols[~alive]))
                part, word, symbols, makes, ranks = part[alive], word[alive], symbols[alive], makes[alive], ranks[alive]
                length = length[least < _NONE]
                least = least[least < _NONE]
                if not len(symbols):
                    break
            pos = np.flatnonzero(ranks == np.repeat(least, length))
            begins = np.concatenate(([True], np.diff(pos) != 1))
            run = pos[np.flatnonzero(begins)][np.cumsum(begins) - 1]
            pos = pos[(pos - run) % 2 == 0]
            piece = makes[pos]
            if self.hasty[piece].any():
                hasty = self._too_early(part, symbols, ranks, pos, piece)
                if hasty is not None:
                    swept = np.isin(part, hasty)
                    fresh = self._swept(part[swept], word[swept], symbols[swept], ranks[swept])
                    own = ~np.isin(part[pos], hasty)
                    kept, pos, piece = ~swept, pos[own], piece[own]
                    symbols[pos] = piece
                    kept[pos + 1] = False
                    part, word, symbols = (np.concatenate((a[kept], b)) for a, b in zip((part, word, symbols), fresh))
                    makes = np.full(len(symbols), -1, np.int32)
                    same = part[:-1] == part[1:]
                    makes[:-1][same] = self.pair(symbols[:-1][same], symbols[1:][same])
                    ranks = self.ranks(makes)
                    continue
            symbols[pos] = piece
            kept = np.ones(len(symbols), bool)
            kept[pos + 1] = False
            place = pos - np.arange(len(pos))  # of merged symbols, once the right ones are gone
            part, word, symbols, makes, ranks = part[kept], word[kept], symbols[kept], makes[kept], ranks[kept]
            anew = np.concatenate((place, place[place > 0] - 1))
            makes[anew], ranks[anew] = -1, _NONE
            anew = anew[anew < len(symbols) - 1]
            anew = anew[part[anew] == part[anew + 1]]
            makes[anew] = pieces = self.pair(symbols[anew], symbols[anew + 1])
            ranks[anew] = self.ranks(pieces)
        if not done:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        part, word, symbols = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(part, kind="stable")
        return symbols[order], word[order]

    def _too_early(self, part, symbols, ranks, pos, piece) -> np.ndarray | None:
        """The parts in which a merge makes a pair of no larger rank, None if there are none."""
        n = len(symbols)
        follows = np.concatenate(([False], np.diff(pos) == 2))  # the symbol on the left is the merge before
        left = np.where(follows, np.concatenate(([0], piece[:-1])), symbols[np.maximum(pos - 1, 0)])
        has_left = (pos > 0) & (part[np.maximum(pos - 1, 0)] == part[pos])
        right_at = np.minimum(pos + 2, n - 1)
        has_right = (pos + 2 < n) & (part[right_at] == part[pos])
        own = self.rank[piece]
        early = (has_left & (self.ranks(self.pair(left, piece)) <= own)) | (has_right & (self.ranks(self.pair(piece, symbols[right_at])) <= own))
        return np.unique(part[pos[early]]) if early.any() else None

    def _swept(self, part, word, symbols, ranks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, words, out = [], [], []
        bounds = np.append(np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))), len(part))
        for a, b in zip(bounds[:-1], bounds[1:]):
            merged = self._sweep(symbols[a:b].tolist(), int(ranks[a:b].min()))
            parts.append(np.full(len(merged), part[a]))
            words.append(np.full(len(merged), word[a]))
            out.append(np.array(merged, symbols.dtype))
        return np.concatenate(parts), np.concatenate(words), np.concatenate(out)

    def _spelt(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as ids, those outside the vocabulary as the ids of their bytes."""
        out = []
        for s in symbols.tolist():
            out += [s] if s < self.size else self.bytes[list(chr(s - self.size).encode())].tolist()
        return np.array(out, np.int32)

    def encode(self, texts: list[str | None], end: bool = True) -> list[np.ndarray]:
        return list(self.encoded(texts, end))

    def encoded(self, texts: Iterable[str | None], end: bool = True) -> Iterator[np.ndarray]:
        """The ids of each text; so many texts at once that their words take little memory."""
        some, letters = [], 0
        for t in texts:
            some.append(t)
            letters += len(t or "")
            if letters >= LETTERS:
                yield from self._encoded(some, end)
                some, letters = [], 0
        yield from self._encoded(some, end)

    def _cut(self, text: str) -> list[list[str]] | None:
        """A text's lines as words between single blanks; None if it must be cut by the marks."""
        if not self.lines or MARK in text or "  " in text or text[0] == " " or text[-1] == " " or " \n" in text or "\n " in text:
            return None
        return [line.split(" ") for line in text.split("\n")]

    def _encoded(self, texts: list[str | None], end: bool) -> list[np.ndarray]:
        plain = [self._cut(t) if t else None for t in texts]
        marked = [self.cuts.findall(MARK + t.replace(" ", MARK)) if t and p is None else [] for t, p in zip(texts, plain)]
        if len(self.behind) + len(self.others) > REMEMBERED:
            self.behind, self.others = {}, {}
        # a line's first word has no mark before it, but for the text's first
        behind = set().union(*(w[1:] for p in plain if p for w in p), (p[0][0] for p in plain if p)).difference(self.behind)
        others = set().union((w[0] for p in plain if p for w in p[1:]), *marked).difference(self.others)
        long = self._learn(behind, self.behind, MARK) | self._learn(others, self.others, "")
        tail = np.array([self.end], "<i4").tobytes() if end else b""
        find, find_other = self.behind.__getitem__, self.others.__getitem__
        if long:
            find = lambda w: self.behind.get(w) or long[MARK + w]
            find_other = lambda w: self.others[w] if w in self.others else long[w]
        out = []
        for p, m in zip(plain, marked):
            if p:
                first, *rest = (b"".join(map(find, w[1:])) for w in p)
                parts = [find(p[0][0]), first]
                for w, line in zip(p[1:], rest):
                    parts += [self.newline, find_other(w[0]), line]
                out.append(np.frombuffer(b"".join(parts) + tail, "<i4"))
            else:
                out.append(np.frombuffer(b"".join(map(find_other, m)) + tail, "<i4"))
        return out

    def _learn(self, words: set[str], known: dict[str, bytes], before: str) -> dict[str, bytes]:
        """Adds the ids of words, with what stands before them, to known; those of long ones are returned."""
        listed, long = list(words), {}
        for at in range(0, len(listed), AT_ONCE):
            some = listed[at : at + AT_ONCE]
            symbols, word = self.merged([before + w for w in some] if before else some)
            bounds = np.searchsorted(word, np.arange(len(some) + 1)).tolist()
            raw = symbols.astype("<i4").tobytes()
            known.update(zip(some, [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:])]))
            for k in np.unique(word[symbols >= self.size]).tolist():
                known[some[k]] = self._spelt(symbols[bounds[k] : bounds[k + 1]]).astype("<i4").tobytes()
            for w in some:
                if len(w) > SHORT:
                    long[before + w] = known.pop(w)
        return long

    # --- decoding ----------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray | list[int] | None) -> str:
        ids = np.asarray([] if ids is None else ids, np.int64)
        heard = np.flatnonzero(self.spelling.sizes[ids])[:1]  # the first that is no control
        bare = len(heard) and self.marked[ids[heard[0]]]  # the mark that was put before the text goes
        raw = self.spelling.joined(ids)
        try:
            return (raw[1:] if bare else raw).decode()
        except UnicodeDecodeError:
            pass
        out, run = [], bytearray()
        for i in [*ids.tolist(), -1]:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out.append(_whole_characters(bytes(run)))
            run.clear()
            out.append(self.letters[i].decode() if i >= 0 else "")
        text = "".join(out)
        return text[1:] if bare else text

    def listed(self, ids: np.ndarray) -> bytes:
        """Ids as decimal numbers with a blank before each."""
        return self.decimals.joined(np.asarray(ids, np.int64))


class _Strings:
    """Byte strings by number; joined gathers many at once."""

    def __init__(self, strings: list[bytes]):
        self.flat = np.frombuffer(b"".join(strings), np.uint8)
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def joined(self, numbers: np.ndarray) -> bytes:
        return b"".join(self._joined(numbers[k : k + GATHERED]) for k in range(0, len(numbers), GATHERED))

    def _joined(self, numbers: np.ndarray) -> bytes:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at].tobytes()


def _whole_characters(run: bytes) -> str:
    """Bytes as characters, each that belongs to none as U+FFFD."""
    out, k = [], 0
    while k < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[k : k + n].decode())
                k += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            k += 1
    return "".join(out)


_models: dict[str, Pieces] = {}


def model(path: str) -> Pieces:
    """This process's model: a worker keeps what it has learned from task to task."""
    return _models.get(path) or _models.setdefault(path, Pieces(path))


def encode(text: Column, path: str | None = None, end: bool = True) -> Column:
    """The ids of a text, with the end id behind them if end."""
    where = path or public_tokenizers.path(MODEL)

    @F.pandas_udf(ArrayType(IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(where)
        for texts in batches:
            yield pd.Series(own.encode(texts.tolist(), end), texts.index, dtype=object)

    return ids(text)


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of ids."""
    where = path or public_tokenizers.path(MODEL)

    @F.pandas_udf(StringType())
    def texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model(where)
        for listed in batches:
            yield pd.Series([own.decode(x) for x in listed], listed.index, dtype=object)

    return texts(ids)


def digests(documents: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, the number of ids, and digests of the ids and of the text that they decode to."""
    where = path or public_tokenizers.path(MODEL)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = model(where)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], own.encoded(batch["text"])):
                rows.append((doc_id, len(ids), sha256(own.listed(ids)[1:]).hexdigest(), sha256(own.decode(ids).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    keyed = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # as pandas makes doubles of integers beside nulls
    found = keyed.mapInPandas(run, "doc_id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return found.withColumn("doc_id", F.col("doc_id").cast(documents.schema["doc_id"].dataType))


def op11_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
