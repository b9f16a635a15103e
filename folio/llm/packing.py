"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to groups by a hash of doc_id and text, and those that a task has met before by their number too, so
no key makes a large group and every group is a fair sample of lengths; each group is packed in a task of its own. A
document longer than a sequence is cut into full sequences and one rest. Pieces of a group, longest first, go to the leftmost sequence with room, which the tree finds in log n steps.

Texts are split at white space first, as the tokenizer itself drops it, and each distinct stretch is encoded once; a
text in which Python and the tokenizer may disagree is encoded whole. The ids are those of encoding the whole text.

Null and empty texts are the single end token. A null doc_id counts as a document. Repeated rows are documents of their own.
Pieces of equal length (ties) stand by doc_id, start and checksum. A very long text is encoded whole and cut into as many
pieces as it needs. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import re
import string
import unicodedata
import zlib
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 4096
END_ID = 2
#: Documents of a group, about.
GROUP = 4096
NO_ID = -(2**63)
TOKENIZER = "word_bpe_49k.json"
#: Rows whose texts a task holds as strings at a time.
ROWS = 256

#: White space to Python alone, a letter whose lower case depends on its place, and strings that the tokenizer takes out
#: of a text before it splits it.
_APART = re.compile("[\x1c-\x1fΣ]|<\\|startoftext\\|>|<\\|endoftext\\|>")


#: Marks that the tokenizer parts from letters wherever they stand; the apostrophe isn't one, as it makes contractions.
_MARKS = string.punctuation.replace("'", "")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for 256 and so on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(k if k in plain else next(others)) for k in range(256)]


class Encoder:
    """Texts to arrays of ids; remembers the ids of words, of their letters and of their marks, each string once.

    A word of letters with marks around it is the marks' ids and the letters' own, which the model gives without the
    steps before it; any other stretch between white space goes through the whole tokenizer. About `most` strings are
    remembered: once half of them are new, those that haven't been met meanwhile are forgotten.
    """

    def __init__(self, path: str, most: int = 300_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.letters = Tokenizer.from_file(path), most, _byte_letters()
        self.model = self.tokenizer.model
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        self.earlier: dict[str, bytes] = {}

    def _remembered(self, string: str, find: Callable[[str], bytes]) -> bytes:
        ids = self.known.get(string)
        if ids is None:
            ids = self.earlier.get(string)
            self.known[string] = ids = find(string) if ids is None else ids
        return ids

    def _whole(self, stretch: str) -> bytes:
        return np.array(self.tokenizer.encode(stretch, add_special_tokens=False).ids, "<u4").tobytes()

    def _core(self, core: str) -> bytes:
        spelt = core if core.isascii() else "".join(map(self.letters.__getitem__, core.encode()))
        return array("I", [t.id for t in self.model.tokenize(spelt)]).tobytes()

    def _word(self, word: str) -> bytes:
        if "\u0130" in word:  # the one letter whose lower case has a mark, at which the tokenizer parts the word
            return self._whole(word)
        if word.isalpha():
            return self._remembered(word.lower(), self._core)
        core = word.strip(_MARKS)
        if not core.isalpha():
            return self._whole(word)
        head, _, tail = word.partition(core)
        return self._remembered(head, self._whole) + self._word(core) + self._remembered(tail, self._whole)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        if _APART.search(text) or not unicodedata.is_normalized("NFC", text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.known) > self.most // 2:
            self.earlier, self.known = self.known, {}
        words, known = text.split(), self.known
        for word in set(words).difference(known):
            self._remembered(word, self._word)
        return np.frombuffer(b"".join(map(known.__getitem__, words)), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder: a worker keeps what it has learned from task to task."""
    return _encoders.get(path) or _encoders.setdefault(path, Encoder(path))


class Tournament:
    """Capacities of bins in a binary tree whose inner nodes hold the larger child's; finds the first bin with room."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> tuple[int, int]:
        """Puts size into the leftmost bin that holds it; the bin, and its room before."""
        tree, node = self.tree, 1
        while node < self.leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        room = tree[node]
        tree[node] = room - size
        bin_ = node - self.leaves
        while node > 1:
            node //= 2
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
        return bin_, room


def first_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal lengths keep their order."""
    tree = Tournament(len(lengths), capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k in np.argsort(-lengths, kind="stable"):
        bin_, room = tree.place(int(lengths[k]))
        bins[k], offsets[k] = bin_, capacity - room
    return bins, offsets


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, grp long"


def pieces(documents: DataFrame, groups: int, path: str | None = None, doc_id: str = "doc_id", text: str = "text", capacity: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece, with its group, and with its ids if with_ids."""
    where = path or public_tokenizers.path(TOKENIZER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, met, task = encoder(where), Counter(), TaskContext.get().partitionId()
        kinds = {c: pa.int64() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "grp")} | ({"ids": pa.list_(pa.int32())} if with_ids else {})
        for part in (batch.slice(at, ROWS) for batch in batches for at in range(0, batch.num_rows, ROWS)):
            rows = []
            for key, dealt_by, body in zip(*(part[c].to_pylist() for c in ("doc_id", "dealt_by", "text"))):
                met[dealt_by] += 1
                again = met[dealt_by] - 1
                grp = (zlib.crc32(f"{dealt_by} {again} {task}".encode()) if again else dealt_by) % groups
                ids = np.append(encode(body), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    own = ids[start : start + capacity]
                    rows.append((key, start, len(own), zlib.crc32(own.tobytes()), len(ids), grp, *([own.astype(np.int32)] if with_ids else [])))
            yield pa.record_batch([pa.array(values, kind) for values, kind in zip(zip(*rows), kinds.values())], list(kinds))

    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    dealt = documents.select(key.alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.lit("packing"), key, F.col(text)).alias("dealt_by"))
    return dealt.mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def pack(cut: DataFrame, capacity: int = SEQUENCE) -> DataFrame:
    """cut (as of `pieces`) with sequence_id and offset."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "start", "ids_crc32"], kind="stable")
        bins, offsets = first_fit_decreasing(group["length"].to_numpy(), capacity)
        group = group.assign(doc_id=group["doc_id"].astype("Int64").where(group["doc_id"] != NO_ID), sequence_id=group["grp"] * (1 << 32) + bins, offset=offsets)
        return group.drop(columns="grp")

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "grp")
    return cut.groupBy("grp").applyInPandas(run, f"{schema}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, with_ids: bool = False, **columns) -> DataFrame:
    groups = max(1, -(-documents.count() // GROUP))
    return pack(pieces(documents, groups, with_ids=with_ids, **columns))


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
