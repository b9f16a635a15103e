"""Toxicity scores: a bidirectional gated recurrent network with attention pooling, over word and character inputs.

A word enters as the embedding of its hash and the mean embedding of its character trigrams. Windows of WINDOW words,
every STRIDE words, overlap and cover the whole text; each is read forwards and backwards by gated recurrent units,
pooled by attention and scored by a logistic unit. A document's score is that of its most toxic window.

The network is trained in numpy on the driver, on a bounded sample of labelled documents: at most PER_LABEL of
each label, those of smallest hash, and at most ROWS_PER_ID rows of a doc_id; texts of over MOST_BYTES aren't drawn, and
a label's texts end where half of SAMPLE_BYTES is full. One task ranks the sample's ids of a label, some thousands
whatever the table. As only documents are labelled, all windows of a toxic document count as toxic at first, and then only
those that the network finds most toxic. Scoring is a map over all documents without shuffle, with the network (some hundred
KB, whatever the corpus) as a broadcast.

Null, empty and blank texts score 0. Rows of `labels` without doc_id or label aren't used; without labels of both kinds
every score is 0. Equal scores (ties) stay equal. Several labels of a doc_id count as toxic if one is. Repeated rows get equal scores; very long texts
are read whole, in chunks of windows. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.langid import MOST_BYTES, SAMPLE_BYTES, bounded_sample, third, within_bytes
from folio.llm.shared import WORD

WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GRAM_BUCKETS = 8192, 4096
WORD_SIZE, GRAM_SIZE, HIDDEN = 12, 8, 8
#: Documents of a label in the training sample: toxic ones, others.
PER_LABEL = {1: 700, 0: 1800}
ROWS_PER_ID = 3
EPOCHS, BATCH, RATE = 4, 128, 0.01
#: Small samples are gone through until so many steps are made.
LEAST_STEPS = 400
#: Share of word embeddings that a step leaves out, so that a word of one document isn't learned by heart, and their decay a step.
DROPPED, DECAY = 0.5, 0.002
CHUNK = 1024
TOXIC_AT = 0.7
_EDGES = ".,;:!?\"'()[]|#*$%&"


def normal(word: str) -> str:
    return word.strip(_EDGES).lower()


def gram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of all words, marked at both ends, and where each word's begin."""
    marked = [b"\x02" + w.encode("utf-8", "surrogatepass") + b"\x03\x03" for w in words]
    starts = np.cumsum([0] + [len(m) for m in marked])
    data = np.frombuffer(b"".join(marked) + b"\x03\x03", np.uint8).astype(np.uint32)
    grams = (data[:-2] * np.uint32(65599) + data[1:-1]) * np.uint32(65599) + data[2:]
    # the last two of a word's grams reach into the next word; they follow the end mark, which is all they keep
    ends = starts[1:]
    grams[ends - 1] = 1
    grams[ends - 2] = 2
    return ((grams * np.uint32(2654435761)) >> np.uint32(20)).astype(np.int64) % GRAM_BUCKETS, starts[:-1]


def windows(n: int) -> np.ndarray:
    """Starts of the windows that cover n words."""
    return np.arange(1 + max(0, -(-(n - WINDOW) // STRIDE))) * STRIDE


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Parameters, training by Adam, and the projections that scoring uses."""

    def __init__(self, seed: int = 11):
        self.rng = rng = np.random.default_rng(seed)
        d, h = WORD_SIZE + GRAM_SIZE, HIDDEN
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "words": (0.1 * rng.standard_normal((WORD_BUCKETS, WORD_SIZE))).astype(np.float32),
            "grams": (0.1 * rng.standard_normal((GRAM_BUCKETS, GRAM_SIZE))).astype(np.float32),
            "attend": np.zeros(2 * h, np.float32),
            "out": (0.1 * rng.standard_normal(2 * h)).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }
        for side in "fb":
            self.p |= {f"w{side}": draw(d, 3 * h), f"u{side}": draw(h, 3 * h), f"c{side}": np.zeros(3 * h, np.float32)}
        self.moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        self.steps = 0

    def inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Inputs of normal words, with what the gradient needs: word buckets, gram buckets and their starts."""
        at = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in words], np.int64)
        grams, starts = gram_buckets(words)
        n = np.diff(np.append(starts, len(grams)))
        mean = np.add.reduceat(self.p["grams"][grams], starts, axis=0) / n[:, None].astype(np.float32)
        return np.hstack([self.p["words"][at], mean]), at, grams, n

    def run(self, x: np.ndarray, side: str, trace: list | None = None) -> np.ndarray:
        """States (T, B, HIDDEN) for projected inputs x (T, B, 3 * HIDDEN), by place in the window."""
        h = HIDDEN
        u = self.p[f"u{side}"]
        out = np.empty((len(x), x.shape[1], h), np.float32)
        state = np.zeros((x.shape[1], h), np.float32)
        for t in range(len(x)) if side == "f" else reversed(range(len(x))):
            state = self._step(x[t], state, u, trace)
            out[t] = state
        return out

    @staticmethod
    def _step(x: np.ndarray, state: np.ndarray, u: np.ndarray, trace: list | None = None) -> np.ndarray:
        h = HIDDEN
        a = state @ u
        gates = _sigmoid(x[:, : 2 * h] + a[:, : 2 * h])
        keep, reset = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + reset * a[:, 2 * h :])
        if trace is not None:
            trace.append((state, keep, reset, new, a[:, 2 * h :]))
        return new + keep * (state - new)

    def _pooled(self, states: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits, attention (T, B) and pooled states for states (T, B, 2 * HIDDEN)."""
        e = states @ self.p["attend"]
        e = np.where(mask, e, np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        attention = e / e.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", attention, states)
        return pooled @ self.p["out"] + self.p["bias"][0], attention, pooled

    def train(self, ids: np.ndarray, words: list[str], y: np.ndarray, weight: np.ndarray) -> None:
        """One step on windows of ids (B, T) into words, whose first is the padding."""
        used, local = np.unique(ids, return_inverse=True)
        x, at, grams, n = self.inputs([words[k] for k in used])
        stays = (self.rng.random(len(used)) >= DROPPED).astype(np.float32)[:, None]
        x[:, :WORD_SIZE] *= stays
        local = local.reshape(ids.shape).T
        mask = ids.T > 0
        traces = {"f": [], "b": []}
        states = np.concatenate([self.run((x @ self.p[f"w{s}"] + self.p[f"c{s}"])[local], s, traces[s]) for s in "fb"], axis=2)
        logits, attention, pooled = self._pooled(states, mask)
        grads = {}
        d_logit = (_sigmoid(logits) - y) * weight / len(y)
        grads["out"], grads["bias"] = pooled.T @ d_logit, np.array([d_logit.sum()])
        d_pooled = d_logit[:, None] * self.p["out"]
        through = np.einsum("tbh,bh->tb", states, d_pooled)
        d_e = attention * (through - (attention * through).sum(axis=0))
        grads["attend"] = np.einsum("tb,tbh->h", d_e, states)
        d_states = attention[:, :, None] * d_pooled + d_e[:, :, None] * self.p["attend"]
        d_x = np.zeros_like(x)
        h = HIDDEN
        for k, side in enumerate("fb"):
            u, trace = self.p[f"u{side}"], traces[side]
            d_gx = np.empty((len(mask), len(y), 3 * h), np.float32)
            d_u, d_state = np.zeros_like(u), np.zeros((len(y), h), np.float32)
            places = list(range(len(mask))) if side == "f" else list(reversed(range(len(mask))))
            for t, (before, keep, reset, new, a_new) in zip(reversed(places), reversed(trace)):
                d_state = d_state + d_states[t, :, k * h : (k + 1) * h]
                d_new = d_state * (1 - keep) * (1 - new * new)
                d_keep = d_state * (before - new) * keep * (1 - keep)
                d_reset = d_new * a_new * reset * (1 - reset)
                d_gx[t] = np.hstack([d_keep, d_reset, d_new])
                d_a = np.hstack([d_keep, d_reset, d_new * reset])
                d_u += before.T @ d_a
                d_state = d_state * keep + d_a @ u.T
            flat = np.zeros((len(x), 3 * h), np.float32)
            np.add.at(flat, local.ravel(), d_gx.reshape(-1, 3 * h))
            grads[f"u{side}"], grads[f"w{side}"], grads[f"c{side}"] = d_u, x.T @ flat, flat.sum(axis=0)
            d_x += flat @ self.p[f"w{side}"].T
        grads["words"], grads["grams"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["grams"])
        np.add.at(grads["words"], at, d_x[:, :WORD_SIZE] * stays)
        np.add.at(grads["grams"], grams, np.repeat(d_x[:, WORD_SIZE:] / n[:, None], n, axis=0))
        self._adam(grads)

    def _adam(self, grads: dict[str, np.ndarray]) -> None:
        self.steps += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        for k in ("words", "grams"):
            self.p[k] *= 1 - DECAY
        for k, g in grads.items():
            m, v = self.moments[k]
            m += 0.1 * (g * scale - m)
            v += 0.01 * ((g * scale) ** 2 - v)
            self.p[k] -= (RATE * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)).astype(np.float32)


class Scorer:
    """A trained network with the projected inputs of the words that it has met."""

    def __init__(self, network: Network, most: int = 200_000):
        self.network, self.most = network, most
        self._forget()

    def _forget(self) -> None:
        self.place, self.known = {}, 1
        self.projected = np.zeros((1 << 14, 6 * HIDDEN), np.float32)
        self._project([""], 0)

    def _project(self, words: list[str], start: int) -> None:
        p = self.network.p
        x = self.network.inputs(words)[0]
        while start + len(words) > len(self.projected):
            self.projected = np.concatenate([self.projected, np.zeros_like(self.projected)])
        self.projected[start : start + len(words)] = np.hstack([x @ p[f"w{s}"] + p[f"c{s}"] for s in "fb"])

    def ids(self, words: list[str]) -> np.ndarray:
        place = self.place
        fresh = list(dict.fromkeys(w for w in words if w not in place))
        if fresh:
            self._project([normal(w) for w in fresh], self.known)
            place.update(zip(fresh, range(self.known, self.known + len(fresh))))
            self.known += len(fresh)
        return np.fromiter(map(place.__getitem__, words), np.int64, len(words))

    def score_windows(self, ids: np.ndarray) -> np.ndarray:
        """Scores of windows (B, T); 0 is padding."""
        net, out = self.network, np.empty(len(ids))
        for at in range(0, len(ids), CHUNK):
            own = ids[at : at + CHUNK].T
            states = np.empty((*own.shape, 2 * HIDDEN), np.float32)
            for k, side in enumerate("fb"):
                u, half = net.p[f"u{side}"], self.projected[:, 3 * k * HIDDEN : 3 * (k + 1) * HIDDEN]
                state = np.zeros((own.shape[1], HIDDEN), np.float32)
                for t in range(WINDOW) if side == "f" else reversed(range(WINDOW)):
                    state = net._step(half[own[t]], state, u)
                    states[t, :, k * HIDDEN : (k + 1) * HIDDEN] = state
            out[at : at + CHUNK] = _sigmoid(net._pooled(states, own > 0)[0])
        return out

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """The score of each text."""
        if self.known > self.most:
            self._forget()
        cut, owner = [], []
        for k, text in enumerate(texts):
            words = (text or "").split()
            if words:
                starts = windows(len(words))
                ids = np.zeros(starts[-1] + WINDOW, np.int64)
                ids[: len(words)] = self.ids(words)
                cut.append(ids[starts[:, None] + np.arange(WINDOW)])
                owner.append(np.full(len(starts), k))
        out = np.zeros(len(texts))
        if cut:
            np.maximum.at(out, np.concatenate(owner), self.score_windows(np.concatenate(cut)))
        return out


def fit(texts: list[str], labels: list[int], seed: int = 11, epochs: int = EPOCHS) -> Network | None:
    """A network trained on labelled texts; none if a label is missing."""
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    place: dict[str, int] = {"": 0}
    cut, owner = [], []
    for k, text in enumerate(texts):
        words = [normal(w) for w in text.split()]
        starts = windows(len(words))
        ids = np.zeros(starts[-1] + WINDOW, np.int64)
        ids[: len(words)] = [place.setdefault(w, len(place)) for w in words]
        cut.append(ids[starts[:, None] + np.arange(WINDOW)])
        owner.append(np.full(len(starts), k))
    ids, owner, y = np.concatenate(cut), np.concatenate(owner), np.array(labels, np.float32)
    words, toxic, network = list(place), y[owner] > 0, Network(seed)
    chosen = np.ones(len(ids), bool)
    epoch = 0
    while epoch < epochs or network.steps < LEAST_STEPS:
        if epoch:
            scorer = Scorer(network)
            scorer._project(words[1:], 1)
            got = scorer.score_windows(ids)
            best = np.zeros(len(y))
            np.maximum.at(best, owner, got)
            chosen = ~toxic & ((got > 0.05) | (rng.random(len(ids)) < 0.15)) | toxic & (got >= 0.9 * best[owner])
        rows = rng.permutation(np.flatnonzero(chosen))
        share = toxic[rows].mean()
        weight = np.where(toxic[rows], 0.5 / max(share, 0.02), 0.5 / max(1 - share, 0.02)).astype(np.float32)
        for at in range(0, len(rows), BATCH):
            own = rows[at : at + BATCH]
            network.train(ids[own], words, y[owner[own]], weight[at : at + BATCH])
        epoch += 1
    return network


def training_rows(documents: DataFrame, labels: DataFrame, most: dict[int, int] = PER_LABEL) -> tuple[list[str], list[int]]:
    """Texts and labels of the bounded sample, in a fixed order; held-out rows never are among them."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~third())
    chosen = bounded_sample(usable, "toxic", ["doc_id"], most)
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.col("text").rlike(WORD) & (F.octet_length("text") <= MOST_BYTES))
    few = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))
    rows = rows.withColumn("_n", few).filter(F.col("_n") <= ROWS_PER_ID).drop("_n")  # ROWS_PER_ID * sum(most) at most
    rows = within_bytes(rows, "toxic", ["doc_id", "text"], "text", SAMPLE_BYTES // 2).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score(documents: DataFrame, network: Network | None, text: str = "text", keep=("doc_id",)) -> DataFrame:
    """The columns keep, with score."""
    model = documents.sparkSession.sparkContext.broadcast(network and network.p)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = None
        if model.value:
            bare = Network.__new__(Network)
            bare.p = model.value
            scorer = Scorer(bare)
        for batch in batches:
            scores = np.zeros(len(batch))
            for at in range(0, len(batch), 256) if scorer else ():
                scores[at : at + 256] = scorer(list(batch["_text"].iloc[at : at + 256]))
            yield batch.drop(columns="_text").assign(score=scores)

    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{schema}, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    network = fit(*training_rows(docs, labels))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    out = score(docs.select(key.alias("key"), third().alias("held_out"), "text"), network, keep=("key", "held_out"))
    return out.select(F.when(F.col("key") != "", F.col("key")).cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))
