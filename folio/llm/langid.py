"""Language identification by string kernels.

The blended-spectrum presence kernel of two texts is the number of character n-grams (1 to 4) that both hold, divided
by the geometric mean of their numbers. Nyström landmarks, a bounded sample of labelled texts, give the feature map
K(x, landmarks) K(landmarks, landmarks)^-1/2; on it, kernel ridge regression is solved once for all languages, each
against the rest. As a kernel value is an inner product of presence vectors, the landmarks and the ridge coefficients
fold into one matrix (n-gram bucket x language), and a batch of texts is scored by one product of its presence matrix.

All languages are learned. The training sample is bounded: at most PER_LANGUAGE texts of a language, those of smallest
hash, LANDMARKS of which are landmarks; with many languages fewer of each, so that there are ALL_TEXTS or one a language,
and never more than ALL_LANDMARKS landmarks. Texts of over MOST_BYTES aren't drawn, and a language's texts end where its share of
SAMPLE_BYTES is full; their kernel rows are made in batches. The driver sees that sample alone, and one task ranks the
sample's rows of a language. Scoring is a map over all documents without shuffle.

Null texts and texts without a letter get `und` and score 0. Ties go to the language first by code point. A training set
without labelled texts gives `und` everywhere. Very long texts are read whole, in memory in proportion. Repeated rows
get equal results; extra columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import WORD

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 15
PER_LANGUAGE, ALL_TEXTS = 150, 30_000
LANDMARKS, ALL_LANDMARKS = 40, 2_000
#: Longer texts aren't drawn into training samples; and what the texts of a sample have together, but for one text a label.
MOST_BYTES, SAMPLE_BYTES = 1 << 20, 1 << 26
RIDGE = 1e-2
BATCH = 64
UNKNOWN = "und"

_A, _B = np.uint32(2654435761), np.uint32(40503)


def presence(text: str) -> np.ndarray:
    """The buckets of the n-grams that a text holds, each once."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    seen = np.zeros(BUCKETS, bool)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        if len(codes) < n:
            break
        h = (h[: len(codes) - n + 1] * _A) ^ (codes[n - 1 :] * _B + np.uint32(n))
        if n in GRAMS:
            seen[((h ^ (h >> np.uint32(15))) * _A) >> np.uint32(17)] = True
    return np.flatnonzero(seen)


def presence_matrix(texts: list[str]) -> np.ndarray:
    """Rows of unit length, so that products of rows are kernel values."""
    out = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(out, texts):
        at = presence(text)
        row[at] = 1 / np.sqrt(max(1, len(at)))
    return out


class Classifier:
    """Fitted on texts and their languages; score() gives a value for each text and language."""

    def __init__(self, texts: list[str], languages: list[str]):
        self.languages = sorted(set(languages))
        # the same number of landmarks from each language, in the sample's order; of very many languages, every so manieth
        most, own = max(1, min(LANDMARKS, ALL_LANDMARKS // len(self.languages))), defaultdict(list)
        for k, name in enumerate(languages):
            own[name].append(k)
        chosen = [k for name in self.languages for k in own[name][:most]]
        if len(chosen) > ALL_LANDMARKS:
            chosen = [chosen[k] for k in np.linspace(0, len(chosen) - 1, ALL_LANDMARKS).astype(int)]
        marks = presence_matrix([texts[k] for k in chosen])
        values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        half = (vectors[:, keep] / np.sqrt(values[keep])) @ vectors[:, keep].T
        met = [presence_matrix(texts[at : at + 512]) @ marks.T for at in range(0, len(texts), 512)]
        features = np.concatenate(met).astype(np.float64) @ half
        wanted = np.where(np.array(languages)[:, None] == np.array(self.languages)[None, :], 1.0, -1.0)
        share = np.array([1 / len(own[x]) for x in languages])  # each language weighs the same
        gram = features.T @ (features * share[:, None]) + RIDGE / len(self.languages) * np.eye(features.shape[1])
        ridge = np.linalg.solve(gram, features.T @ (wanted * share[:, None]))
        self.weights = (marks.T @ (half @ ridge)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        return presence_matrix(texts) @ self.weights


def bounded_sample(df: DataFrame, label: str, key: list[str], most: dict, keep=()) -> DataFrame:
    """At most most[x] rows of each label x, those whose key has the smallest hash; label, key and keep only.

    A first cut by hash leaves each label little more than it needs, whatever the table's size, so the ranking that
    follows, a task a label, is of a bounded number of rows.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}  # a row a label
    rows = [(x, k, 1_000_000 if counts[x] <= 2 * k + 1000 else 1_000_000 * (2 * k + 1000) // counts[x] + 1) for x, k in most.items() if counts.get(x)]
    draw, kind = F.xxhash64(F.lit("sample"), *key), df.schema[label].dataType.simpleString()
    bounds = F.broadcast(df.sparkSession.createDataFrame(rows, f"{label} {kind}, _most int, _parts long"))
    near = df.select(label, *key, *keep).join(bounds, label).filter(F.pmod(draw, F.lit(1_000_000)) < F.col("_parts"))
    first = Window.partitionBy(label).orderBy(draw, *key)
    return near.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= F.col("_most")).select(label, *key, *keep)


def within_bytes(rows: DataFrame, label: str, key: list[str], text: str, most: int) -> DataFrame:
    """Of a bounded sample the rows of each label, in the order of their hash, until they have `most` bytes of text together."""
    first = Window.partitionBy(label).orderBy(F.xxhash64(F.lit("sample"), *key), *key)
    before = F.sum(F.octet_length(text)).over(first.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.octet_length(text)
    return rows.withColumn("_before", before).filter(F.col("_before") < most).drop("_before")


def training_rows(documents: DataFrame, held_out: Column, most: int = PER_LANGUAGE) -> tuple[list[str], list[str]]:
    """Texts and languages of the bounded sample, in a fixed order."""
    allowed = documents.filter(~held_out & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang")
    languages = [r["lang"] for r in allowed.select("lang").distinct().collect()]  # a row a language
    if not languages:
        return [], []
    per_language = max(1, min(most, ALL_TEXTS // len(languages)))
    usable = allowed.filter(F.col("text").rlike(WORD) & (F.octet_length("text") <= MOST_BYTES))
    drawn = bounded_sample(usable, "lang", ["doc_id", "text"], {x: per_language for x in languages})
    rows = within_bytes(drawn, "lang", ["doc_id", "text"], "text", max(1, SAMPLE_BYTES // len(languages))).collect()
    rows.sort(key=lambda r: (r["lang"], r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [r["lang"] for r in rows]


def identify(documents: DataFrame, classifier: Classifier | None, text: str = "text", keep=("doc_id", "held_out")) -> DataFrame:
    """The columns keep, with lang_pred and score."""
    model = documents.sparkSession.sparkContext.broadcast(classifier)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fitted = model.value
        for batch in batches:
            texts = [x if isinstance(x, str) and any(map(str.isalpha, x)) else None for x in batch["_text"]]
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            known = [k for k, x in enumerate(texts) if x is not None] if fitted else []
            for at in range(0, len(known), BATCH):
                rows = known[at : at + BATCH]
                got = fitted.score([texts[k] for k in rows])
                best = got.argmax(axis=1)
                for k, b, s in zip(rows, best, got[np.arange(len(rows)), best]):
                    names[k], scores[k] = fitted.languages[b], min(1.0, max(0.0, (float(s) + 1) / 2))
            yield batch.drop(columns="_text").assign(lang_pred=names, score=scores)

    rows = documents.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{schema}, lang_pred string, score double")


def third(doc_id: str = "doc_id") -> Column:
    """Whether a row is held out: crc32 of the doc_id as text leaves 1 on division by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts, languages = training_rows(docs, third())
    fitted = Classifier(texts, languages) if texts else None
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))  # text, as pandas turns integers with nulls into floats
    out = identify(docs.select(key.alias("key"), third().alias("held_out"), "text"), fitted, keep=("key", "held_out"))
    return out.select(F.when(F.col("key") != "", F.col("key")).cast("long").alias("doc_id"), "held_out", "lang_pred", "score")
