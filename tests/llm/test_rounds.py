"""SentencePiece against the library, collocations against counting in plain Python, Lloyd's rounds against full ones."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folio.llm import clusters, phrases, pieces

RNG = random.Random(31)
PATH = public_tokenizers.path(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return pieces.Pieces(PATH)


LETTERS = st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(list("  abcdeinorst▁\n\t")))


@settings(max_examples=300, deadline=None)
@given(st.lists(LETTERS, max_size=80).map("".join))
def test_encoding_is_the_librarys(library, own, text):
    ids = library.encode(text, add_eos=True)
    assert own.encode([text])[0].tolist() == ids
    assert own.decode(ids) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 31_999), st.integers(3, 258)), max_size=12))
def test_decoding_is_the_librarys(library, own, ids):
    assert own.decode(ids) == library.decode(ids)


@pytest.mark.parametrize("text", ["", " " * 5000, "a" * 5000, "ab" * 4000, "=" * 2001, " " * 99 + "foo" + " " * 77, "é" * 999, "日本" * 500, "▁▁ ▁", "\0\0 \0", "<s></s><unk><0x41>"])
def test_long_words_and_odd_texts(library, own, text):
    ids = library.encode(text, add_eos=True)
    assert own.encode([text])[0].tolist() == ids and own.decode(ids) == library.decode(ids)


def test_words_are_forgotten_without_loss(library, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 5)
    monkeypatch.setattr(pieces, "AT_ONCE", 3)
    small = pieces.Pieces(PATH)
    for _ in range(4):
        texts = ["".join(RNG.choice("abcdef ") for _ in range(RNG.randrange(200))) for _ in range(5)]
        assert [x.tolist() for x in small.encode(texts, end=False)] == library.encode(texts)


def test_op11_whole_table(spark, corpus, library):
    rows = [(1, "Hello, world", "a"), (1, "Hello, world", "a"), (2, None, None), (None, "", "b"), (3, "naïve  😀\n" * 2000, "b")]
    got = sorted(map(tuple, pieces.op11_sentencepiece(spark, corpus(rows)).collect()), key=repr)
    want = []
    for doc_id, text, _ in rows:
        ids = library.encode(text or "", add_eos=True)
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert pieces.op11_sentencepiece(spark, corpus([])).count() == 0


def test_columns_of_any_name_pass(spark, library):
    df = spark.createDataFrame([("a b", "x", 1)], "text string, ids string, encoded int")
    out = df.select("*", pieces.encode(F.col("text"), end=False).alias("own")).select("*", pieces.decode(F.col("own")).alias("back")).first()
    assert out["own"] == library.encode("a b") and (out["back"], out["ids"]) == ("a b", "x")
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS i").select(pieces.decode(F.col("i"))).first()[0] == ""


# --- collocations ----------------------------------------------------------------------------------------------------


def counted(rows, least, longest, best):
    """(lang, rank, phrase, a, l, r, n, score) by counting all phrases."""
    out, f, n = [], Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, *w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    for (lang, *w), a in f.items():
        if len(w) < 2 or a < least:
            continue
        if any(b >= a and x[0] == lang and len(x) - 1 > len(w) and any(list(x[i : i + len(w)]) == w for i in range(1, len(x))) for x, b in f.items()):
            continue
        score, _, left, right = min((1000 * a * n[lang] // (f[lang, *w[:k]] * f[lang, *w[k:]]), k, f[lang, *w[:k]], f[lang, *w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, left, right, n[lang], score))
    ranked = []
    for lang in n:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        ranked += [(r[0], k, *r[1:]) for k, r in enumerate(own[:best], 1)]
    return sorted(ranked)


@pytest.mark.parametrize("block,bits", [(1_000_000, 28), (50, 28), (7, 6)])
def test_collocations_equal_counts(spark, monkeypatch, block, bits):
    """Also with blocks of few words, and with a sieve so small that it lets nearly all lists pass."""
    monkeypatch.setattr(phrases, "SIEVE_BITS", bits)
    monkeypatch.setattr(phrases, "BITS_A_HASH", 64)
    words = "the of New york city Straße Été a b".split()
    rows = [(" ".join(RNG.choice(words) + RNG.choice(["", "", "", ",", "\n", "\t"]) for _ in range(RNG.randrange(40))), RNG.choice(["en", None, "de"])) for _ in range(60)]
    rows += [("one two three four five six seven", "en")] * 6 + [("x", "fr"), (None, "en"), ("", None), (" ., ", "en"), ("a a a a a a", "en"), ("z\0z q q z\0z", "de")] * 3
    df = spark.createDataFrame([(t, g, 1, "p") for t, g in rows], "text string, lang string, n int, phrase string").repartition(3)
    original = phrases.blocks
    monkeypatch.setattr(phrases, "blocks", lambda d, text, lang: original(d, text, lang, block))
    got = sorted(map(tuple, phrases.collocations(df, least=4, best=30).collect()))
    assert got == counted(rows, 4, 5, 30) and len(got) > 40


def test_blocks_are_stored_a_few_a_file(spark, monkeypatch):
    """Spark reads thousands of a file's rows at once, and blocks are large: so files hold a few, which are packed."""
    seen, written = {}, phrases.staged

    def watched(df, label, *rest):
        out = written(df, label, *rest)
        if label in ("phrases-blocks", "phrases-lists"):
            counts = out.groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).first()
            seen.setdefault(label, []).append((*counts, out.agg(F.max(F.length("codes"))).first()[0]))
        return out

    original = phrases.blocks
    monkeypatch.setattr(phrases, "staged", watched)
    monkeypatch.setattr(phrases, "blocks", lambda d, text, lang: original(d, text, lang, 1000))
    df = spark.createDataFrame([("a b c d e " * 200, "en")] * 50, "text string, lang string").repartition(2)
    assert len(phrases.collocations(df, least=4, best=30).collect()) > 0
    assert len(seen["phrases-lists"]) == 4
    for most, blocks_, size in [*seen["phrases-blocks"], *seen["phrases-lists"]]:
        assert blocks_ == 50 and most <= 8 and size < 1000


def test_collocations_of_little(spark, corpus):
    assert phrases.op12_phrase_collocations(spark, corpus([])).count() == 0
    assert phrases.op12_phrase_collocations(spark, corpus([(1, None, "a"), (2, "", "a"), (3, "one word", "a")])).count() == 0
    got = phrases.op12_phrase_collocations(spark, corpus([(1, "of the. " * 100, "a"), (1, "of " * 99, "a")])).collect()
    assert [tuple(r) for r in got] == [("en", 1, "of the", 100, 199, 100, 299, 1000 * 100 * 299 // (199 * 100))]


def test_scores_beyond_64_bits(spark):
    found = spark.createDataFrame([("en", "a b", 2, 3_000_000_000), ("en", "a", 1, 3_000_000_007), ("en", "b", 1, 4_000_000_000)], "lang string, phrase string, size int, n long")
    words = spark.createDataFrame([("en", 9_000_000_000_001)], "lang string, n long")
    assert phrases.scored(found, words).first()["score"] == 1000 * 3_000_000_000 * 9_000_000_000_001 // (3_000_000_007 * 4_000_000_000)


# --- clusters --------------------------------------------------------------------------------------------------------


def full_rounds(rows, k, rounds, scale, seed):
    whole = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows]
    drawn = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(whole, key=drawn)[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        owners = [nearest(v)[1] for _, v in whole]
        for j in range(len(centroids)):
            own = [v for (_, v), o in zip(whole, owners) if o == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in whole), key=repr), centroids


@pytest.mark.parametrize("spread", [3, 40])
def test_rounds_on_changes_equal_full_ones(spark, spread):
    """On a grid of few values, so that distances tie often."""
    rows = [(RNG.randrange(200) if i % 9 else None, [float(RNG.randrange(-spread, spread)) / 8 for _ in range(3)]) for i in range(400)]
    rows += rows[:50] + [(7, [0.5, -0.25, 0.125])] * 60
    others = [(1, None), (2, [1.0, 2.0]), (3, [float("nan"), 0.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, [])]
    df = spark.createDataFrame([(i, v, 1, b"x") for i, v in rows + others], "vec_id long, embedding array<float>, owner int, vector binary").repartition(5)
    got, centroids = clusters.lloyd(df, k=9, rounds=6, dimensions=3, scale=8)
    want, last = full_rounds(rows, 9, 6, 8, 2)
    assert sorted(map(tuple, got.collect()), key=repr) == want and centroids.tolist() == last


def test_delta_assignment_equals_full_assignment():
    rng = np.random.default_rng(4)
    for large in (6, 1 << 26):
        x = rng.integers(-large, large, (500, 4))
        old = rng.integers(-large, large, (8, 4))
        start = np.full(500, -1), np.zeros(500, np.int64)
        owner, distance = clusters.reassigned(x, *start, old, np.arange(8))
        for moved in ([], [3], [0, 5, 7], list(range(8))):
            new = old.copy()
            new[moved] += rng.integers(-large // 3, large // 3 + 1, (len(moved), 4))
            got = clusters.reassigned(x, owner, distance, new, np.array(moved, int))
            full = clusters.reassigned(x, *start, new, np.arange(8))
            assert (got[0] == full[0]).all() and (got[1] == full[1]).all()


def test_clusters_of_few_or_no_vectors(spark, tmp_path):
    vector = [0.5] * 64
    for rows in ([], [(1, None)], [(3, vector), (3, vector), (None, vector)]):
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
        got = clusters.op13_centroid_clustering(spark, path).collect()
        assert [(r["cluster"], r["distance"], r["inertia"]) for r in got] == [(0, 0, 0)] * (len(rows) if len(rows) > 1 else 0)
    with pytest.raises(Exception, match="too large"):
        clusters.lloyd(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<float>"))


def test_components_meet_an_edge_inside_a_set_once(spark, monkeypatch):
    from folio.llm import jaccard, shared

    rows = []

    def counted(df, label):
        out = shared.staged(df, label)
        if label == "components-edges":
            rows.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    clique = [(a, b) for a in range(60) for b in range(a)]
    chain = [(1000 + k, 1001 + k) for k in range(300)]
    got = jaccard.components(spark.createDataFrame(clique + chain, "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(k, 0) for k in range(60)] + [(k, 1000) for k in range(1000, 1301)]
    assert rows[0] == len(clique) + len(chain) and rows[1] < len(chain) / 2 and rows[-1] == 0 and len(rows) < 12
    found = spark.createDataFrame([(1, 1), (2, 1), (5, 4), (4, 4)], "node long, component long")
    more = spark.createDataFrame([(5, 2), (9, 8), (1, 2)], "a long, b long")
    assert sorted(map(tuple, jaccard._joined(found, more).collect())) == [(1, 1), (2, 1), (4, 1), (5, 1), (8, 8), (9, 8)]
