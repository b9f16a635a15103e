"""The similarity join, packing, classifiers, neighbours, surrogates and the pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folio.llm import jaccard, langid, neighbours, packing, pii, toxicity
from folio.llm.shared import staged

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(1, 6))) for _ in range(400)]


def prose(n, words=VOCABULARY):
    return " ".join(RNG.choice(words) for _ in range(n))


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a_, b_ = sorted((find(a), find(b)))
                root[b_] = a_
    return sorted((i, len(s), find(i)) for i, s in sets)


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[RNG.randrange(len(w))] = RNG.choice(VOCABULARY)
    return " ".join(w)


def near_copies():
    rows, i = [], 0

    def add(text):
        nonlocal i
        i += 1
        rows.append((i, text))

    base, passage = prose(120), prose(60)
    for _ in range(60):
        add(edited(base, RNG.randint(0, 4)))
    for _ in range(40):
        add(prose(RNG.randint(5, 25)) + " " + passage + " " + prose(RNG.randint(5, 25)))
    for _ in range(40):
        n = RNG.randint(3, 80)
        text = prose(n)
        for _ in range(RNG.randint(1, 4)):
            add(edited(text, RNG.randint(0, 3)))
    chain = prose(150).split()
    for k in range(12):
        add(" ".join(chain[k * 4 : k * 4 + 90]))
    for text in (None, "", " \n\t", "one two", "One TWO", "one two", "É é", "é é", base.upper(), base):
        add(text)
    RNG.shuffle(rows)
    return rows


@pytest.mark.parametrize("wide", [jaccard.WIDE, 0])
def test_join_finds_all_links(spark, monkeypatch, wide):
    monkeypatch.setattr(jaccard, "WIDE", wide)  # 0: all pairs are filtered by what their prefixes share
    rows = near_copies() + [(None, prose(9)), (None, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int").repartition(3)
    got = jaccard.join(df).collect()
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == brute_components(rows)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]


def test_join_with_repeated_rows(spark):
    text = prose(30)
    df = spark.createDataFrame([(4, text), (4, text), (9, text), (2, prose(30))], "doc_id long, text string")
    assert sorted(tuple(r)[::2] for r in jaccard.join(df).collect()) == [(2, 2), (4, 4), (4, 4), (9, 4)]


def test_join_links_classes_of_one_group_past_its_head(spark):
    shingle = jaccard.Shingler()

    def key(words):
        s = shingle(" ".join(words))
        return len(s), s[: jaccard.prefix_length(len(s))].tolist()

    def changed(words, n):
        out = list(words)
        for _ in range(n):
            for _ in range(2000):
                new = list(out)
                new[RNG.randrange(len(new))] = prose(1)
                if new != out and key(new) == key(out):
                    out = new
                    break
        return out

    base = prose(80).split()
    head, x = changed(base, 5), changed(base, 5)
    y = changed(x, 1)
    rows = [(i, " ".join(w)) for i, w in enumerate((head, x, y), 1)]
    want = brute_components(rows)
    assert key(head) == key(x) == key(y) and [c for _, _, c in want] == [1, 2, 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == want


def test_sketch_parts_are_added_as_a_tree(spark, monkeypatch):
    text = prose(300)
    df = spark.createDataFrame([(i, text + " " + prose(200)) for i in range(60)], "doc_id long, text string").repartition(12)
    counted = df.select("doc_id", "text").mapInPandas(jaccard._counted, f"doc_id long, n long, fp_a long, fp_b long, {', '.join(f'{c} long' for c in jaccard._BIT_COLUMNS)}, chunk int, counts binary").cache()
    want = jaccard._levels(counted)
    for added in (2, 5):
        monkeypatch.setattr(jaccard, "ADDED", added)
        assert (jaccard._levels(counted) == want).all() and want.any()


@pytest.mark.parametrize("size", [jaccard.LARGE + 8, jaccard.LARGE - 2])
def test_a_group_meets_several_centres_of_a_large_component(spark, size):
    bits = [f"0L AS {b}" for b in jaccard._BIT_COLUMNS]
    heads = spark.range(size + 1).selectExpr("id AS grp", "10 AS n", "id AS rep", *bits)
    placed = heads.withColumn("comp", F.when(F.col("rep") < size, 0).otherwise(F.col("rep")))
    shared = heads.crossJoin(spark.range(3).withColumnRenamed("id", "token")).selectExpr("token", "grp", "n", "0 AS pos")
    pairs = {tuple(r) for r in jaccard._nearby(shared, heads, placed).collect()}
    assert all(a < size and b == size for a, b in pairs)
    assert (3 < len(pairs) <= 3 * jaccard.TURNS) if size >= jaccard.LARGE else not pairs


def test_rows_of_one_doc_id_are_one_node(spark):
    t = [prose(60) for _ in range(6)]
    rows = [(1, t[0]), (1, t[1]), (2, edited(t[1], 1)), (3, t[2]), (4, t[2]), (4, t[3]), (5, t[3]), (6, t[4]), (5, ""), (7, ""), (8, t[5]), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((r["doc_id"], r["component_id"]) for r in jaccard.join(df).collect()) == sorted((i, c) for i, _, c in brute_components(rows))
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 3, 6: 6, 7: 7, 8: 8}


def test_links_are_verified_with_each_text_of_a_doc_id():
    a, b = prose(60), prose(60)
    for texts in ((a, b), (b, a)):
        batch = pd.DataFrame({"a": [1, 1], "b": [2, 2], "text_a": texts, "text_b": [edited(b, 1)] * 2})
        assert pd.concat(jaccard._verified(iter([batch]))).values.tolist() == [[1, 2]]


def test_word_hashes_are_64_bits():
    # the two words have one crc32, whatever it starts with
    shingler = jaccard.Shingler()
    shingler.many(["plumless buckeroo"])
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo") and len(set(shingler.seen.values())) == 2


def test_prefix_is_long_enough():
    for n in range(1, 60):
        # a partner of size m >= n with the least overlap allowed meets the first prefix_length(n)
        least = min(-(-4 * (n + m) // 9) for m in range(n, n * 5 // 4 + 1))
        assert jaccard.prefix_length(n) >= n - least + 1


SPECIAL = ["a<|endoftext|>b", "x\x1cy z", "don't we'll I'M", "ÀÉ́ é", "日本語 テキスト", "a b c", "ΣΑΣ", "", None, "   ", "naïve​word", "1234 5,6 $$$ ###the"]


def test_encoder_gives_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path(packing.TOKENIZER)
    encode = packing.Encoder(path, most=50)
    plain = Tokenizer.from_file(path)
    for text in [*SPECIAL, prose(300), *(prose(20) for _ in range(20))]:
        assert encode(text).tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_encoder_of_the_letter_whose_lower_case_has_a_mark():
    from tokenizers import Tokenizer

    path = packing.public_tokenizers.path(packing.TOKENIZER)
    encode, plain = packing.Encoder(path), Tokenizer.from_file(path)
    for text in ["İstanbul", "DİYARBAKIR'da (İzmir), İ! İİ x.İ", *(prose(3, [*"İiIıa'.,-(", "\u0307", "Kİ"]) for _ in range(200)), *("".join(RNG.choices("İiIıA'.,-( ", k=9)) for _ in range(500))]:
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_groups_of_null_and_repeated_ids_are_small(spark):
    rows = [(None, f"text {i}") for i in range(400)] + [(7, f"text {i}") for i in range(400)] + [(8, "same")] * 400 + [(None, None)] * 400
    cut = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 16)
    sizes = [r["count"] for r in cut.groupBy("grp").count().collect()]
    assert sum(sizes) == 1600 and len(sizes) == 16 and max(sizes) < 200


def test_tournament_is_first_fit():
    for _ in range(20):
        lengths = np.array([RNG.randint(1, 50) for _ in range(200)])
        bins, offsets = packing.first_fit_decreasing(lengths, 60)
        room = []
        for k in np.argsort(-lengths, kind="stable"):
            at = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
            if at == len(room):
                room.append(60)
            assert (bins[k], offsets[k]) == (at, 60 - room[at])
            room[at] -= lengths[k]


def check_packing(out, want):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert Counter(i for i, _ in want) == Counter(r["doc_id"] for r in out if r["start"] == 0)
    for i, ids in want:
        mine = [r for r in by_doc[i] if r["doc_tokens"] == len(ids)]
        for r in mine:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"] or len(mine) > 1
        assert sum(r["length"] for r in mine) % len(ids) == 0
    for rows in by_sequence.values():
        rows.sort(key=lambda r: r["offset"])
        at = 0
        for r in rows:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    return sum(r["length"] for r in out) / (4096 * len(by_sequence))


def test_packing(spark, corpus):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    rows = [(i, prose(RNG.choice([3, 50, 400, 2500])), "a") for i in range(300)] + [(1000 + k, t, None) for k, t in enumerate(SPECIAL)] + [(None, "no id", "a")]
    want = [(i, [*plain.encode(t or "", add_special_tokens=False).ids, 2]) for i, t, _ in rows]
    assert check_packing(packing.op4_packing(spark, corpus(rows)).collect(), want) > 0.95
    with_ids = packing.pack_documents(spark.createDataFrame([(5, "some text")], "doc_id long, text string"), with_ids=True).first()
    assert with_ids["ids"] == [*plain.encode("some text", add_special_tokens=False).ids, 2]


LANGUAGES = {"aa": "the of and to it is on with by that are ing".split(), "bb": "der die und zu ist mit keit ung sch ein".split(), "cc": "de la que en los por ción mente el".split()}


def test_language_held_out_accuracy(spark, corpus):
    rows = [(i, prose(RNG.randint(4, 80), LANGUAGES[name]), name) for i, name in enumerate(RNG.choice(list(LANGUAGES)) for _ in range(500))]
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (None, prose(30, LANGUAGES["bb"]), "bb"), (1003, prose(30, LANGUAGES["cc"]), None)]
    folder = corpus(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.op7_language_id(spark, folder).collect()}
    assert len(out) == len(rows)
    held = [(r, lang) for i, t, lang in rows if i is not None and i < 1000 and (r := out[i])["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items() if i is not None)
    assert sum(r["lang_pred"] == lang for r, lang in held) >= 0.98 * len(held) > 100
    assert {out[i]["lang_pred"] for i in (1000, 1001, 1002)} == {"und"} and out[1003]["lang_pred"] == "cc" and out[None]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_kernel_is_presence_overlap():
    a, b = "the thin shore", "on the shore"
    x, y = (set(langid.presence(t)) for t in (a, b))
    k = langid.presence_matrix([a, b])
    assert float(k[0] @ k[1]) == pytest.approx(len(x & y) / np.sqrt(len(x) * len(y)), rel=1e-5)


def test_toxicity_held_out(spark, corpus):
    bad = ["grombul", "zaxxon", "vilepox"]
    rows, labels = [], []
    for i in range(700):
        words = prose(RNG.randint(3, 150)).split()
        toxic = RNG.random() < 0.3
        for _ in range(3 if toxic else 0):
            words.insert(RNG.randrange(len(words) + 1), RNG.choice(bad) + RNG.choice(["", ".", ","]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "s"), (1001, " \n ", "s"), (None, "some words", "s")]
    folder = corpus(rows)
    spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    out = {r["doc_id"]: r for r in toxicity.op2_toxicity(spark, folder).collect()}
    assert len(out) == len(rows) and out[1000]["score"] == out[1001]["score"] == 0
    truth = {i: y for i, _, y in labels}
    hits = Counter((truth[i], r["predicted"]) for i, r in out.items() if r["held_out"] and i in truth)
    assert hits[1, 1] >= 0.9 * (hits[1, 0] + hits[1, 1]) and hits[0, 1] <= 0.05 * (hits[0, 0] + hits[0, 1])


def test_gradient(monkeypatch):
    monkeypatch.setattr(toxicity, "DROPPED", 0)
    net = toxicity.Network(3)
    words = ["", *VOCABULARY[:20]]
    ids = np.random.default_rng(0).integers(1, 21, (4, toxicity.WINDOW))
    ids[0, 10:] = 0
    y, w = np.array([1, 0, 1, 0], np.float32), np.ones(4, np.float32)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    got = {}
    net._adam = got.update

    def loss():
        x = net.inputs(words)[0]
        states = np.concatenate([net.run((x @ net.p[f"w{s}"] + net.p[f"c{s}"])[ids.T], s) for s in "fb"], axis=2)
        logit = net._pooled(states, ids.T > 0)[0]
        return float(np.mean(np.log1p(np.exp(logit)) - y * logit))

    net.p["attend"] += np.linspace(-1, 1, len(net.p["attend"]))
    net.train(ids, words, y, w)
    for name in ("uf", "wb", "cf", "attend", "out", "words"):
        at = np.unravel_index(np.abs(got[name]).argmax(), got[name].shape)
        net.p[name][at] += 1e-2
        up = loss()
        net.p[name][at] -= 2e-2
        assert (up - loss()) / 2e-2 == pytest.approx(float(got[name][at]), rel=0.05)
        net.p[name][at] += 1e-2


def test_windows_cover_and_overlap():
    for n in range(1, 200):
        at = toxicity.windows(n)
        assert set().union(*(range(a, a + toxicity.WINDOW) for a in at)) >= set(range(n)) and all(np.diff(at) == toxicity.STRIDE)


def exact(vectors, queries, k):
    out = {}
    for q, x in queries:
        out[q] = sorted((-float(np.dot(np.array(x, float), np.array(y, float))), i) for i, y in vectors if i != q)[:k]
    return out


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int").select("vec_id", "embedding", "rank")


def test_neighbours_exact_and_recall(spark):
    rng = np.random.default_rng(1)
    points = rng.standard_normal((900, 16)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(v) for v in p], 0) for i, p in enumerate(points)]
    rows += [(2000 + i, rows[7][1], 0) for i in range(150)]  # a hot vector
    rows += [(1 << 40, [3.0 * v for v in rows[8][1]], 0)]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] * 16, 0), (9005, [1.0], 0), (None, rows[3][1], 0), (9000, [float("inf")] * 16, 0)]
    df = vectors_of(spark, rows + odd)
    queries = df.filter("vec_id % 20 = 0")
    want = exact([(i, v) for i, v, _ in rows], [(i, v) for i, v, _ in rows if i % 20 == 0], 20)
    for factor, least in ((1.0, 1.0), (neighbours.FACTOR, 0.9)):
        out = neighbours.search(df, queries, factor=factor, shard=300, per_task=30).collect()
        got = defaultdict(dict)
        for r in out:
            got[r["query_id"]][r["rank"]] = r
        assert set(got) == set(want) and all(list(sorted(g)) == list(range(1, 21)) for g in got.values())
        hits = 0
        for q, best in want.items():
            worst = best[-1][0]
            hits += sum(-g["score"] <= worst + 1e-12 for g in got[q].values())
            if factor == 1:
                assert [g[1]["vec_id"] for g in sorted(got[q].items())] == [i for _, i in best]
        assert hits >= least * 20 * len(want)
    few = neighbours.search(df.filter("vec_id < 5"), df.filter("vec_id = 0")).collect()
    assert len(few) == 4


@pytest.mark.parametrize("shard", [100, 1000])
def test_neighbours_of_each_length(spark, shard):
    """Lengths that fill several shards, and ones of which a tree holds all."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(v) for v in rng.standard_normal((8, 3, 8, 1)[i % 4]).astype(np.float32)], 0) for i in range(600)]
    df = vectors_of(spark, rows)
    got = defaultdict(list)
    for r in neighbours.search(df, df.filter("vec_id % 5 = 0"), k=7, factor=1.0, shard=shard).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    for n in (8, 3, 1):
        own = [(i, v) for i, v, _ in rows if len(v) == n]
        for q, best in exact(own, [(i, v) for i, v in own if i % 5 == 0], 7).items():
            assert got.pop(q) == [i for _, i in best]
    assert not got


def test_neighbours_empty(spark):
    df = vectors_of(spark, [])
    assert neighbours.search(df, df).count() == 0
    some = vectors_of(spark, [(1, [1.0, 2.0], 0), (3, [2.0, 1.0], 0)])
    assert neighbours.search(some, some.filter("vec_id % 20 = 0")).count() == 0


def test_pipeline_against_stages(spark, corpus):
    from tokenizers import Tokenizer

    stops = ["the", "of", "and", "to", "is"]
    texts = [" ".join(w if k % 3 else RNG.choice(stops) for k, w in enumerate(prose(RNG.randint(30, 200)).split())) for _ in range(120)]
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(500 + i, edited(texts[i], 1) if len(texts[i].split()) > 100 else texts[i], "s1") for i in range(20)]
    rows += [(600, "too short", "s1"), (601, None, "s2"), (602, texts[5] + " password=abcdefgh1234", "s2"), (603, "# $ % " * 30, None), (5, texts[5], "s1")]
    folder = corpus(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "secret_scans", "source_mixing", "packing"]
    step = {}
    at = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        step[name] = at = staged(f(spark, at, folder), name)
        assert at.columns == docs.columns
    good = sorted(r["doc_id"] for r in step["quality_rules"].collect())
    assert good == sorted(i for i, _, _ in rows if i not in (600, 601, 603))
    alone = sorted(r["doc_id"] for r in step["near_duplicates"].collect())
    kept = {i: t for i, t, _ in rows if i in good}
    assert alone == sorted({c for _, _, c in brute_components(list(kept.items()))})
    for r in step["secret_scans"].collect():
        assert "abcdefgh1234" not in r["text"] and r["n_chars"] == len(r["text"])
        assert r["doc_id"] == 602 or r["text"] == kept[r["doc_id"]]
    mixed = Counter(r["doc_id"] for r in step["source_mixing"].collect())
    assert set(mixed) <= set(alone) and max(mixed.values()) <= 2
    plain = Tokenizer.from_file(packing.public_tokenizers.path(packing.TOKENIZER))
    want = [(r["doc_id"], [*plain.encode(r["text"], add_special_tokens=False).ids, 2]) for r in step["source_mixing"].collect()]
    assert check_packing(corpus_pipeline.run(spark, folder).collect(), want) > 0.5


def test_near_duplicates_of_null_and_repeated_ids(spark):
    a, b, c, d, e = (prose(60) for _ in range(5))
    rows = [(1, a), (2, a), (2, b), (3, c), (3, d), (3, d), (None, e), (None, e), (None, edited(a, 1)), (None, None), (None, ""), (4, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    want = [(1, a), (2, b), (3, c), (3, d), (None, e), (None, None), (None, ""), (4, "")]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("query", [packing.op4_packing, langid.op7_language_id, jaccard.op3_ngram_jaccard_join, pii.op8_surrogates, corpus_pipeline.run])
def test_empty_table(spark, corpus, query):
    assert query(spark, corpus([])).count() == 0
