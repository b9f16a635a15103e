"""Segments, inverted and vector indexes, stems and headlines on small tables."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folio.functions import stems, text
from folio.operators import nearest, postings, search
from folio.sources import segments

RNG = random.Random(5)
FIELDS = {"title": 1.0, "body": 0.2}
SCHEMA = "id long, title string, body string"


def rows_of(found):
    return sorted(tuple(r) for r in found.collect())


def test_segments_keep_the_newest_rows_of_a_key(spark, tmp_path):
    path = f"{tmp_path}/t"
    put = lambda rows, keys, **o: segments.put(spark.createDataFrame(rows, "k long, v string"), spark.createDataFrame([(k,) for k in keys], "k long"), path, **o)
    assert put([(1, "a"), (1, "b"), (2, "c"), (3, "d")], [1, 2, 3]) == 0
    assert put([(1, "e")], [1, 2]) == 1  # 2 goes
    before = segments.current(spark, path)
    assert rows_of(before) == [(1, "e"), (3, "d")]
    assert put([(3, "x")], [3], number=2) == 2
    assert put([(3, "y")], [3], number=2) == 2  # a batch that runs again
    assert rows_of(segments.current(spark, path)) == [(1, "e"), (3, "y")]
    assert rows_of(segments.current(spark, path, F.col("k") == 3)) == [(3, "y")]
    assert not segments.compacted(spark, path, most=3) and segments.compacted(spark, path, most=2)
    assert segments.numbers(spark, path) == [3] and rows_of(segments.current(spark, path)) == [(1, "e"), (3, "y")]
    assert rows_of(before) == [(1, "e"), (3, "d")]  # what was read before stays readable
    fs, make = segments._files(spark, path)
    fs.delete(make(f"{path}/segment=3/_DONE"), False)
    assert segments.numbers(spark, path) == [0, 1, 2]
    segments.drop(spark, path)
    assert segments.numbers(spark, path) == []


def test_index_gives_what_scans_give_and_changes_write_their_own(spark, tmp_path):
    path, words = f"{tmp_path}/i", "the of árvore ARVORE casa a_b 12 rio".split()
    make = lambda n: " ".join(RNG.choice(words) for _ in range(n))
    docs = {i: (make(RNG.randrange(4)), make(RNG.randrange(30))) for i in range(80)} | {80: (None, None), 81: ("", "casa" * 3)}
    frame = lambda d: spark.createDataFrame([(i, *x) for i, x in d.items()], SCHEMA)
    postings.write(frame(docs).repartition(3), path, FIELDS)
    changed = {3: ("the of", "rio"), 200: ("casa", None)}
    number = postings.write(frame(changed), path, FIELDS, removed=spark.createDataFrame([(5,)], "id long"))
    assert {r["id"] for r in spark.read.parquet(f"{path}/segment={number}/rows").select("id").collect()} == {3, 200}
    docs = {i: x for i, x in (docs | changed).items() if i != 5}
    for asked in ("casa", "the rio", "árvore of", "none", "casa none", "a_b 12 casa"):
        scan = search.matching(frame(docs), asked, FIELDS).select("id", F.round("rank", 9))
        assert rows_of(postings.find(spark, path, text.plain_lexemes(asked)).select("id", F.round("rank", 9))) == rows_of(scan), asked
    assert postings.find(spark, path, []).count() == 0
    body = f"{tmp_path}/b"
    postings.write(frame(docs), body, {"body": 1.0})
    for asked in ("casa rio", "none", "x rio"):
        scan = search.bm25(frame(docs), "id", "body", asked, 7).select("id", F.round("score", 9))
        assert rows_of(postings.bm25(spark, body, text.plain_lexemes(asked), 7).select("id", F.round("score", 9))) == rows_of(scan)


def test_batch_search_equals_single_searches(spark, tmp_path):
    path, words = f"{tmp_path}/i", "a b c d e f g".split()
    docs = [(i, None, " ".join(RNG.choice(words) for _ in range(RNG.randrange(12)))) for i in range(60)]
    postings.write(spark.createDataFrame(docs, SCHEMA).repartition(4), path, FIELDS)
    asked = [["a"], ["b", "a"], ["a", "b", "a"], ["c", "d", "e"], ["z"], ["a", "z"], [], ["f", "g"], ["a"], None]
    got = postings.find_all(spark, path, spark.createDataFrame([(x,) for x in asked], "asked array<string>"), 4).collect()
    by_list = {}
    for r in sorted(got, key=lambda r: r["place"]):
        by_list.setdefault(tuple(r["asked"]), []).append((r["id"], round(r["rank"], 9)))
    for wanted in ({"a"}, {"a", "b"}, {"c", "d", "e"}, {"z"}, {"f", "g"}):
        one = [(r["id"], round(r["rank"], 9)) for r in search.top(postings.find(spark, path, sorted(wanted)), "rank", 4).collect()]
        assert by_list.get(tuple(sorted(wanted)), []) == one
    assert set(by_list) <= {("a",), ("a", "b"), ("c", "d", "e"), ("f", "g")}


@pytest.mark.parametrize("block", [postings.BLOCK, 1])
def test_batch_search_reads_texts_and_builds_no_index(spark, tmp_path, monkeypatch, block):
    from folio.plans import catalogue

    def refused(*a, **o):
        raise AssertionError("an index for one batch")

    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "TALLIED", 7)
    words = "a b c d e f g".split()
    make = lambda n: " ".join(RNG.choice(words) for _ in range(RNG.randrange(n)))
    docs = [(i, make(4), make(25)) for i in range(90)] + [(90, None, None), (91, "a b c d e f g", None), (None, None, "q"), (92, "q", "q"), (93, "y", None), (93, None, "x")]
    asked = [["a"], ["b", "a"], ["c", "d", "e"], words, ["z"], ["a", "z"], [], ["q"], ["x", "y"], ["a"], None]
    df = spark.createDataFrame(docs, SCHEMA).repartition(5)
    found = postings.scan_all(df, FIELDS, spark.createDataFrame([(x,) for x in asked], "asked array<string>"), 4).collect()
    got = {(tuple(r["asked"]), r["place"], r["id"], round(r["rank"], 9)) for r in found}
    want = {(("x", "y"), 0, 93, 1.2), (("q",), 0, 92, round(2 / (1 + math.log(2)), 9)), (("q",), 1, None, 0.2)}
    for wanted in ({"a"}, {"a", "b"}, {"c", "d", "e"}, set(words)):
        held = {i: ((x or "").split(), (y or "").split()) for i, x, y in docs if i is not None and i < 92}
        rank = lambda x, y: sum((1.0 if w in x else 0.2) * (x + y).count(w) for w in wanted) / (1 + math.log(max(len(x + y), 1)))  # noqa: B023, E731
        ranks = {i: rank(x, y) for i, (x, y) in held.items() if wanted <= set(x + y)}
        want |= {(tuple(sorted(wanted)), place, i, round(ranks[i], 9)) for place, i in enumerate(sorted(ranks, key=lambda i: (-round(ranks[i], 9), i))[:4])}
    assert got == want
    monkeypatch.setattr(postings, "index_of", refused)
    catalogue.QUERIES["batch_search"](spark, "/root/testdata/sf0.001")


def test_numbers_of_lexemes_are_salted_until_they_differ(spark, monkeypatch):
    true = postings._word
    monkeypatch.setattr(postings, "_word", lambda lexeme, salt: F.length(lexeme).cast("long") if salt < 2 else true(lexeme, salt))
    df = spark.createDataFrame([(1, None, "aa"), (2, None, "bb")], SCHEMA)
    found = postings.scan_all(df, {"body": 1.0}, spark.createDataFrame([(["bb"],)], "asked array<string>"), 4)
    assert [(r["id"], r["rank"]) for r in found.collect()] == [(2, 1.0)]


def test_empty_index(spark, tmp_path):
    path = f"{tmp_path}/i"
    postings.write(spark.createDataFrame([], SCHEMA), path, FIELDS)
    assert postings.find(spark, path, ["a"]).count() == 0 and postings.bm25(spark, path, ["aa"], 3).count() == 0


STEMS = (
    "boa boa boas boas boataria boat boate boat boatos boat boba bob bobagem bobag bobagens bobagens bobear bob bobeira bobeir bobinho bobinh quinta quint "
    "quiosque quiosqu quis quis quiser quis quisera quis quintino quintin contratos contrat contrato contrat felizmente feliz rapidamente rapid "
    "ideologia ideolog administrativa administr continuidade continu guia gui a a ab ab"
).split()


def test_stems(spark):
    got = spark.createDataFrame([(w,) for w in STEMS[::2]], "w string").select("w", stems.stem(F.col("w")).alias("s")).collect()
    assert [r["s"] for r in got] == STEMS[1::2]


@pytest.mark.parametrize("a,b", [("diárias", "DIARIAS"), ("licitações", "LICITACOES"), ("Contratos", "contrato"), ("orçamento público", "ORCAMENTO PUBLICO"), ("servidores", "Servidor")])
def test_forms_of_a_word_are_one_lexeme(spark, a, b):
    own = spark.createDataFrame([(a, b)], "a string, b string").select(stems.stemmed_lexemes(F.col("a")), stems.stemmed_lexemes(F.col("b"))).first()
    assert own[0] == own[1] != []


def test_stop_words_and_nulls(spark):
    df = spark.createDataFrame([("A casa dos servidores não é de vocês",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(stems.stemmed_lexemes(F.col("t"))).collect()] == [["cas", "servidor"], [], []]


@pytest.mark.parametrize(
    "shown,wanted,out",
    [
        ("a b c the d of e f g h the of i j k l", ["the", "of"], "<b>the</b> <b>of</b> i j k"),
        ("x the " + "y " * 30 + "of z", ["the", "of"], "<b>the</b> " + "y " * 18 + "y"),
        ("the a a a a a a a of", ["the", "of"], "<b>the</b> a a a a a a a <b>of</b>"),
        ("a b c d e of", ["of"], "b c d e <b>of</b>"),
        ("a of b c d e f g", ["of", "none"], "a <b>of</b> b c d"),
        ("Árvore, casa", ["arvore"], "<b>Árvore,</b> casa"),
        (None, ["x"], ""),
        ("a b c", [], "a b c"),
    ],
)
def test_headline(spark, shown, wanted, out):
    df = spark.createDataFrame([(shown, wanted)], "t string, w array<string>")
    assert df.select(search.headline(F.col("t"), F.col("w"))).first()[0] == out


def test_nearest_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    monkeypatch.setattr(nearest, "GROUP", 3)
    rng, path = np.random.default_rng(3), f"{tmp_path}/v"
    data = rng.normal(size=(300, 8)).astype(np.float32)
    data[100:200] = data[100]  # a third of all vectors are equal
    rows = [(i, v.tolist()) for i, v in enumerate(data)] + [(900, None), (901, [0.0] * 8), (902, [1.0, 2.0]), (903, [float("nan")] * 8), (None, [1.0] * 8), (904, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(4)
    nearest.write(df, path, cells=12)
    late = rng.normal(size=(20, 8)).astype(np.float32)
    nearest.write(spark.createDataFrame([(290 + i, v.tolist()) for i, v in enumerate(late)], "id long, embedding array<float>"), path)
    data = np.concatenate((data[:290], late)).astype(np.float64)
    data /= np.sqrt((data * data).sum(axis=1))[:, None]
    queries = df.filter("id % 20 = 0")

    def brute(q):
        return sorted((-round(float(data[q] @ data[i]), 9), i) for i in range(len(data)))[:7]

    got = nearest.search(spark, path, queries, 7, nearest.ALL).collect()
    asked = [q for q in range(0, 300, 20)]
    assert len(got) == 7 * len(asked)
    for q in asked:
        own = sorted((r["place"], r["id"], r["similarity"]) for r in got if r["query_id"] == q)
        if q < 290:
            assert [i for _, i, _ in own] == [i for _, i in brute(q)] and all(math.isclose(s, -w, abs_tol=2e-9) for (_, _, s), (w, _) in zip(own, brute(q)))
    some = nearest.search(spark, path, queries, 7).select("query_id", "id").collect()
    both = len({tuple(r) for r in some} & {(r["query_id"], r["id"]) for r in got})
    assert both >= 0.9 * len(got)
    assert nearest.search(spark, path, queries.limit(0), 7).count() == 0


def test_nearest_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id long, embedding array<float>")
    nearest.write(df, f"{tmp_path}/v")
    assert nearest.search(spark, f"{tmp_path}/v", spark.createDataFrame([(1, [1.0])], df.schema), 3).count() == 0


def test_any_word_batches_by_blocks_give_what_one_block_gives(spark, tmp_path, monkeypatch):
    path, words = f"{tmp_path}/i", [f"w{k}" for k in range(40)]
    docs = [(i, RNG.choice(words), " ".join(RNG.choice(words) for _ in range(RNG.randrange(6)))) for i in range(120)] + [(200 + i, "w1", "w2 w3") for i in range(9)] + [(300, None, None)]
    postings.write(spark.createDataFrame(docs, SCHEMA), path, FIELDS)
    asked = [sorted(RNG.sample(words, RNG.randrange(1, 6))) for _ in range(30)] + [["w2", "w3"], ["unknown"], []]
    df = spark.createDataFrame([(x,) for x in asked], "asked array<string>")
    index = postings.of(spark, path).collect()
    df_of = {w: sum(r["lexeme"] == w for r in index) for w in words}
    for common in (1.0, 0.1):
        want = set()
        for x in {tuple(x) for x in asked}:
            ranks = {}
            for r in index:
                if r["lexeme"] in x and df_of[r["lexeme"]] <= common * len(docs):
                    ranks[r["id"]] = ranks.get(r["id"], 0) + math.log(1 + len(docs) / df_of[r["lexeme"]]) * r["weight"] * r["count"] / (1 + math.log(max(r["length"], 1)))
            best = sorted(ranks, key=lambda i: (-round(ranks[i], 9), i))[:4]
            want |= {(x, place, i, round(ranks[i], 9)) for place, i in enumerate(best)}
        for block, group in ((postings.BLOCK, postings.ASKED), (40, 3)):
            monkeypatch.setattr(postings, "BLOCK", block)
            monkeypatch.setattr(postings, "ASKED", group)
            found = postings.find_any(spark, path, df, 4, common)
            assert {(tuple(r["asked"]), r["place"], r["id"], round(r["rank"], 9)) for r in found.collect()} == want
            assert "MapInArrow" in found._jdf.queryExecution().toString()
            monkeypatch.undo()


@pytest.mark.parametrize("block,group", [(4_000_000, 1_000), (20, 3)])
def test_any_word_batches_read_texts_and_send_documents(spark, monkeypatch, block, group):
    """Rows of one id are one document, rows without id are counted alone; no index, and no postings are rows of a cell."""
    from folio.plans import catalogue

    def refused(*a, **o):
        raise AssertionError("an index for one batch")

    monkeypatch.setattr(postings, "BLOCK", block)
    monkeypatch.setattr(postings, "ASKED", group)
    words = [f"w{k}" for k in range(30)]
    make = lambda n: " ".join(RNG.choice(words) for _ in range(RNG.randrange(n)))
    docs = [(i, make(4), make(25)) for i in range(300)] + [(300, None, None), (301, "q q", None), (301, None, "q r"), (None, "q", "r"), (302, "q", "q"), (303, "q", "q")]
    asked = [sorted(RNG.sample(words, RNG.randrange(1, 9))) for _ in range(30)] + [["q", "r"], ["r", "unknown"], ["unknown"], [], None]
    held: dict = {}
    for i, x, y in docs:
        own = held.setdefault(i, ([], []))
        own[0].extend((x or "").split())
        own[1].extend((y or "").split())
    df_of = {w: sum(w in x + y for x, y in held.values()) for w in [*words, "q", "r", "unknown"]}
    for common in (1.0, 0.3):
        want = set()
        for x in {tuple(x) for x in asked if x}:
            ranks = {}
            for i, (title, body) in held.items():
                part = lambda w: math.log(1 + len(docs) / df_of[w]) * (1.0 if w in title else 0.2) * (title + body).count(w) / (1 + math.log(max(len(title + body), 1)))  # noqa: B023, E731
                parts = [part(w) for w in x if df_of[w] <= common * len(docs) and w in title + body]
                if i is not None and parts:
                    ranks[i] = sum(parts)
            best = sorted(ranks, key=lambda i: (-round(ranks[i], 9), i))[:4]
            want |= {(x, place, i, round(ranks[i], 9)) for place, i in enumerate(best)}
        found = postings.scan_any(spark.createDataFrame(docs, SCHEMA).repartition(5), FIELDS, spark.createDataFrame([(x,) for x in asked], "asked array<string>"), 4, common=common)
        assert {(tuple(r["asked"]), r["place"], r["id"], round(r["rank"], 9)) for r in found.collect()} == want
    monkeypatch.setattr(postings, "index_of", refused)
    catalogue.QUERIES["batch_search_any"](spark, "/root/testdata/sf0.001")


def test_best_of_sums_with_ties(monkeypatch):
    """The k best of many sums by parts are those of a sort, also where sums tie when rounded."""
    cell = postings._Cell()
    for n in (1, 5, 319, 320, 1000, 4001):
        cell.ids = np.arange(n) * 3
        for sums in (np.zeros(n), RNG.random() * np.random.default_rng(n).integers(0, 4, n), np.random.default_rng(n).random(n), 1 + np.random.default_rng(n).integers(-9, 9, n) * 1e-11):
            want = sorted((i for i in range(n) if sums[i] > 0), key=lambda i: (-np.round(sums[i], 9), i))[:5]
            assert cell._first(sums, 5)[0].tolist() == [i * 3 for i in want]


def test_scans_tally_fields_where_they_are(spark):
    df = spark.createDataFrame([(1, "the of", "the"), (2, "the", None), (3, None, "of casas the"), (4, None, None)], SCHEMA)
    for asked in ("the of", "casas", "Quais?"):
        wanted = text.plain_lexemes(asked)
        assert rows_of(search.scanned(df, "id", FIELDS, wanted).select("id", F.round("rank", 9))) == rows_of(search.matching(df, asked, FIELDS).select("id", F.round("rank", 9)))
    stemmed = df.select(stems.tally(F.col("body"), ["cas", "the"]).alias("t")).collect()
    whole = df.select(stems.stemmed_lexemes(F.col("body")).alias("l")).collect()
    assert [(r["t"]["n"], list(r["t"]["hits"])) for r in stemmed] == [(len(r["l"]), [r["l"].count("cas"), r["l"].count("the")]) for r in whole]


def test_one_question_shuffles_no_texts(spark, tmp_path):
    from folio.plans import catalogue

    for name in ("search_pages_fts", "search_sections", "search_or_bm25", "search_pages_stemmed"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
        assert "index-" not in plan, name


def _physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_tallies_are_hashed_not_sorted(spark):
    from folio.plans import retrieval

    plan = _physical(retrieval.page_ranks(spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_chunks_of_a_year_are_numbers(spark):
    from folio.plans import catalogue

    plan = _physical(catalogue.QUERIES["search_chunks_union"](spark, "/root/testdata/sf0.001"))
    assert "labels" not in plan and "LeftSemi" in plan


@pytest.mark.parametrize("text", [None, "", " ", "a", "a " * 384, "a " * 385, "a " * 731, "a " * 2000])
def test_window_indexes_are_those_of_the_windows(spark, text):
    from folio.operators import chunking

    row = spark.createDataFrame([(text,)], "t string").select(chunking.window_indexes(F.col("t")).alias("n"), F.transform(chunking.fixed_windows(F.col("t")), lambda c: c["chunk_index"]).alias("w")).first()
    assert row["n"] == row["w"]


def test_rows_that_probe_all_cells_are_made_a_few_at_a_time(spark, monkeypatch):
    import pandas as pd

    sizes = []
    monkeypatch.setattr(nearest, "PLACED", 8)

    class Frame:
        def mapInPandas(self, run, schema):
            sizes.extend(len(x) for x in run(iter([pd.DataFrame({"id": range(20), "embedding": [[1.0, float(i)] for i in range(20)]})])))

    nearest.placed(Frame(), np.eye(2), nearest.ALL)
    assert sum(sizes) == 40 and max(sizes) <= 8


def test_models_and_neighbours_take_rows_from_arrow(spark, tmp_path):
    from folio.operators import generate

    items = spark.createDataFrame([(i, None if i % 3 == 0 else f"a{i} b") for i in range(45)], "id long, text string").coalesce(1)
    answered = generate.replies(items, lambda rows: [f"{len(rows)} {k} {x}" for k, x in rows])
    assert "MapInArrow" in _physical(answered) and "MapInPandas" not in _physical(answered)
    assert {r["id"]: r["reply"] for r in answered.collect()} == {i: f"{20 if i < 40 else 5} {i} {'' if i % 3 == 0 else f'a{i} b'}" for i in range(45)}
    vectors = spark.createDataFrame([(i, [1.0, i / 7]) for i in range(30)], "id long, embedding array<double>")
    nearest.write(vectors, f"{tmp_path}/v", cells=3)
    assert "MapInArrow" in _physical(nearest.search(spark, f"{tmp_path}/v", vectors, 2, nearest.ALL))


def test_partitions_of_page_tallies_grow_with_the_documents(spark, monkeypatch):
    from folio.plans import indexed, retrieval

    whole = retrieval.page_ranks(spark, "/root/testdata/sf0.001").collect()
    monkeypatch.setattr(indexed, "HASHED", 16)  # 200 documents
    ranks = retrieval.page_ranks(spark, "/root/testdata/sf0.001")
    assert _physical(ranks).count("hashpartitioning(id") == _physical(ranks).count(", 13), REPARTITION_BY_NUM") == 2
    assert ranks.collect() == whole
