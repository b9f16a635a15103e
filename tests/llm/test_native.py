"""Sharding, secret scans, quality rules and mixing against plain Python."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from folio.llm import mixing, quality, secrets, sharding

RNG = random.Random(7)
WORDS = "the of and to in a is on with by tion ing shore able thin real".split()


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


HEX = hashlib.sha1(b"x").hexdigest()
ROWS = [
    (1, prose(40), "a"),
    (2, prose(40), "a"),
    (3, None, "b"),
    (4, "", "b"),
    (5, "  \n\t ", None),
    (6, f'{prose(30)} token = "{HEX}" {prose(5)}', "a"),
    (6, f'{prose(30)} token = "{HEX}" {prose(5)}', "a"),
    (7, f"é𝄞 {prose(30)} AKIA{'Q7Z2' * 4} {prose(5)} {HEX}", "c"),
    (8, "token: secret: abcdefghijk password=short Api_Key='abcd.efgh1'", "c"),
    (9, "\n".join([prose(9)] * 6), "a"),
    (10, prose(3000), "a"),
    (None, prose(25), None),
    (11, "#" * 50 + " " + prose(20), "b"),
    (12, f"{prose(25)} {'q7Zk2Xw9Lm4Rt8Vb1Np6Yc3D'} {prose(4)} keitstlichschenverpfung9", "b"),
]


def test_quality_matches_sql_and_plain_python(spark, corpus):
    folder = corpus(ROWS)
    got = sorted(map(tuple, quality.op6_quality_rules(spark, folder).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(quality.ORACLE).fetchall(), key=repr)
    for doc_id, n_words, chars, _, _, repeats, failed, _ in got:
        if doc_id in (1, 9, 10):
            w = re.findall(r"[^\x20\x09-\x0D]+", next(t for i, t, _ in ROWS if i == doc_id))
            seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
            covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
            assert (n_words, chars, repeats) == (len(w), sum(map(len, w)), len(covered))
            assert failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))


def test_quality_keeps_columns_and_prose(spark):
    df = spark.createDataFrame([(1, prose(60), "x"), (2, "bad", "y")], "doc_id long, text string, n_words string")
    out = quality.keep(df)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [1]


LANGUAGES = {
    "ru": "Мы долго шли по дороге и не знали, что будет за поворотом, но солнце светило и птицы пели на ветках, а с поля дул тёплый ветер.",
    "el": "Το χωριό είναι μικρό και ήσυχο, με σπίτια από πέτρα, και το πρωί οι άνθρωποι πηγαίνουν στα χωράφια για να δουλέψουν ως το βράδυ, όλοι μαζί.",
    "tr": "Küçük bir köyde yaşayan yaşlı bir adam ve karısı vardı, bu adam her sabah erken kalkar da tarlaya gider, akşam için odun toplar ve eve dönerdi.",
    "pl": "Nad rzeką stał stary młyn i nikt nie wiedział, że w nim mieszka ktoś jeszcze, bo na progu rosła trawa, a okna były zabite deskami od lat.",
    "ja": " ".join(["昔々", "ある", "ところ", "に", "おじいさん", "と", "おばあさん", "が", "住んで", "いました"] * 1 + [f"山{i}" for i in range(15)]),
    "quoted": "“The house,” (and) “the garden,” *of* _that_ family, “and” the road: to a mill! (in) a valley; is it that? for “the” old people; on sundays.",
}


def test_quality_keeps_other_languages(spark, corpus):
    folder = corpus([(i, t, "a") for i, t in enumerate(LANGUAGES.values())] + [(90, "lexicon basket orange window " * 2 + " ".join(f"brick{k}" for k in range(30)), "a")])
    got = {r["doc_id"]: r["kept"] for r in quality.op6_quality_rules(spark, folder).collect()}
    assert got == {i: i < 90 for i in got}
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == {r[0]: r[7] for r in con.execute(quality.ORACLE).fetchall()}


def base_spans(text):
    text = text or ""
    kinds = (
        ("assign", secrets.ASSIGN.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))"), 2, 8),
        ("access", secrets.ACCESS, 0, 16),
        ("hex", secrets.HEX, 0, 32),
    )
    out = []
    for rank, (kind, pattern, group, least) in enumerate(kinds):
        out += [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text, re.ASCII) if len(m.group(group)) >= least]
    return [x for _, _, x in sorted(out)]


def test_secrets_match_brute_force(spark, corpus):
    out = secrets.op5_secret_scans(spark, corpus(ROWS)).collect()
    texts = defaultdict(list)
    for i, t, _ in ROWS:
        texts[i].append(t)
    for r in out:
        want = base_spans(texts[r["doc_id"]][0])
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        kinds = Counter(x.split(":")[0] for x in want)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert set(want) <= set(r["spans"].split(",")) | {""}
    added = next(r["spans"] for r in out if r["doc_id"] == 12)
    assert added.count("markov") == 1  # the random string, not the long word
    assert len(out) == len(ROWS)


def test_secrets_match_sql(spark, corpus):
    joined = [(20 + i, f"{prose(12)} {x} {prose(6)}", "b") for i, x in enumerate(SECRETS + ORDINARY)]
    folder = corpus(ROWS + joined + [(i, prose(30), "c") for i in range(100, 130)])
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, secrets.op5_secret_scans(spark, folder).collect()), key=repr)
    assert got == sorted(con.execute(secrets.ORACLE).fetchall(), key=repr) and sum(r[5].count("markov") for r in got) >= len(SECRETS)


def random_string(letters, n):
    return "".join(RNG.choice(letters) for _ in range(n))


SECRETS = [random_string(secrets.ALPHABET[:62], n) for n in (16, 19, 24, 40)] + [random_string(secrets.ALPHABET[:52], 32), random_string(secrets.ALPHABET[26:62], 32), hashlib.md5(b"y").hexdigest()[:30].upper()]
SECRETS += [f"src/user/config/get_file_path_file/{random_string(secrets.ALPHABET[:62], 24)}", f"{random_string(secrets.ALPHABET[:62], 30)}/src/user/config/server/client/message/{random_string(secrets.ALPHABET[:62], 30)}"]
ORDINARY = ["123e4567-e89b-12d3-a456-426614174000", "-" * 40, "=" * 40, "aaaaaaaaaaaaaaaaaaaa", "4952935900253052", "2024-01-15T10-30-00", "src/user/config/get_file_path_file", "getUserNameFileConfig2024", "UPDATE_TABLE_COLUMN_ORDER", "+--------+--------+", "the_of_and_to_shorethin_index12"]


def stretches_of(spark, values, model):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return {r["i"]: r["x"] for r in df.select("i", secrets.stretches(F.col("v"), model).alias("x")).collect()}


def test_markov_parts_random_strings_from_ordinary_ones(spark):
    docs = spark.createDataFrame([(i, prose(60)) for i in range(300)], "doc_id long, text string")
    model = secrets.train(secrets.samples(docs))
    got = stretches_of(spark, SECRETS + ORDINARY, model)
    assert [len(got[i]) for i in range(len(got))] == [1] * (len(SECRETS) - 1) + [2] + [0] * len(ORDINARY)
    assert got[7][0][1] == 59 and 25 <= got[7][0][0] <= 35  # the piece behind the path, whole
    strings = [random_string(secrets.ALPHABET[:62], RNG.randint(16, 40)) for _ in range(300)] + ["/".join(RNG.choice(WORDS) for _ in range(9)) + "_" + RNG.choice(WORDS) for _ in range(300)]
    hits = [bool(x) for _, x in sorted(stretches_of(spark, strings, model).items())]
    assert sum(hits[:300]) >= 290 and sum(hits[300:]) <= 6  # paths of ten words; a model of a table of 18 different words knows few joints


def test_long_runs_and_texts(spark):
    # a run of half a million characters, a match of as many, and as many short texts in one
    model = secrets.train(secrets.labelled_samples(spark, 500))
    texts = [random_string(secrets.ALPHABET[:62], 500_000), "token=" + "z" * 500_000, "a=1 " * 120_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secrets.mask(df, model=model).collect()}
    assert got == {0: "[SECRET]", 1: "[SECRET]", 2: texts[2]}


@pytest.mark.parametrize("stride,piece", [(256, 4096), (3, 5)])
def test_many_matches_in_a_text(spark, monkeypatch, stride, piece):
    """Also with strides and pieces so short that every match crosses some, and letters beyond 16 bits."""
    monkeypatch.setattr(secrets, "STRIDE", stride)
    monkeypatch.setattr(secrets, "PIECE", piece)
    model = secrets.train(secrets.labelled_samples(spark, 500))
    parts = ["token=abcdefgh", "\U0001f600é", "AKIA" + "A1" * 8, "0f" * 18, "secret: token=zyxwvuts12", random_string(secrets.ALPHABET[:62], 24), "ordinary", "\n", "password=AKIA" + "Z" * 16]
    for n in (0, 1, 2, 3, 4, 40, 700):
        text = " ".join(RNG.choice(parts) for _ in range(n)) + "\U0001f600" * (n % 3)
        df = spark.createDataFrame([(1, text)], "doc_id long, text string")
        found = secrets.scan(df, model=model).first()["secrets"]
        names = [(x["start"], secrets.KINDS[x["rank"]], x["end"]) for x in found]
        assert [f"{k}:{s}:{e}" for s, k, e in names if k != "markov"] == base_spans(text) and all(text[s:e].strip() == text[s:e] != "" for s, _, e in names)
        masked, at, out = secrets.mask(df, model=model).first()["text"], 0, []
        for s, _, e in names:
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        assert masked == "".join(out) + text[at:]


def test_time_grows_with_the_matches(spark):
    """A text of 200,000 runs, of which each was once copied for every later one."""
    model = secrets.train(secrets.labelled_samples(spark, 500))
    text = " ".join("".join(RNG.choice("abcdefghijklmnop") for _ in range(13)) for _ in range(1000))
    df = spark.createDataFrame([(1, 200)], "doc_id long, n int").select("doc_id", F.repeat(F.lit(text + " token=abcdefgh1 "), F.col("n")).alias("text"))
    began = time.perf_counter()
    assert secrets.mask(df, model=model).select(F.regexp_count("text", F.lit(r"\[SECRET\]"))).first()[0] >= 200
    assert time.perf_counter() - began < 120


def test_added_columns_overwrite_nothing(spark):
    df = spark.createDataFrame([(1, "x", "own", "own")], "doc_id long, text string, Secrets string, quality string")
    for add in (secrets.scan, quality.judge):
        with pytest.raises(ValueError, match="already"):
            add(df)
    assert secrets.scan(df, out="found").columns == [*df.columns, "found"] and quality.judge(df, out="found").first()["quality"] == "own"


def test_scans_keep_clashing_columns(spark):
    df = spark.createDataFrame([(1, "password=abcdefgh1234", 7, "x", "y", "z")], "doc_id long, text string, at int, body string, base string, draw string")
    assert secrets.mask(df).collect() == [(1, "[SECRET]", 7, "x", "y", "z")]
    assert secrets.scan(df).drop("secrets").collect() == df.collect()


def test_mask_hides_every_span(spark):
    df = spark.createDataFrame([(r[0], r[1]) for r in ROWS], "doc_id long, text string")
    out = secrets.mask(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert not any(base_spans(r["text"]) for r in rows)
    assert next(r["text"] for r in rows if r["doc_id"] == 1) == ROWS[0][1]
    assert next(r["text"] for r in rows if r["doc_id"] == 3) is None


def test_mixing_matches_sql(spark, corpus):
    folder = corpus([r for r in ROWS if r[0] != 6])
    got = sorted(map(tuple, mixing.op9_mixing(spark, folder).collect()), key=repr)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(mixing.ORACLE).fetchall(), key=repr)
    by = defaultdict(list)
    for _, size, source_size, target, taken, first, second in got:
        assert (taken > 0) == (first is not None) and (second is None or first < second)
        assert taken <= 2 * size
        by[source_size, target].append(taken)
    for (source_size, target), taken in by.items():
        assert target <= 2 * source_size and sum(taken) == int(target + 1e-6)


def plain_targets(sizes, weights=(5, 2, 1)):
    total, full = 1.5 * sum(sizes), set()
    while True:
        left = total - sum(2 * sizes[i] for i in full)
        share = sum(weights[i % 3] for i in range(len(sizes)) if i not in full)
        out = [2.0 * s if i in full else left * weights[i % 3] / share for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and out[i] > 2 * s}
        if not over:
            return out
        full |= over


def test_targets_are_reshared_until_none_is_above(spark):
    for n in (1, 3, 20, 21):
        sizes = [RNG.choice([0, 5, 100, 1000, 30000]) + 1 for _ in range(n)]
        df = spark.createDataFrame([(False, f"s{i:02}", s) for i, s in enumerate(sizes)], "no_source boolean, name string, source_size long")
        got = [r["target"] for r in mixing.targets(df).orderBy("name").collect()]
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_orders_by_time_and_keeps_columns(spark):
    rows = [(i, prose(5 + i % 7), f"s{i % 3}", 0) for i in range(300)] + [(None, "x y", None, 1), (7, prose(12), "s1", 2), (8, None, "s0", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, position int")
    out = mixing.mix(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(map(tuple, got)).most_common(1)[0][1] <= 2
    first, last = got[: len(got) // 3], got[-len(got) // 3 :]
    assert sum(r["source"] == "s0" for r in first) > sum(r["source"] == "s0" for r in last)  # s0 fades


def test_schedule_is_inverted(spark):
    for knots in mixing.SCHEDULES:
        segments = mixing._segments(knots)
        for r in spark.range(0, 100).select((F.col("id") / 100).alias("u"), mixing.training_time(F.col("id") / 100, knots).alias("t")).collect():
            total = 0.0
            for start, end, t0, w, slope in segments:
                x = min(max(r["t"] - t0, 0), (next((s[2] for s in segments if s[2] > t0), 1.0)) - t0)
                total += w * x + slope * x * x / 2
            assert total == pytest.approx(r["u"], abs=1e-9)


def test_flow_moves_fewest_bytes():
    rng = random.Random(3)
    for _ in range(20):
        supplies = [rng.randint(0, 50) for _ in range(4)]
        room = sharding.even_capacities(sum(supplies), 6)
        flow = sharding.least_cost_flow(supplies, room)
        assert [sum(u for (i, _), u in flow.items() if i == k) for k in range(4)] == supplies
        assert all(sum(u for (_, j), u in flow.items() if j == k) <= room[k] for k in range(6))
        assert sum(u for (i, j), u in flow.items() if i == j) == sum(min(s, c) for s, c in zip(supplies, room))


def test_sharding_law(spark, corpus, tmp_path):
    rows = [(i, prose(RNG.randint(1, 60)), f"s{0 if i % 3 == 0 else i % 17}") for i in range(2500)] + ROWS
    folder = corpus(rows)
    out = sharding.op1_sharding(spark, folder).collect()
    assert len(out) == len(rows)
    texts = {(i, zlib.crc32((t or "").encode())): len((t or "").encode()) + 16 for i, t, _ in rows}
    bytes_of, slots = Counter(), defaultdict(list)
    for r in out:
        assert texts[r["doc_id"], r["text_crc32"]] == r["size"]
        bytes_of[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(bytes_of) == set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = sorted(r["size"] for r in out)[-2]
    calm = [b for s, b in bytes_of.items()]
    assert sorted(calm)[-2] - min(calm) <= 2 * largest


def test_rewrite_only_affected(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x" * (20 if i < 30 else 4)) for i in range(60)], "doc_id long, text string")
    old = F.pmod("doc_id", F.lit(3))
    sizes = [r["n"] for r in sharding.measured(docs, old).groupBy("old_shard").agg(F.sum("size").alias("n")).orderBy("old_shard").collect()]
    plan = sharding.reshard(sharding.staged(sharding.measured(docs, old), "t"), 3, [sizes[0], sizes[1] - 60, sizes[2] + 60])
    numbers = sharding.rewrite_affected(docs, plan, f"{tmp_path}/out")
    assert 0 not in numbers and set(numbers) == {1, 2}
    assert spark.read.parquet(f"{tmp_path}/out").count() == plan.filter("shard > 0").count()


@pytest.mark.parametrize("room", [lambda s: [s[0], s[1] - 60, s[2] + 60], lambda s: [s[0], 0, s[1] + s[2]]])
def test_rewrite_in_place_keeps_every_row(spark, tmp_path, room):
    path = f"{tmp_path}/layout"
    rows = [(None if i % 10 == 7 else i // 2 * 2 % 40, "x" * (20 if i < 30 else 4), i, i % 3) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, n int, shard int").write.partitionBy("shard").parquet(path)
    docs = spark.read.parquet(path)
    files = sorted((f.name, f.read_bytes()) for f in (tmp_path / "layout/shard=0").iterdir())
    measured = sharding.staged(sharding.measured(docs, F.col("shard"), keep=sharding.whole(docs)), "t")
    sizes = [r["n"] for r in measured.groupBy("old_shard").agg(F.sum("size").alias("n")).orderBy("old_shard").collect()]
    plan = sharding.reshard(measured, 3, room(sizes))
    want = sorted((r["n"], r["shard"]) for r in plan.select("document.n", "shard").collect())
    assert sharding.rewrite_affected(docs, plan, path) == [1, 2]
    out = spark.read.parquet(path).collect()
    assert sorted((r["n"], r["shard"]) for r in out) == want
    assert sorted((r["n"], r["doc_id"], r["text"]) for r in out if r["doc_id"] is not None) == sorted((n, i, t) for i, t, n, _ in rows if i is not None)
    assert sorted((f.name, f.read_bytes()) for f in (tmp_path / "layout/shard=0").iterdir()) == files
    with pytest.raises(ValueError):
        sharding.rewrite_affected(docs, plan.drop("document"), f"{tmp_path}/other")


@pytest.mark.parametrize("query", [sharding.op1_sharding, secrets.op5_secret_scans, quality.op6_quality_rules, mixing.op9_mixing])
def test_empty_table(spark, corpus, query):
    assert query(spark, corpus([])).count() == 0
