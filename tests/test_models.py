"""What models write, with replies that fail or are malformed; calls by table index; copies that are scored alone."""

import pytest
from pyspark.sql import functions as F

from folio.operators import answer, generate, quality


def test_failing_batches_stay_pending(spark):
    def ask(rows):
        if any(key == 4 for key, _ in rows):
            raise OSError("no answer")
        return [f"r{key}{text}" for key, text in rows] if len(rows) == 2 else []

    df = spark.createDataFrame([(k, "x" if k % 2 else None) for k in range(7)] + [(None, "y")], "id long, text string").coalesce(1)
    got = {r["id"]: r["reply"] for r in generate.replies(df, ask, at_once=2).collect()}
    assert got == {0: "r0", 1: "r1x", 2: "r2", 3: "r3x", 4: None, 5: None, 6: None}


@pytest.mark.parametrize(
    "reply,want",
    [
        ('[{"chunk_id": 1, "questions": ["a?", " ", "b?"]}, {"chunk_id": 2, "questions": ["c?"]}]', ["a?", "b?"]),
        ('Aqui:\n```json\n[{"chunk_id": 1, "questions": ["a?"]}]\n```\nfim', ["a?"]),
        ('[{"chunk_id": 1}]', []),
        ("nada", []),
        ("", []),
        (None, []),
        ('[{"chunk_id": 1, "questions": [null, "d?"]}]', ["d?"]),
    ],
)
def test_questions_of_replies(spark, reply, want):
    df = spark.createDataFrame([(1, reply)], "id long, reply string")
    assert [r["question"] for r in generate.questions(df).orderBy("place").collect()] == want


def test_summaries_and_sections(spark):
    df = spark.createDataFrame([(1, '[{"page_id": 1, "summary": " s "}]'), (2, '[{"page_id": 1, "summary": "s"}]'), (3, '[{"page_id": 3, "summary": " "}]'), (4, None)], "id long, reply string")
    assert [tuple(r) for r in generate.summaries(df).collect()] == [(1, "s")]
    rows = spark.createDataFrame([(1, '[{"section_title": "A", "page_range": "1-2", "summary_text": "x"}, {"section_title": "B", "summary_text": ""}]'), (2, "[]")], "id long, reply string")
    assert [tuple(r) for r in generate.sections(rows).collect()] == [(1, 0, "A", "1-2", "x")]
    covered = spark.createDataFrame([(1,), (1,)], "id long")
    assert [r["id"] for r in generate.pending(df, covered).orderBy("id").collect()] == [2, 3, 4]


def test_calls_by_index(spark):
    tables = spark.createDataFrame([("o", 0, ["A", "B"], [["1", "2"], ["3", "4"]]), ("o", 1, ["A"], [])], "owner string, table_index int, headers array<string>, rows array<array<string>>")
    calls = spark.createDataFrame([(1, "o", 0), (2, "o", 1), (3, "o", 2), (4, "o", -1), (5, "p", 0), (6, "o", None)], "id int, owner string, table_index int")
    got = {r["id"]: (r["result"], r["error"]) for r in answer.call_indexed(calls, tables, "count_rows", {}).collect()}
    assert got == {1: ("2", None), 2: ("0", None), 3: (None, "no table: 2"), 4: (None, "no table: -1"), 5: (None, "no table: 0"), 6: (None, "no table: null")}


def test_only_texts_that_stand_twice_are_scored(spark):
    good = " ".join(f"A palavra numero {w} fica aqui bem escrita." for w in "um dois tres quatro cinco seis sete oito nove dez".split())
    rows = [(1, good), (2, good.upper()), (3, "curto"), (4, "curto"), (5, good + " Fim da lista toda."), (6, good), (7, None), (8, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    want = quality.duplicates(quality.scored(df, "text").filter("NOT quarantined"), ["id"], "text").select("id", "first_id")
    got = quality.sound_duplicates(df, ["id"], "text").select("id", "first_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
