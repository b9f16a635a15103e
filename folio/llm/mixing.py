"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time 0 to 1, piecewise linear between knots. Integrating it gives the
source's cumulative demand of words; inverting that at a document's place in its source's shuffled line gives the
training time at which the document is read, and a range sort by that time is the training order. A source whose target
exceeds its size is read a second time from the start of its line, so no document is taken more than twice.

A hot source is no hot task: the place in line is a two-level running sum over buckets of the hash of doc_id and text,
in which equal rows are counted before they are shuffled. Sources are few against rows; their totals form one small
table, which only windows over sees (a row a source in one task).

Null source: one source of its own, last. Null, empty or blank text: size 0, taken 0 and no position. A very long text is
read as a whole or, at the end of its source's target, in part. Repeated rows are documents of their own, side by side in
line; rows of one doc_id stand where their texts' hashes put them. Equal positions (ties) are ordered by that hash. An
empty table gives an empty result. `mix` passes other columns by, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.shared import running_start, staged, word_count

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Weight schedules as knots (time, relative weight), given to the sources in turn: fading, steady, growing.
SCHEDULES = (
    ((0.0, 3.0), (0.5, 1.0), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 1.0), (1.0, 3.0)),
)
#: Sources up to which their targets are broadcast: some hundred bytes each.
FEW_SOURCES = 20_000


def _segments(knots) -> list[tuple[float, float, float, float, float]]:
    """(demand at the start, demand at the end, time, length, weight, slope) of each stretch, for a total demand of 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
    out, at = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        part = (t1 - t0) * (w0 + w1) / 2 / area
        out.append((at, at + part, t0, w0 / area, (w1 - w0) / (t1 - t0) / area))
        at += part
    return out


def training_time(share: Column, knots) -> Column:
    """The time at which a source's cumulative demand reaches share (0 to 1) of its target."""
    segments = _segments(knots)
    time = F.lit(float(knots[-1][0]))
    for start, end, t0, weight, slope in reversed(segments):
        rest = share - F.lit(start)
        if slope:
            root = (F.sqrt(F.greatest(F.lit(weight * weight) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(weight)) / F.lit(slope)
        else:
            root = rest / F.lit(weight)
        time = F.when(share < F.lit(end), F.lit(t0) + root).otherwise(time)
    return time


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """sizes (no_source, name, source_size) with turn and target: share of all words by weight, at most `most` times a source's size.

    Sharing what the full sources leave until none is above its limit ends where every source has
    min(its limit, weight * level); with the sources in order of limit / weight, the level is that of the first source
    that its share doesn't fill.
    """
    by_name = Window.orderBy("no_source", "name")
    by_ratio = Window.orderBy("ratio", "turn")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cycle = F.array(*map(F.lit, weights))
    ranked = (
        sizes.withColumn("turn", F.row_number().over(by_name) - 1)
        .withColumn("weight", F.get(cycle, F.pmod("turn", F.lit(len(weights)))).cast("double"))
        .withColumn("limit", F.col("source_size") * F.lit(float(most)))
        .withColumn("ratio", F.col("limit") / F.col("weight"))
    )
    budget = F.lit(share) * F.sum("source_size").over(everything)
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    return (
        ranked.withColumn("level", level)
        .withColumn("rank", F.row_number().over(by_ratio))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))).over(everything)["level"])
        .withColumn("target", F.least("limit", F.coalesce(F.col("weight") * F.col("level"), F.col("limit"))))
        .select("no_source", "name", "source_size", "turn", "target")
    )


def sized(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", keep=()) -> DataFrame:
    """Slim rows: doc_id, size, no_source, name, the hash by which they stand in line, and the part that wrote them."""
    body, name = F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{source}`")
    line = F.md5(F.concat_ws("|", F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.md5(body)))
    return df.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        word_count(body).alias("size"),
        name.isNull().alias("no_source"),
        F.coalesce(name, F.lit("")).alias("name"),
        line.alias("line"),
        F.spark_partition_id().alias("part"),
        *keep,
    )


def places(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, schedules=SCHEDULES, order=("line",)) -> DataFrame:
    """rows (as of `sized`, staged) with source_size, target, taken and the times first_position and second_position (null: not read)."""
    key = ["no_source", "name"]
    goals = staged(targets(rows.groupBy(*key).agg(F.sum("size").alias("source_size")), weights, share), "mix-targets")
    if goals.count() <= FEW_SOURCES:
        goals = F.broadcast(goals)
    placed = running_start(rows, key, list(order), "size", "start").join(goals, key)
    goal = F.floor(F.col("target") + F.lit(1e-6)).cast("long")
    read = lambda start: F.greatest(F.lit(0), F.least(F.col("size"), goal - start))

    def when_read(start: Column) -> Column:
        at = start.cast("double") / F.greatest(goal, F.lit(1))
        time = training_time(at, schedules[-1])
        for k in range(len(schedules) - 1):
            time = F.when(F.pmod("turn", F.lit(len(schedules))) == k, training_time(at, schedules[k])).otherwise(time)
        return F.when(read(start) > 0, F.round(time, 9))

    again = F.col("source_size") + F.col("start")
    return (
        placed.withColumn("first_taken", read(F.col("start")))
        .withColumn("second_taken", read(again))
        .withColumn("taken", F.col("first_taken") + F.col("second_taken"))
        .withColumn("first_position", when_read(F.col("start")))
        .withColumn("second_position", when_read(again))
        .drop("part")
    )


def mix(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, share: float = SHARE, schedules=SCHEDULES) -> DataFrame:
    """The documents in training order, once for each reading of which at least half is taken, with df's columns.

    Rows that are equal in every column are told apart by nothing, so one of them stands for all when the places are
    joined with the rows; whole rows are shuffled twice, once for that and once by training time.
    """
    columns = [F.col(f"`{f.name}`") for f in df.schema.fields]
    hashed = [F.to_json(F.struct(c)) if "map<" in f.dataType.simpleString() else c for c, f in zip(columns, df.schema.fields)]
    identity = [F.xxhash64(*hashed).alias("id_a"), F.xxhash64(F.lit("second"), *hashed).alias("id_b")]
    line = places(staged(sized(df, doc_id, source, text, identity), "mix-sizes"), weights, share, schedules, ("line", "id_a", "id_b"))
    readings = F.array(F.struct(F.col("first_position").alias("at"), F.col("first_taken").alias("n")), F.struct(F.col("second_position").alias("at"), F.col("second_taken").alias("n")))
    read = F.filter(readings, lambda x: x["at"].isNotNull() & (2 * x["n"] >= F.col("size")))
    times = line.select("id_a", "id_b", "line", F.explode(F.transform(read, lambda x: x["at"])).alias("time"))
    rows = df.select(*identity, F.struct(*columns).alias("row")).dropDuplicates(["id_a", "id_b"])
    return rows.join(times, ["id_a", "id_b"]).orderBy("time", "line").select(*(F.col("row")[c].alias(c) for c in df.columns))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    rows = staged(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    placed = places(rows).orderBy(F.col("first_position").asc_nulls_last(), "line")
    return placed.select("doc_id", "size", "source_size", "target", "taken", "first_position", "second_position")


def _time_sql(knots) -> str:
    """training_time as SQL over the column share."""
    out = "CASE"
    for start, end, t0, weight, slope in _segments(knots):
        root = f"(sqrt(greatest({weight * weight!r}::DOUBLE + {2 * slope!r}::DOUBLE * (share - {start!r}::DOUBLE), 0)) - {weight!r}::DOUBLE) / {slope!r}::DOUBLE" if slope else f"(share - {start!r}::DOUBLE) / {weight!r}::DOUBLE"
        out += f" WHEN share < {end!r}::DOUBLE THEN {t0!r}::DOUBLE + {root}"
    return f"{out} ELSE {float(knots[-1][0])!r}::DOUBLE END"


_TIME = "CASE " + " ".join(f"WHEN turn % {len(SCHEDULES)} = {k} THEN {_time_sql(s)}" for k, s in enumerate(SCHEDULES)) + " END"
_CYCLE = f"list_value({', '.join(map(str, WEIGHTS))})"
ORACLE = rf"""
WITH s AS (
  SELECT doc_id, source IS NULL AS no_source, coalesce(source, '') AS name, md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))) AS line,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
g AS (SELECT no_source, name, sum(size)::BIGINT AS source_size FROM s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY no_source, name) - 1 AS turn FROM g),
w AS (SELECT *, {_CYCLE}[(turn % {len(WEIGHTS)} + 1)::BIGINT]::DOUBLE AS weight, source_size * {float(MOST_EPOCHS)}::DOUBLE AS most FROM r),
x AS (SELECT *, most / weight AS ratio,
        ({SHARE}::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT no_source, name, source_size, turn, least(most, coalesce(weight * (SELECT level FROM x WHERE level <= ratio ORDER BY ratio, turn LIMIT 1), most)) AS target FROM x),
p AS (SELECT s.*, source_size, target, turn, floor(target + 1e-6)::BIGINT AS goal, (sum(size) OVER (PARTITION BY no_source, name ORDER BY line ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start FROM s JOIN t USING (no_source, name)),
q AS (SELECT *, greatest(0, least(size, goal - start)) AS one, greatest(0, least(size, goal - start - source_size)) AS two FROM p),
i AS (SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken, turn, one, two, start::DOUBLE / greatest(goal, 1) AS share, (start + source_size)::DOUBLE / greatest(goal, 1) AS again FROM q),
a AS (SELECT *, round({_TIME}, 9) AS read_at FROM i),
b AS (SELECT * REPLACE (again AS share), share AS first FROM a)
SELECT doc_id, size, source_size, target, taken, CASE WHEN one > 0 THEN read_at END AS first_position, CASE WHEN two > 0 THEN round({_TIME}, 9) END AS second_position
FROM b
"""
