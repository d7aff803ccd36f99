"""Activity windows and sessions, in batch and on a stream, and chunks as a table function."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corpuslens.functions.tables import register_chunks_of
from corpuslens.operators.chunks import chunk_files
from corpuslens.streaming import activity as A
from tests.test_streaming import feed

SCHEMA = "event_id long, ts timestamp, user_id long, value double"
START = dt.datetime(2024, 5, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def some_events(n=300, seed=5):
    """Mostly one user, times with ties, whole gaps of 30 minutes among them."""
    rnd = random.Random(seed)
    return [(i, at(rnd.randrange(0, 2000, 5)), 1 if rnd.random() < 0.6 else rnd.randrange(40), rnd.randrange(1000) / 100) for i in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def sessions_by_hand(events, gap):
    out, by_user = [], {}
    for event in {e[0]: e for e in events}.values():
        by_user.setdefault(event[2], []).append(event)
    for user, held in by_user.items():
        held.sort(key=lambda e: e[1])
        run = [held[0]]
        for event in held[1:] + [None]:
            if event is None or event[1] > run[-1][1] + gap:
                out.append((user, run[0][1], run[-1][1] + gap, len(run), sum(round(e[3] * 100) for e in run)))
                run = []
            run.append(event)
    return sorted(out, key=repr)


def test_sessions_of_a_batch(spark):
    events = some_events()
    df = spark.createDataFrame(events + events[:80], SCHEMA)
    assert rows(A.activity_sessions(df, ["user_id"], "30 minutes", "value")) == sessions_by_hand(events, dt.timedelta(minutes=30))


@pytest.mark.parametrize("kind", ["windows", "sessions"])
def test_stream_gives_the_rows_of_the_batch(spark, tmp_path, kind):
    """Events come out of order by up to an hour and again within it; a last event far ahead closes everything."""
    events = sorted(some_events(), key=lambda e: e[1])
    rnd = random.Random(9)
    arrived = sorted(events + rnd.sample(events, 60), key=lambda e: e[1] + dt.timedelta(minutes=rnd.random() * 50))
    step = len(arrived) // 4 + 1
    batches = [arrived[i : i + step] for i in range(0, len(arrived), step)]
    far = [[(10_000 + i, at(100_000 + i), -1, 0.0)] for i in range(2)]
    stream = feed(spark, batches + far, SCHEMA, tmp_path / "in")

    def count(df):
        if kind == "windows":
            return A.activity_windows(df, ["user_id"], "1 hour", "30 minutes", "value", delay="3 hours")
        return A.activity_sessions(df, ["user_id"], "30 minutes", "value", delay="3 hours")

    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    query = count(stream).writeStream.format("parquet").option("checkpointLocation", cp).trigger(availableNow=True).start(out)
    assert query.awaitTermination(300)
    got = rows(spark.read.parquet(out).filter("user_id >= 0"))
    assert got == rows(count(spark.createDataFrame(events, SCHEMA)))


def test_nulls_repeats_and_empty_tables(spark):
    events = [
        (None, at(0), 1, 1.0), (None, at(0), 1, 1.0), (None, at(1), 1, None), (7, None, 1, 1.0),
        (8, at(2), None, 2.0), (8, at(2), None, 2.0), (8, at(2), None, 1.0), (9, at(2), None, 0.5),
    ]
    df = spark.createDataFrame(events, SCHEMA)
    assert rows(A.activity_windows(df, ["user_id"], value="value")) == [
        (1, at(0), at(60), 2, 100), (None, at(0), at(60), 2, 150)
    ]
    assert [tuple(r)[3:] for r in A.activity_sessions(df, ["user_id"], value="value").orderBy("user_id").collect()] == [(2, 150), (2, 100)]
    assert A.activity_windows(df.limit(0), ["user_id"]).columns == ["user_id", "window_start", "window_end", "n_events"]
    assert A.activity_sessions(df.limit(0), ["user_id"]).count() == 0


def test_a_hot_user_sends_slots_not_events(spark):
    """Ten thousand events of one user within two hours are ordered as at most five slots."""
    df = spark.range(10_000).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 7200).alias("ts"), F.lit(1).alias("user_id")
    )
    got = A.activity_sessions(df, ["user_id"]).collect()
    assert [(r.n_events, (r.session_end - r.session_start).seconds) for r in got] == [(10_000, 7199 + 1800)]


def test_chunks_function_equals_chunk_files(spark):
    rnd = random.Random(3)
    words = ["", "", " ", "\t", "a", "word", "x" * 30, "ü" * 12, "y" * 130]
    texts = ["\n".join(rnd.choice(words) for _ in range(rnd.randrange(0, 60))) for _ in range(300)] + [None, "", "\n\n", "z" * 500]
    files = spark.createDataFrame([("r", f"f{i}", t) for i, t in enumerate(texts)], "repo string, path string, content string")
    files.createOrReplaceTempView("files_to_cut")
    register_chunks_of(spark, "cut_text")
    for size, overlap in ((100, 200), (40, 50), (300, 0)):
        got = spark.sql(f"""select path as file_path, c.* from files_to_cut, lateral cut_text(content, {size}, {overlap // 50}) c""")
        want = chunk_files(files, size, overlap).select("file_path", "chunk_index", "line_start", "line_end", "text")
        assert rows(got) == rows(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        register_chunks_of(spark, "no name")
