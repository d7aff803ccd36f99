"""Streams give what the batch functions give."""

import pandas as pd
from pyspark.sql import functions as F

from corpuslens.operators import deltas as D
from corpuslens.operators.chunks import chunk_files
from corpuslens.streaming import answers as A
from corpuslens.streaming import index_stream as S


def feed(spark, batches, schema, folder):
    """A stream that delivers one batch of rows per trigger."""
    folder.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


CHANGES = [
    [("r", f"f{i}.ts", "add", "line\n" * (i * 150 + 1), i) for i in range(6)],
    [("r", "f1.ts", "unlink", None, 10), ("r", "f2.ts", "change", "short", 11), ("r", "f2.ts", "change", "shorter", 12), ("r", "x.md", "add", "no", 13)],
    [("r", "f1.ts", "add", "back", 20), ("r", "f3.ts", "change", "line\n" * 451, 21), ("r", "f4.ts", "unlink", None, 22), ("r", "f5.ts", "rename", "?", 23)],
]


def test_index_stream_equals_batch(spark, tmp_path):
    stream = feed(spark, CHANGES, S.CHANGE, tmp_path / "in")
    location = str(tmp_path / "index")
    start = spark.createDataFrame([("r", "f0.ts", "start"), ("r", "base.py", "kept\n" * 600)], "repo string, path string, content string")
    S.ensure_index(start, location)
    S.ensure_index(start.limit(0), location)
    query = S.index_changes(stream, location, str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(300)
    key = lambda df: sorted((r.file_path, r.chunk_id, r.text) for r in df.collect())
    every = [("r", "base.py", "add", "kept\n" * 600, -1)] + [c for b in CHANGES for c in b]
    left = S.changes_after(S.latest_changes(spark.createDataFrame(every, S.CHANGE)).withColumn("seq", F.lit(0).cast("long")))
    assert key(S.current_chunks(spark, location)) == key(chunk_files(left))
    # a repeated batch changes nothing
    before = key(S.current_chunks(spark, location))
    S.write_batch(spark.createDataFrame(CHANGES[2], S.CHANGE), 2, location)
    assert key(S.current_chunks(spark, location)) == before
    f3 = S.current_manifest(spark, location).filter("path = 'f3.ts'").first()
    assert (f3.seq, f3.text_seq) == (21, 3)  # equal content: the older chunks stay valid


def paths(spark, location):
    return {r.path: r.seq for r in S.current_manifest(spark, location).collect()}


def test_new_checkpoint_late_event_and_redelivery(spark, tmp_path):
    location, key = str(tmp_path / "index"), lambda df: sorted((r.file_path, r.text) for r in df.collect())
    for run, rows in enumerate([[("r", "a.ts", "add", "one", 10)], [("r", "b.ts", "add", "two", 11)]]):
        stream = feed(spark, [rows], S.CHANGE, tmp_path / f"in{run}")
        S.index_changes(stream, location, str(tmp_path / f"cp{run}"), availableNow=True).awaitTermination(120)
    assert paths(spark, location) == {"a.ts": 10, "b.ts": 11}  # both queries began at batch 0
    late = [("r", "a.ts", "change", "older", 5), ("r", "c.ts", "unlink", None, 30)]
    S.write_batch(spark.createDataFrame(late, S.CHANGE), 7, location)
    S.write_batch(spark.createDataFrame([("r", "c.ts", "add", "back from the dead", 20)], S.CHANGE), 8, location)
    assert paths(spark, location) == {"a.ts": 10, "b.ts": 11}
    again = [("r", "b.ts", "add", "two", 11), ("r", "b.ts", "change", "three", 12), ("s", "b.ts", "add", "other", 1)]
    for batch in (9, 10):
        S.write_batch(spark.createDataFrame(again, S.CHANGE), batch, location)
    want = [("a.ts", "one"), ("b.ts", "other"), ("b.ts", "three")]
    assert key(S.current_chunks(spark, location)) == want
    target = str(tmp_path / "compact")
    S.compact(spark, location, target)
    assert key(S.current_chunks(spark, target)) == want
    S.write_batch(spark.createDataFrame([("r", "c.ts", "add", "still dead", 25)], S.CHANGE), 0, target)
    assert key(S.current_chunks(spark, target)) == want


def sse(text):
    words = text.split(" ")
    return [f'data: {{"choices":[{{"delta":{{"content":"{w if i == 0 else " " + w}"}}}}]}}' for i, w in enumerate(words)]


def test_answers_stream_equals_batch(spark, tmp_path):
    lines = []
    for sid, text in ((1, "hello big world"), (2, "one two")):
        raw = ['data: {"choices":[{"delta":{"reasoning":"hm"}}]}', *sse(text), "", "data: {bad", 'data: {"choices":[{"delta":{},"finish_reason":"stop"}]}', "data: [DONE]"]
        lines += [(sid, i, r) for i, r in enumerate(raw)]
    open_ended = [(3, i, r) for i, r in enumerate(sse("never ends"))]
    shuffled = sorted(lines + open_ended, key=lambda r: (r[1] * 7 + r[0]) % 5)
    ends = [x for x in shuffled if "finish" in x[2]]
    rest = [x for x in shuffled if "finish" not in x[2]]
    half = len(rest) // 2
    schema = "stream_id long, seq int, raw string"
    stream = feed(spark, [rest[:half], rest[half:], ends], schema, tmp_path / "in")
    query = (
        A.answers_from_lines(stream, idle_ms=None).writeStream.format("memory").queryName("answers").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(90)
    query.stop()
    got = {r.stream_id: (r.text, r.reasoning, r.finished) for r in spark.table("answers").collect()}
    assert got == {1: ("hello big world", "hm", True), 2: ("one two", "hm", True)}
    batch = D.reassemble(D.parse_sse_lines(spark.createDataFrame(lines, schema), "raw", ["stream_id", "seq"]))
    assert {r.stream_id: (r.text, r.reasoning, True) for r in batch.collect()} == got


class FakeState:
    """State of one key, driven by hand."""

    def __init__(self):
        self.value, self.hasTimedOut, self.timer, self.removed = None, False, None, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def setTimeoutDuration(self, ms):
        self.timer = ms

    def remove(self):
        self.value, self.removed = None, True


def lines(*rows):
    seq, kinds, deltas = zip(*rows, strict=True)
    return pd.DataFrame({"seq": seq, "part": [0] * len(rows), "type": kinds, "delta": deltas})


def run_step(step, state, *batches):
    return [row for out in step((7,), iter(batches), state) for row in out.values.tolist()]


def test_idle_answer_is_emitted_unfinished():
    state, step = FakeState(), A._step(500)
    rows = lines((1, A.CONTENT, " b"), (0, A.CONTENT, "a"), (3, A.CONTENT, " d"))
    assert run_step(step, state, rows) == [] and state.timer == 500
    state.hasTimedOut = True
    assert run_step(step, state) == [[7, "a b d", "", 3, False]]
    assert run_step(step, state) == [] and state.removed


def test_answer_waits_for_every_line_and_ends_once():
    """The stop comes first, a line is missing, lines are delivered again before and after the end."""
    state, step = FakeState(), A._step(500)
    stop, first, middle = lines((2, A.STOP, None), (0, A.CONTENT, "a")), lines((0, A.CONTENT, "a")), lines((1, A.CONTENT, "b"))
    assert run_step(step, state, stop) == [] and run_step(step, state, first) == []
    assert run_step(step, state, middle, stop) == [[7, "ab", "", 3, True]]
    assert run_step(step, state, stop, first, middle) == []
    assert state.value[1] == "" and state.value[5] == []  # an ended answer keeps a mark only
    state.hasTimedOut = True
    assert run_step(step, state) == [] and state.removed


def test_many_lines_in_reverse_order():
    state, step = FakeState(), A._step(None)
    for i in reversed(range(300)):
        out = run_step(step, state, lines((i, A.CONTENT if i < 299 else A.STOP, f"{i},")))
    assert out == [[7, "".join(f"{i}," for i in range(299)), "", 300, True]]


def test_progress_stream_equals_batch(spark, tmp_path):
    kinds = ["file-start", "agent-start", "thinking", "text", "agent-complete", "file-complete", "thinking", "complete"]
    rows = [(f"s{i % 2}", i, kinds[i % 8], f"a{i}", f"f{i}", f"c{i}") for i in range(37)]
    schema = "session string, seq long, type string, agent string, file_name string, content string"
    stream = feed(spark, [rows[:10], rows[20:], rows[10:20]], schema, tmp_path / "in")
    query = (
        A.progress(stream).writeStream.format("memory").queryName("progress").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(300)
    want = D.progress_state(spark.createDataFrame(rows, schema))
    assert sorted(spark.table("progress").collect()) == sorted(want.collect())


def test_reasoning_fold(spark):
    rows = [(1, 0, "reasoning", "abc", None), (1, 1, "text-delta", "t", "d"), (1, 2, "finish", None, "bcd"), (1, 3, "finish", None, "x"), (1, 4, "object", "no", "no")]
    df = spark.createDataFrame(rows, "stream_id long, seq long, type string, delta string, reasoning string")
    assert D.fold_reasoning(df).first().reasoning == "abcdx"


def test_long_answers_are_cut_into_segments(spark):
    rows = [(1, i, 0, "content_delta", f"{i},", None) for i in range(5000)]
    events = spark.createDataFrame(rows, "stream_id long, seq int, part int, type string, delta string, stop_reason string").withColumn(
        "usage", F.lit(None).cast("struct<total_tokens:long>")
    )
    assert D.reassemble(events).first().text == "".join(f"{i}," for i in range(5000))


def test_a_null_repository_is_one_like_others(spark, tmp_path):
    location = str(tmp_path / "index")
    rows = [(None, "a.ts", "add", "x\n" * 5, 0), ("r", "a.ts", "add", "y", 0), (None, "b.ts", "add", "z", 1)]
    later = [(None, "a.ts", "change", "new", 2), (None, "b.ts", "unlink", None, 3), (None, "a.ts", "change", "old", 1)]
    for batch, part in enumerate((rows, later)):
        S.write_batch(spark.createDataFrame(part, S.CHANGE), batch, location)
    found = {(r.repo, r.file_path, r.text) for r in S.current_chunks(spark, location).collect()}
    assert found == {(None, "a.ts", "new"), ("r", "a.ts", "y")}
    assert {(r.repo, r.path) for r in S.current_manifest(spark, location).collect()} == {(None, "a.ts"), ("r", "a.ts")}
    S.compact(spark, location, str(tmp_path / "small"))
    assert {(r.repo, r.text) for r in S.current_chunks(spark, str(tmp_path / "small")).collect()} == {(None, "new"), ("r", "y")}
