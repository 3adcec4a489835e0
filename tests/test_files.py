"""Manifests replayed, logs followed and media read, from files that arrive."""

import json

import pytest
from pyspark.sql import functions as F

from mnemograph.sources import media
from mnemograph.streaming.replay import ReplayJob, follow_log, read_lines


def as_of():
    return F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")


def line(uuid, content="text", source="s", timestamp="2024-01-02T03:04:05Z", **more):
    return json.dumps({"uuid": uuid, "content": content, "source": source, "timestamp": timestamp, **more})


def put(path, *lines):
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_replay_takes_each_entry_once_and_counts_rejects(spark, tmp_path):
    folder, root, seen = tmp_path / "in", str(tmp_path / "root"), []
    stream = lambda: read_lines(spark, str(folder), per_trigger=1)
    note = lambda rows, n: seen.append((n, sorted(r.id for r in rows.collect())))
    put(folder / "a.jsonl", line("1", image_file="x.jpg", audio_file="y.mp3"), "", "  ", "{oops", line("2", content=""), line("3", timestamp="never"), line(None), line("4", source=None), "[]")
    ReplayJob(spark, root, as_of(), note).run(stream())
    put(folder / "b.jsonl", line("1", content="again"), line("2", content="now"), line("5", content="z"), line("5", content="a"), line("5", content="a"))
    job = ReplayJob(spark, root, as_of(), note)
    job.run(stream())
    job.run(stream())
    rows = {r.id: r for r in job.entries.read().collect()}
    assert {k: r.content for k, r in rows.items()} == {"1": "text", "2": "now", "3": "text", "5": "a"}
    assert (rows["1"].image_url, rows["1"].audio_url, str(rows["1"].ts), str(rows["3"].ts)) == ("x.jpg", "y.mp3", "2024-01-02 03:04:05", "2024-05-01 00:00:00")
    got = sorted((r.reason, r.line) for r in job.rejected.read().collect())
    assert [r for r, _ in got] == ["content is required"] + ["not decodable"] * 3 + ["source is required"]
    assert all(r.file.endswith("a.jsonl") for r in job.rejected.read().collect())
    assert seen == [(0, ["1", "3"]), (1, ["2", "5"])]


def test_replay_of_a_batch_again_changes_nothing(spark, tmp_path):
    job, seen = ReplayJob(spark, str(tmp_path / "r"), as_of()), []
    batch = spark.createDataFrame([(line("1"), "f"), ("oops", "f"), (line("1"), "e")], "value string, file string")
    job.then = lambda rows, n: seen.append(rows.count())
    for _ in range(2):
        job.handle(batch, 0)
    job.handle(batch.limit(0), 1)
    assert seen == [1, 1, 0] and job.entries.read().count() == 1 and job.rejected.read().count() == 1


def test_replay_fails_with_what_it_feeds_and_goes_on(spark, tmp_path):
    root, folder = str(tmp_path / "root"), tmp_path / "in"
    put(folder / "a.jsonl", line("1"))

    def broken(rows, n):
        raise RuntimeError("down")

    with pytest.raises(Exception, match="down"):
        ReplayJob(spark, root, as_of(), broken).run(read_lines(spark, str(folder)))
    job = ReplayJob(spark, root, as_of())
    assert job.entries.read().count() == 0
    job.run(read_lines(spark, str(folder)))
    assert [r.id for r in job.entries.read().collect()] == ["1"]


def test_follow_log(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "root")
    say = lambda t, **f: json.dumps({"timestamp": t, **f})
    put(
        folder / "a.log", say("2024-01-01T00:00:00Z", jsonPayload={"msg": "LLM_CONTEXT_AUDIT a", "trace_id": "t", "path": "/p"}), "{oops",
        say("2024-01-01T00:00:01Z", jsonPayload={"severity": "WARN", "message": "x LLM_CONTEXT_AUDIT"}), say("2024-01-01T00:00:02Z", jsonPayload={"msg": "other"}),
        say("never", textPayload="LLM_CONTEXT_AUDIT"), say("2023-12-31T23:59:59Z", textPayload="LLM_CONTEXT_AUDIT early"),
    )
    follow = lambda: follow_log(read_lines(spark, str(folder)), root, start="2024-01-01 00:00:00", end="2024-01-02 00:00:00")
    assert follow().count() == 4
    put(folder / "b.log", say("2024-01-01T01:00:00Z", textPayload="LLM_CONTEXT_AUDIT " + "y" * 500), say("2024-01-02T00:00:00Z", textPayload="LLM_CONTEXT_AUDIT late"))
    out = follow().collect()
    lines = {r.line for r in out if r.rejected is None}
    assert lines == {"[INFO] LLM_CONTEXT_AUDIT a trace_id=t path=/p", "[WARN] x LLM_CONTEXT_AUDIT", "[long] LLM_CONTEXT_AUDIT " + "y" * 182 + "..."}
    assert sorted(r.rejected[:6] for r in out if r.rejected) == ['{"time', "{oops"] and len(out) == 5
    assert follow().count() == 5


@pytest.mark.parametrize("at_most", [1, 10_000])
def test_media_files(spark, tmp_path, at_most):
    for name, data in {"a/one.jpg": b"\x00\xff", "b/one.jpg": b"\x01", "b/two.jpg": b"", "b/three.jpg": b"xyz", "b/note.txt": b"n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    files = media.list_media(spark, str(tmp_path), r"/([a-z]+)\.jpg$", glob="*.jpg")
    assert {r.id: r.size for r in files.collect()}.keys() == {"one", "three"}
    wanted = spark.createDataFrame([("one",), ("one",), ("two",), ("three",), ("four",), (None,)], "id string")
    got = {r.id: (r.size, r.bytes and bytes(r.bytes)) for r in media.read_media(wanted, files, str(tmp_path), at_most).collect()}
    assert got.pop("one")[1] in (b"\x00\xff", b"\x01")
    assert got == {"two": (None, None), "three": (3, b"xyz"), "four": (None, None), None: (None, None)}
    assert media.read_media(wanted.filter("id = 'two'"), files, str(tmp_path)).first().bytes is None


def test_replay_writes_only_the_new_entries_of_a_batch(spark, tmp_path):
    job = ReplayJob(spark, str(tmp_path / "r"), as_of())
    rows = lambda ids: spark.createDataFrame([(line(str(i)), "f") for i in ids], "value string, file string")
    job.handle(rows(range(50)), 0)
    job.handle(rows(range(40, 60)), 1)
    assert spark.read.parquet(f"{job.root}/entries/data/version=1").count() == 10
    assert sorted(int(r.id) for r in job.entries.read().collect()) == list(range(60))
