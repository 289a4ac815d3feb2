import json
import struct

import pytest
from pyspark.sql import functions as F

from siftline.sources import readers, writers
from siftline.streaming import ingest


def pack(v):
    if v is None:
        return b"\xc0"
    if isinstance(v, bool):
        return b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        return bytes([v]) if 0 <= v < 128 else b"\xd3" + struct.pack(">q", v)
    if isinstance(v, str):
        b = v.encode()
        return (bytes([0xA0 | len(b)]) if len(b) < 32 else b"\xda" + struct.pack(">H", len(b))) + b
    if isinstance(v, dict):
        return bytes([0x80 | len(v)]) + b"".join(pack(k) + pack(x) for k, x in v.items())
    return bytes([0x90 | len(v)]) + b"".join(map(pack, v))


def test_frames(spark, tmp_path):
    rows = [{"source": "telegram:a", "message_id": 5_000_000_000, "text": "x" * 40, "message_meta": {"views": "3"}}, {"source": "b", "text": None}]
    data = b"".join(struct.pack(">I", len(p)) + p for p in map(pack, rows)) + struct.pack(">I", 3) + b"\xc1\xc1\xc1" + struct.pack(">I", 99) + b"cut"
    (tmp_path / "a.bin").write_bytes(data)
    got = readers.reader("msgpack")(spark, str(tmp_path / "a.bin")).orderBy("source").collect()
    assert [(r.source, r.message_id) for r in got] == [("b", None), ("telegram:a", 5_000_000_000)] and got[1].message_meta == {"views": "3"}


def test_an_oversized_frame_is_skipped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readers, "FRAME_BYTES", 64)
    good = [pack({"source": s, "text": s}) for s in ("a", "b", "c")]
    parts = [good[0], pack({"source": "long", "text": "x" * 40, "title": "y" * 40}), good[1], good[2]]
    data = b"".join(struct.pack(">I", len(p)) + p for p in parts)
    assert [m["source"] for m in readers.frames(data)] == ["a", "b", "c"]


def test_lines_and_lists(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"source": "s", "text": "t"}\nnot json\n\n{"source": "u"}\n')
    assert {r.source for r in readers.ndjson(spark, str(tmp_path / "m.json")).where("source is not null").collect()} == {"s", "u"}
    (tmp_path / "l.txt").write_text("# head\nA.example # why\n\n a.example\nb.example\n")
    assert {r.value for r in readers.line_list(spark, str(tmp_path / "l.txt")).collect()} == {"a.example", "b.example"}
    (tmp_path / "c.csv").write_text("domain,geo\n# c\na.example,DE\n")
    assert [tuple(r) for r in readers.csv_records(spark, str(tmp_path / "c.csv"), "domain string, geo string").collect()] == [("a.example", "DE")]


def test_lexicon(spark, tmp_path):
    base = {"keywords": [{"id": "1", "phrase": " A  b ", "weight": 3, "tag": None}, {"id": "2", "phrase": "x", "weight": 1, "tag": "hard-reject"}], "negative": [{"id": "3", "phrase": "", "weight": 1}]}
    (tmp_path / "k.json").write_text(json.dumps(base))
    got = {(r.list_name, r.phrase) for r in readers.lexicon(spark, str(tmp_path / "k.json")).collect()}
    assert got == {("keywords", "a b"), ("hard_reject", "x")}


def test_merge_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("a", 1, "new", 5), ("b", 1, "new", 1)], "k string, ts int, status string, score int")
    two = spark.createDataFrame([("a", 2, "won", 9)], "k string, ts int, status string, score int")
    writers.merge(one, path, "k", "ts", ["status"])
    writers.merge(two, path, "k", "ts", ["status"])
    again = writers.merge(two, path, "k", "ts", ["status"])
    assert {tuple(r) for r in again.select("k", "ts", "status", "score").collect()} == {("a", 2, "new", 9), ("b", 1, "new", 1)}


def test_a_failed_merge_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, "new", 5)], "k string, ts int, status string, score int")
    for n in range(5):
        writers.merge(rows.withColumn("ts", F.lit(n)), path, "k", "ts", ["status"])
    assert writers.current(spark, path) == 4 and sorted(p.name for p in (tmp_path / "t").iterdir() if p.name.startswith("v")) == ["v3", "v4"]
    # a version without a pointer is what a failed run leaves behind
    rows.write.parquet(f"{path}/v5")
    assert [r.ts for r in writers.merged(spark, path).collect()] == [4]
    with pytest.raises(Exception):
        writers.merge(rows.withColumn("ts", F.raise_error("lost")), path, "k", "ts", ["status"])
    assert [r.ts for r in writers.merged(spark, path).collect()] == [4]
    assert [r.ts for r in writers.merge(rows.withColumn("ts", F.lit(9)), path, "k", "ts", ["status"]).collect()] == [9]


def test_stream_equals_batch(spark, tmp_path):
    from siftline.operators import redelivery as R

    base = {"source": "telegram:r", "username": "u", "text": "t", "posted_at": "2026-01-01T00:00:00Z"}
    rows = [base | {"message_id": m} for m in (1, 1, 2, None, None, 3, 2)]
    (tmp_path / "in").mkdir()
    for i, r in enumerate(rows):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(r) + "\n")
    out = []
    stream = ingest.once(ingest.messages(spark, str(tmp_path / "in"), files_per_trigger=2))
    ingest.run_available(stream, str(tmp_path / "cp"), lambda df, _: out.extend(df.select("message_id").collect()))
    batch = spark.createDataFrame([(i, "telegram:r", m, "u") for i, m in enumerate((1, 1, 2, None, None, 3, 2))], "arrival_seq bigint, source string, message_id bigint, username string")
    key = lambda r: (r.message_id is None, r.message_id or 0)
    assert sorted(map(key, out)) == sorted(map(key, R.first_copies(batch).collect()))


def test_thread_state_equals_window(spark, tmp_path):
    from siftline.operators import entity

    rows = [(i, "s", f"u{i % 2}", f"t{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "arrival_seq bigint, source string, username string, text string")
    (tmp_path / "in").mkdir()
    for i in range(0, 20, 5):
        df.where(f"arrival_seq >= {i} and arrival_seq < {i + 5}").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    out = []
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    ingest.run_available(ingest.author_threads(stream, 3), str(tmp_path / "cp"), lambda b, _: out.extend(b.collect()))
    want = entity.thread_windows(df, ["source", "username"], ["arrival_seq"], "text", 3)
    assert {(r.arrival_seq, r.thread) for r in out} == {(r.arrival_seq, r.thread) for r in want.collect()}


def test_windows(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps({"k": "a", "at": f"2026-01-0{d}T00:10:00Z"}) for d in (1, 1, 2, 5)))
    out = []
    stream = spark.readStream.schema("k string, at timestamp").json(str(tmp_path / "in"))
    ingest.run_available(ingest.windowed_counts(stream, "k", "at"), str(tmp_path / "cp"), lambda b, _: out.extend(b.collect()))
    assert {(r.start.day, r.n) for r in out} >= {(1, 2), (2, 1)}


def test_exports_events_and_registries(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"id": 1, "t": "a"}\n{"id": 2, "t": "' + "x" * 200 + '"}\nno json\n{"id": 3}\n')
    assert [r.id for r in readers.export_rows(spark, str(tmp_path / "e.json"), "id int, t string", 100).where("id is not null").orderBy("id").collect()] == [1, 3]
    (tmp_path / "p.json").write_text('{"kind": "sync", "name": "fsync", "value": 1.5}\n{"kind": "sync"}\n{"value": 3}\n')
    assert [(r.kind, r.value) for r in readers.perf_events(spark, str(tmp_path / "p.json")).collect()] == [("sync", 1.5)]
    (tmp_path / "r1.json").write_text('{"domain": "A.example ", "types": ["web"], "kind": "seed", "seen_at": "2026-01-02T00:00:00Z"}\n{"domain": ""}\n')
    (tmp_path / "r2.json").write_text('{"domain": "a.example", "types": ["forum", "web"], "kind": "found", "seen_at": "2026-01-03T00:00:00Z"}\n{"domain": "b.example"}\n')
    got = {r.domain: (r.types, r.kind) for r in readers.registry(spark, str(tmp_path / "r1.json"), str(tmp_path / "r2.json")).collect()}
    assert got == {"a.example": (["forum", "web"], "seed"), "b.example": ([], None)}
