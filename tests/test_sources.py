import os

import pytest
import yaml
from pyspark.sql import functions as F

from tidelane.sources import config, event_log, frames

VALID = {
    "app_name": "x", "version": "1.0.0", "ingestion": {
        "tcp": {"host": "h", "port": 9000, "maxConnections": 10}, "udp": {"host": "h", "port": 9001, "bufferSize": 1},
        "file": {"path": "", "poll_interval_ms": 1}
    },
    "router": {
        "shards": 4, "strategy": "hash_modulo", "buffer_size": 1
    }, "rule_engine": {
        "threads": 8, "cache_size": 0, "rules_file": "r"
    }, "storage": {"backend": "sqlite", "sqlite_path": "d/x.db"}, "python_integration": {"script_path": ""},
}


def changed(path, value):
    tree = yaml.safe_load(yaml.safe_dump(VALID))
    *way, last = path.split(".")
    node = tree
    for k in way:
        node = node[k]
    if value is None:
        del node[last]
    else:
        node[last] = value
    return tree


def test_valid_configuration(tmp_path):
    (tmp_path / "c.yaml").write_text(yaml.safe_dump(VALID))
    got = config.load(str(tmp_path / "c.yaml"))
    assert got["ingestion.tcp.port"] == 9000 and got["ingestion.tcp.enable"] is False


@pytest.mark.parametrize(
    ("path", "value"),
    [
        ("app_name", None), ("router.shards", "many"), ("ingestion.tcp.port", 70000), ("storage.backend", "tape"), ("rule_engine.threads", 0),
        ("ingestion.udp.host", None)
    ]
)
def test_invalid_configuration(path, value):
    with pytest.raises(ValueError):
        config.check(changed(path, value))


def test_missing_file():
    with pytest.raises(FileNotFoundError):
        config.load("/nowhere/x.yaml")
    assert config.dead_letter_path("a/b.db") == os.path.join("a", "dlq_log.txt")


BODIES = [
    (b"\x03\x00", frames.SHORT_BODY), (b"\x05\x00\x01a", frames.BAD_PRIORITY), (b"\x02\x00\x09a", frames.SHORT_TOPIC), (b"\x02\x00\x00\xff", frames.NO_TOPIC), (b"\x02\x00\x01a", None), (b"\x02\x00\x01\xffxy", None), (None, frames.SHORT_BODY),
]


def test_frame_bodies(spark):
    got = frames.decode_body(spark.createDataFrame([(b,) for b, _ in BODIES], "b binary"), "b").collect()
    assert [r.error for r in got] == [e for _, e in BODIES]
    assert (got[4].topic, bytes(got[4].payload)) == ("a", b"") and bytes(got[5].topic_bytes) == b"\xff" and bytes(got[5].payload) == b"xy"


def test_whole_frames_and_datagrams(spark):
    whole = b"\x00\x00\x00\x04\x02\x00\x01a"
    df = spark.createDataFrame([(b"\x00\x00",), (whole + b"x",), (whole,), (whole[:7],)], "f binary")
    assert [r.error for r in frames.decode_frame(df, "f").collect()] == [frames.SHORT_FRAME, frames.MISMATCH, None, frames.MISMATCH]
    assert [r.error for r in frames.decode_datagram(df, "f").collect()] == [frames.SHORT_FRAME, None, None, frames.SHORT_FRAME]


def test_encode_and_split(spark):
    df = spark.createDataFrame([(1, "té", b"\x00\x01"), (4, "x", b"")], "p int, t string, b binary")
    coded = [bytes(r.f) for r in df.select(frames.encode(F.col("p"), F.col("t"), F.col("b")).alias("f")).collect()]
    stream = b"\x00" * 40 + coded[0] + b"\x00" * 4 + coded[1] + coded[0][:5]
    bodies, tail, closed, _ = frames.split_stream(stream)
    assert bodies == [c[4:] for c in coded] and tail == coded[0][:5] and not closed
    assert frames.split_stream(b"\x00" * 44 + coded[0]) [:3] == ([], b"", True)
    assert frames.split_stream((frames.MAX_FRAME + 1).to_bytes(4, "big"))[2]
    got = frames.decode_body(
        frames.split_captures(spark.createDataFrame([("a", stream), ("b", None)], "path string, content binary")), "body"
    ).orderBy("seq").collect()
    assert [(r.path, r.priority, r.topic, bytes(r.payload)) for r in got] == [("a", 1, "té", b"\x00\x01"), ("a", 4, "x", b"")]


def test_event_log_tail(spark):
    df = spark.createDataFrame([(1700000000000000000, 1, 7, "t", b"abc")], "ts long, s int, id long, t string, b binary")
    data = bytes(df.select(event_log.encode(*(F.col(c) for c in df.columns)).alias("r")).first().r)
    assert list(event_log.read(data + data[:-1])) == [(1700000000000000000, 1, 7, b"t", b"abc")]
