import gzip
import hashlib
import io

import pytest
from pyarrow import fs

from countweave.llm import warc as W

LONG, OTHER = "é" * 50, "y" * 100
ROWS = [(7, "http://a/", LONG), (3, "http://b/\r\nx", LONG), (5, None, LONG), (3, "c", LONG), (None, "d", LONG), (1, "e", None), (2, "f", ""), (4, "g", "z" * 99), (6, "h", "z" * 99), (None, "i", OTHER), (None, "j", OTHER), (8, "k", "\r\n\r\nWARC/1.1\r\n" * 20_000)]
SCHEMA = "page_id long, url string, html string, path string, `key` int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], SCHEMA)


def test_round_trip(spark):
    archives = W.write(frame(spark, ROWS))
    got = W.read(archives).collect()
    assert len(got) == len(ROWS)
    want = []
    for key, url, text in ROWS:
        data = (text or "").encode()
        least = min((k for k, _, t in ROWS if k is not None and (t or "").encode() == data), default=None) if len(data) >= 100 else None
        refers = None if least is None or least == key else least
        want.append((key, None if url is None else url.replace("\r", "%0D").replace("\n", "%0A"), "response" if refers is None else "revisit", refers, hashlib.sha256(data).hexdigest(), len(data), data if refers is None else None))
    assert sorted(map(str, want)) == sorted(str((r.key, r.url, r.record_type, r.refers_to, r.payload_digest, r.payload_bytes, None if r.payload is None else bytes(r.payload))) for r in got)


def test_any_gzip_reader_reads_it(spark):
    for row in W.write(frame(spark, ROWS)).collect():
        store, at = fs.FileSystem.from_uri(row.path)
        with store.open_input_stream(at, compression=None) as f:
            text = gzip.decompress(f.read())
        assert text.count(b"WARC-Record-ID: ") == row.records


def test_rolls_over_and_empty(spark, monkeypatch):
    made = W.write(frame(spark, []))
    assert made.collect() == [] and W.read(made).collect() == []


def test_damage_is_seen():
    good = W.record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [W.parse(m)["payload"] for m in W.members(io.BytesIO(good * 3))] == [b"payload"] * 3
    with pytest.raises(ValueError):
        list(W.members(io.BytesIO(good[:-4])))
    text = next(W.members(io.BytesIO(good)))
    for bad in (text.replace(b"payload", b"paYload"), text.replace(b"payload", b"pay"), text[:-2]):
        with pytest.raises(ValueError):
            W.parse(bad)
    lying = W.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        W.parse(next(W.members(io.BytesIO(lying))))
