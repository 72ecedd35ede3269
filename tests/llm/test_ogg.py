import hashlib
import random
import zlib

import pytest
from awkward import rows
from pyspark.sql import functions as F

from corvane.llm import ogg as O


def bitwise(page):
    crc = 0
    for b in page[:22] + b"\0\0\0\0" + page[26:]:
        crc ^= b << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc >> 31 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_is_the_plain_polynomial_division():
    r = random.Random(1)
    for n in (27, 28, 100, 999):
        page = r.randbytes(n)
        assert O.page_checksum(page) == bitwise(page)


@pytest.mark.parametrize("sizes", [[0], [1], [255], [254, 255, 256], [0, 0, 510], [70_000, 3], [65_025], [65_024, 1], [255 * 255 * 3]])
def test_packets_of_any_size_come_back(sizes):
    r = random.Random(2)
    packets = [r.randbytes(n) for n in sizes]
    pages = list(O.stream_pages(9, packets, list(range(len(packets)))))
    s = O.read_pages(b"".join(pages))[9]
    assert s.packets == packets and s.pages == len(pages) and s.granules[-1] == len(packets) - 1


def test_streams_are_told_apart():
    a, b = ([bytes([x]) * 600 for x in range(k, k + 50)] for k in (0, 100))
    pa, pb = (list(O.stream_pages(n, p, [0] * 50, 4)) for n, p in ((5, a), (6, b)))
    s = O.read_pages(b"".join(x for pair in zip(pa, pb) for x in pair))
    assert s[5].packets == a and s[6].packets == b


@pytest.mark.parametrize("n", [1, 2, 3, 31, 32, 33, 64, 65, 200])
def test_payload_and_times(n):
    payload = random.Random(n).randbytes(O.UNIT * n)
    data = O.encode(payload)
    back, said = O.decode(data)
    assert back == payload and said["packets"] == n and said["streams"] == 2 and said["seconds"] == pytest.approx(n * O.UNIT / O.RATE)
    for k, s in enumerate(O.read_pages(data).values()):
        assert O.timestamps(s)[1:] == pytest.approx([(2 * j + k + 1) * O.UNIT / O.RATE for j in range(len(s.packets) - 1)])


@pytest.mark.parametrize("unit", [1, 100, 300, 4000])
def test_packets_of_another_size(unit):
    payload = random.Random(unit).randbytes(unit * 70)
    back, said = O.decode(O.encode(payload, unit))
    assert back == payload and said["packets"] == 70 and said["seconds"] == pytest.approx(len(payload) / O.RATE)


def test_damage_is_noticed():
    data = bytearray(O.encode(b"x" * O.UNIT * 9))
    for at in (0, 6, 14, 23, 40, 300, len(data) - 1):
        bad = bytes(data[:at]) + bytes([data[at] ^ 1]) + bytes(data[at + 1 :])
        with pytest.raises(ValueError):
            O.decode(bad)
    with pytest.raises(ValueError):
        O.decode(bytes(data[:-5]))
    with pytest.raises(ValueError):
        O.decode(bytes(data[:10]))


def test_frames(spark, docs, clashing, nothing):
    got = O.media_digest(O.probe(O.to_media(clashing))).collect()
    want = sorted(hashlib.sha256(O.padded(r[1])[0]).hexdigest() for r in rows())
    assert sorted(r.payload_sha256 for r in got) == want
    empty = next(r for r in got if r.doc_id == 200)
    assert (empty.n_bytes, empty.payload_bytes, empty.tail_crc32) == (0, 576, zlib.crc32(b"\xff" * 32))
    copies = [r for r in got if r.doc_id in (0, 100)]
    assert copies[0][1:] == copies[1][1:]
    bad = spark.createDataFrame([(1, bytearray(b"junk"), "e"), (2, None, "e")], "doc_id long, media binary, error string")
    out = {r.doc_id: r for r in O.probe(bad).collect()}
    assert out[1].error and out[1].payload is None and out[2].error is None
    told = {r.doc_id: r for r in O.media_digest(O.probe(bad).withColumn("n_bytes", F.lit(4).cast("long"))).collect()}
    assert told[1].payload_sha256 is None and told[1].media_bytes == 4 and told[1].feature.startswith("error=") and told[2].media_bytes is None and told[2].feature is None
    assert O.media_digest(O.probe(O.to_media(nothing))).collect() == []
