"""Media columns: Ogg.

The container is written and read here by its own rules: pages with a 27-byte header, a segment table of lacing values, and
a checksum over the page (CRC with generator 0x04C11DB7, no reflection, zero start); packets end at the first lacing value
below 255 and may continue over pages; pages of several logical streams are interleaved and told apart by serial number; a page's granule
position counts the samples of the packets that end on it (-1: none ends).

A byte payload is stored as 8-bit unsigned PCM samples: a text's packets go alternately to two logical streams, each with a header packet,
and the reader restores their order from the timestamps derived from the granule positions.

Nulls: a null text is the empty text, whose payload is one unit of padding. A corrupt page (checksum, capture pattern, lacing,
missing sequence number) raises in `read_pages`; `probe` turns this into a row with `error` set. Null media gives nulls. Repeated rows yield repeated
result rows; empty tables empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, plus

#: Fixed values of the container format.
CAPTURE = b"OggS"
CONTINUED, FIRST, LAST = 1, 2, 4
NO_GRANULE = -1
PAGE_HEADER = struct.Struct("<4sBBqIIIB")
#: Header packet of a raw PCM stream: magic, version, sample format (unsigned 8 bit), rate, significant bits, channels, samples a packet, further headers.
PCM_MAGIC = b"PCM     "
PCM_HEADER = struct.Struct(">8sHHIIBBHI")
PCM_U8 = 1

UNIT = 576
RATE = 8000
SERIALS = (1, 2)

_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """The page's CRC, its checksum field taken as zero.

    The unreflected CRC of some bytes is the bit-reversed reflected CRC of the bit-reversed bytes, which zlib computes.
    """
    clear = page[:22] + b"\0\0\0\0" + page[26:]
    r = zlib.crc32(clear.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(r.to_bytes(4, "little").translate(_FLIP), "big")


@dataclass
class Stream:
    """A logical stream as read: whole packets, and for each the granule position of the page it ends on (or None)."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False


def make_page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    page = PAGE_HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def stream_pages(serial: int, packets: list[bytes], granules: list[int], page_packets: int = 32) -> Iterator[bytes]:
    """Pages of one logical stream; the first packet has a page of its own. A packet of any length spans as many pages as it needs."""
    sequence, flags = 0, FIRST
    groups = [packets[:1], *(packets[k : k + page_packets] for k in range(1, len(packets), page_packets))]
    ends = [granules[:1], *(granules[k : k + page_packets] for k in range(1, len(packets), page_packets))]
    for g, (group, marks) in enumerate(zip(groups, ends)):
        lacing = bytearray()
        done: list[int] = []  # segments after which a packet ends
        for p in group:
            lacing += b"\xff" * (len(p) // 255) + bytes([len(p) % 255])
            done.append(len(lacing))
        body = b"".join(group)
        at = 0
        for k in range(0, len(lacing), 255):
            part = bytes(lacing[k : k + 255])
            n = sum(part)
            closed = [m for m, d in zip(marks, done) if k < d <= k + len(part)]
            last = g == len(groups) - 1 and k + 255 >= len(lacing)
            yield make_page(serial, sequence, flags | (LAST if last else 0), closed[-1] if closed else NO_GRANULE, part, body[at : at + n])
            at += n
            sequence += 1
            flags = CONTINUED if part[-1] == 255 else 0


def read_pages(data: bytes) -> dict[int, Stream]:
    """Demultiplex: verify each page, and put packets together by lacing values, stream by stream."""
    streams: dict[int, Stream] = {}
    open_packet: dict[int, bytearray] = {}
    at = 0
    while at < len(data):
        if len(data) - at < PAGE_HEADER.size:
            raise ValueError("truncated page header")
        magic, version, flags, granule, serial, sequence, crc, n = PAGE_HEADER.unpack_from(data, at)
        if magic != CAPTURE or version:
            raise ValueError(f"no page at byte {at}")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(data):
            raise ValueError("truncated page")
        if page_checksum(data[at:end]) != crc:
            raise ValueError(f"checksum of page {sequence} of stream {serial}")
        s = streams.get(serial)
        if (s is None) != bool(flags & FIRST):
            raise ValueError("a stream begins with a page marked first, and only once")
        if s is None:
            s = streams[serial] = Stream(serial)
        if sequence != s.pages or s.ended or bool(flags & CONTINUED) != (serial in open_packet):
            raise ValueError(f"page {sequence} of stream {serial} does not follow")
        packet = open_packet.pop(serial, bytearray())
        body, size, before = at + 27 + n, 0, len(s.packets)
        for value in lacing:
            size += value
            if value < 255:
                packet += data[body : body + size]
                s.packets.append(bytes(packet))
                s.granules.append(None)
                body, size, packet = body + size, 0, bytearray()
        if n and lacing[-1] == 255:
            packet += data[body : body + size]
            open_packet[serial] = packet
        if len(s.packets) > before:
            s.granules[-1] = granule
        s.pages += 1
        s.ended = bool(flags & LAST)
        at = end
    if open_packet or not all(s.ended for s in streams.values()):
        raise ValueError("a stream is not complete")
    return streams


def encode(payload: bytes, unit: int = UNIT, rate: int = RATE) -> bytes:
    """The payload as packets of `unit` samples, dealt alternately to two logical streams whose pages are interleaved."""
    packets = [payload[k : k + unit] for k in range(0, len(payload), unit)]
    made = []
    for lane, serial in enumerate(SERIALS):
        head = PCM_HEADER.pack(PCM_MAGIC, 0, 0, PCM_U8, rate, 8, 1, unit, 0)
        own = packets[lane::2]
        # granule: samples of the whole programme up to this packet's end
        ends = [min((2 * k + lane + 1) * unit, len(payload)) for k in range(len(own))]
        made.append(list(stream_pages(serial, [head, *own], [0, *ends])))
    out = []
    for k in range(max(map(len, made))):
        out += [pages[k] for pages in made if k < len(pages)]
    return b"".join(out)


def timestamps(stream: Stream, rate: int = RATE, unit: int = UNIT) -> list[float]:
    """End time in seconds of each data packet: given where a granule position is, counted back from the next one elsewhere.

    Packets of this mapping alternate with the other stream's, so each stands two packets before the next of its stream; `unit` is the size of a packet, as the header states it.
    """
    ends: list[int] = [0] * len(stream.packets)
    known: int | None = None
    for k in range(len(stream.packets) - 1, 0, -1):
        if stream.granules[k] is not None:
            known = stream.granules[k]
        elif known is not None:
            # the packet after this one and the other lane's packet between them
            known = known - len(stream.packets[k + 1]) - unit
        ends[k] = known if known is not None else 0
    return [e / rate for e in ends]


def decode(data: bytes) -> tuple[bytes, dict[str, object]]:
    """The payload, in the order of the derived timestamps, and what the container says."""
    streams = read_pages(data)
    parts: list[tuple[float, int, bytes]] = []
    rate = RATE
    for s in streams.values():
        magic, _, _, kind, rate, bits, _, unit, _ = PCM_HEADER.unpack(s.packets[0])
        if magic != PCM_MAGIC or kind != PCM_U8 or bits != 8 or not unit:
            raise ValueError("not a stream of 8-bit samples")
        if any(len(p) != unit for p in s.packets[1:-1]) or len(s.packets[-1]) > unit and len(s.packets) > 1:
            raise ValueError("packets are not of the size that the header states")
        parts += [(t, s.serial, p) for t, p in zip(timestamps(s, rate, unit)[1:], s.packets[1:])]
    parts.sort(key=lambda x: x[:2])
    payload = b"".join(p for _, _, p in parts)
    return payload, {"streams": len(streams), "pages": sum(s.pages for s in streams.values()), "packets": len(parts), "seconds": parts[-1][0] if parts else 0.0}


def padded(text: str | None, unit: int = UNIT) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\xff" * (unit - len(raw) % unit if len(raw) % unit or not raw else 0), len(raw)


MEDIA = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as an Ogg file in a binary column."""
    bounded_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _bounded(b):
                done = [padded(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([n for _, n in done], pa.int64()), pa.array([encode(p) for p, _ in done], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, MEDIA)


def _bounded(batch: pa.RecordBatch, rows: int = 64) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def probe(media: DataFrame, column: str = "media") -> DataFrame:
    """All columns of `media`, and what its files hold: payload, streams, pages, packets, seconds, error (columns of these names are replaced)."""
    bounded_batches(media.sparkSession)
    names = ["payload", "streams", "pages", "packets", "seconds", "error"]
    rest = media.drop(*[n for n in names if n in media.columns and n != column])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _bounded(b):
                rows: list[tuple] = []
                for data in part.column(column).to_pylist():
                    if data is None:
                        rows.append((None,) * 6)
                        continue
                    try:
                        payload, said = decode(data)
                        rows.append((payload, said["streams"], said["pages"], said["packets"], said["seconds"], None))
                    except (ValueError, struct.error, IndexError) as e:
                        rows.append((None, None, None, None, None, str(e)))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string()]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(cols, kinds)]], [*part.schema.names, *names])

    schema = plus(rest, payload="binary", streams="integer", pages="integer", packets="integer", seconds="double", error="string")
    return rest.mapInArrow(read, schema)


def features(payload: bytes) -> str:
    """Mean, zero crossings about 128, and the range of the samples."""
    import numpy as np

    x = np.frombuffer(payload, np.uint8)
    if not len(x):
        return "empty"
    signs = x >= 128
    return f"mean={x.mean():.4f};crossings={int((signs[1:] != signs[:-1]).sum())};min={x.min()};max={x.max()}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digest(probed: DataFrame) -> DataFrame:
    """Digests of rows of `probe(to_media(...))`: of the payload as read back and of the stored form. An unreadable file gives a row without payload, its error as the feature."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                p, m = r["payload"], r["media"]
                if p is None:
                    stored = (None, None) if m is None else (len(m), hashlib.sha256(m).hexdigest())
                    out.append((r["doc_id"], r["n_bytes"], None, None, None, *stored, None if r["error"] is None else f"error={r['error']}"))
                    continue
                shape = f"streams={r['streams']};pages={r['pages']};packets={r['packets']};seconds={r['seconds']:.4f};{features(p)}"
                out.append((r["doc_id"], r["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), shape))
            cols = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [x.split()[0] for x in DIGEST.split(", ")])

    return probed.select("doc_id", "n_bytes", "media", "payload", "streams", "pages", "packets", "seconds", "error").mapInArrow(digest, DIGEST)
