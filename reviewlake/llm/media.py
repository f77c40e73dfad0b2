"""Media columns: ISO media containers, written and read without decoding what they hold.

A file is a tree of boxes (size, kind, body). The track's sample tables say where each sample lies (stco or co64,
stsc, stsz or stz2), how long it lasts (stts) and which samples are keyframes (stss); fragments (moof) say the same of
theirs (tfhd, trun, with the defaults of trex). So codec, duration and keyframe byte ranges come from the tables alone.

Boxes are walked without recursion and to a depth of MAX_DEPTH; a count that its table cannot hold, a sample beyond the
end of the file and a keyframe that is no sample make a container broken, before anything of that size is built.

Cases: a null text is empty; an empty text is stored as one frame of spaces; a null or broken container gives null
features; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import id_and_text, text_bytes

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
CHUNK = 16  # samples in a chunk
GROUP = 12  # every so many samples, a keyframe
TIMESCALE, TICKS = 25_000, 1_000
#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"}
#: Deepest nesting that is read.
MAX_DEPTH = 32


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def padded(data: bytes) -> bytes:
    """Spaces up to a positive multiple of one frame."""
    return data + b" " * (-len(data) % FRAME if data else FRAME)


def write_container(payload: bytes) -> bytes:
    """One video track of uncompressed 8-bit grey frames that hold the payload, FRAME bytes each."""
    n = len(payload) // FRAME
    chunks = -(-n // CHUNK)
    head = box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isom", b"mp41")
    media = box(b"mdat", payload)
    start = len(head) + len(media) - len(payload)
    u32 = lambda *x: struct.pack(f">{len(x)}I", *x)
    matrix = u32(0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HH", WIDTH, HEIGHT), u32(0x480000, 0x480000, 0), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 40, -1))
    runs = [(1, CHUNK)] * (n >= CHUNK) + [(chunks, n % CHUNK)] * bool(n % CHUNK)
    offsets = [start + i * CHUNK * FRAME for i in range(chunks)]
    wide = bool(offsets) and offsets[-1] >= 1 << 32
    keys = range(1, n + 1, GROUP)
    tables = box(
        b"stbl",
        full_box(b"stsd", u32(1), entry),
        full_box(b"stts", u32(1, n, TICKS)),
        full_box(b"stss", u32(len(keys), *keys)),
        full_box(b"stsc", u32(len(runs)), *(u32(first, count, 1) for first, count in runs)),
        full_box(b"stsz", u32(FRAME, n)),
        full_box(b"co64", u32(chunks), struct.pack(f">{chunks}Q", *offsets)) if wide else full_box(b"stco", u32(chunks, *offsets)),
    )
    track = box(
        b"trak",
        full_box(b"tkhd", u32(0, 0, 1, 0, n * TICKS), bytes(16), matrix, u32(WIDTH << 16, HEIGHT << 16), flags=7),
        box(
            b"mdia",
            full_box(b"mdhd", u32(0, 0, TIMESCALE, n * TICKS), struct.pack(">HH", 0x55C4, 0)),
            full_box(b"hdlr", u32(0), b"vide", bytes(12), b"payload\0"),
            box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", u32(1), full_box(b"url ", flags=1))), tables),
        ),
    )
    movie = full_box(b"mvhd", u32(0, 0, TIMESCALE, n * TICKS, 0x10000), struct.pack(">H", 0x100), bytes(10), matrix, bytes(24), u32(2))
    return head + media + box(b"moov", movie, track)


def walk(data: bytes) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, start and end of the body) of every box, nested ones after the box that holds them."""
    open_: list[tuple[int, int, tuple]] = [(0, len(data), ())]
    while open_:
        at, end, path = open_.pop()
        if at + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        stop = end if size == 0 else at + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {at} reaches beyond what holds it")
        yield (*path, kind), body, stop
        open_.append((stop, end, path))
        if kind in CONTAINERS:
            if len(path) >= MAX_DEPTH:
                raise ValueError("boxes nested too deep")
            open_.append((body, stop, (*path, kind)))


class Body:
    """Numbers of one box's body, which end where the box ends."""

    def __init__(self, data: bytes, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def take(self, code: str, n: int = 1) -> tuple:
        form = f">{int(n)}{code}"
        if n < 0 or self.at + n * struct.calcsize(f">{code}") > self.end:
            raise ValueError("a table is longer than its box")
        self.at += struct.calcsize(form)
        return struct.unpack_from(form, self.data, self.at - struct.calcsize(form))

    def one(self, code: str = "I") -> int:
        return self.take(code)[0]

    def rows(self, width: int) -> list[tuple]:
        flat = self.take("I", self.one() * width)
        return list(zip(*(flat[i::width] for i in range(width)), strict=True))


def sample_sizes(data: bytes, found: dict[bytes, tuple[int, int]]) -> list[int]:
    """By stsz or stz2. Samples of one size may not be more than the file could hold."""
    if b"stsz" in found:
        b = Body(data, *found[b"stsz"])
        _, same, n = b.take("I", 3)
        if same:
            if n * same > len(data):
                raise ValueError("more samples than the file holds")
            return [same] * n
        return list(b.take("I", n))
    b = Body(data, *found[b"stz2"])
    _, field, n = b.take("I", 3)
    if field == 4:
        return [x for y in b.take("B", (n + 1) // 2) for x in (y >> 4, y & 15)][:n]
    return list(b.take({8: "B", 16: "H"}[field], n))


def sample_places(data: bytes, found: dict[bytes, tuple[int, int]], sizes: list[int]) -> list[tuple[int, int]]:
    b = Body(data, *found[b"co64" if b"co64" in found else b"stco"])
    _, n = b.take("I", 2)
    offsets = b.take("Q" if b"co64" in found else "I", n)
    b = Body(data, *found[b"stsc"])
    b.one()
    runs = b.rows(3)
    places: list[tuple[int, int]] = []
    for i, (first, count, _) in enumerate(runs):
        last = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(offsets)
        if not 1 <= first <= last + 1 <= len(offsets) + 1:
            raise ValueError("chunks out of order")
        for chunk in range(first - 1, last):
            place = offsets[chunk]
            for size in sizes[len(places) : len(places) + count]:
                places.append((place, size))
                place += size
    return places


def fragment_samples(data: bytes, boxes: list[tuple[tuple, int, int]], track: int, defaults: tuple[int, int, int]) -> tuple[list, list, int]:
    """Places, numbers of keyframes and ticks of a track's samples in movie fragments. defaults: duration, size, flags by trex."""
    places, keys, ticks = [], [], 0
    moof = base = place = own = 0
    duration, size, flags = defaults
    for path, start, end in boxes:
        b = Body(data, start, end)
        if path == (b"moof",):
            moof = start - 8
        elif path == (b"moof", b"traf", b"tfhd"):
            said = b.one()
            own = b.one() == track
            base = b.one("Q") if said & 1 else moof
            b.take("I", bool(said & 2))
            duration, size, flags = ((b.one() if said & bit else d) for bit, d in zip((8, 16, 32), defaults, strict=True))
            place = base
        elif path == (b"moof", b"traf", b"trun") and own:
            said, n = b.take("I", 2)
            place = base + b.one("i") if said & 1 else place
            first = b.one() if said & 4 else None
            width = sum(bool(said & bit) for bit in (0x100, 0x200, 0x400, 0x800))
            if not width and n * max(1, size) > len(data):
                raise ValueError("more samples than the file holds")
            values = iter(b.take("I", n * width))
            for k in range(n):
                lasts = next(values) if said & 0x100 else duration
                length = next(values) if said & 0x200 else size
                how = next(values) if said & 0x400 else first if first is not None and k == 0 else flags
                if said & 0x800:
                    next(values)
                if not how >> 16 & 1:  # not marked as depending on others
                    keys.append(len(places))
                places.append((place, length))
                place += length
                ticks += lasts
    return places, keys, ticks


def read_tables(data: bytes) -> dict:
    """Codec, size, duration and sample places of the first track that has a sample table, fragments included."""
    boxes = list(walk(data))
    found: dict[bytes, tuple[int, int]] = {}
    for path, start, end in boxes:
        if path[-1] == b"trak" and (b"stsz" in found or b"stz2" in found):
            break
        if path[0] == b"moov" and path[-1] != b"trex":
            found[path[-1]] = (start, end)
    b = Body(data, *found[b"mdhd"])
    if b.one() >> 24:
        b.take("Q", 2)
        timescale, length = b.one(), b.one("Q")
    else:
        b.take("I", 2)
        timescale, length = b.take("I", 2)
    sizes = sample_sizes(data, found)
    places = sample_places(data, found, sizes)
    keys: list[int] = list(range(len(places)))
    if b"stss" in found:
        b = Body(data, *found[b"stss"])
        b.one()
        keys = [x - 1 for (x,) in b.rows(1)]
    b = Body(data, *found[b"stts"])
    b.one()
    ticks = sum(n * lasts for n, lasts in b.rows(2))
    track = 0
    if b"tkhd" in found:
        b = Body(data, *found[b"tkhd"])
        b.take("Q" if b.one() >> 24 else "I", 2)
        track = b.one()
    trex = {}
    for path, start, end in boxes:
        if path[-1] == b"trex":
            _, number, _, *defaults = Body(data, start, end).take("I", 6)
            trex[number] = tuple(defaults)
    more, more_keys, more_ticks = fragment_samples(data, boxes, track, trex.get(track, (0, 0, 0)))
    keys += [len(places) + k for k in more_keys]
    places, ticks = places + more, ticks + more_ticks
    if any(at + n > len(data) for at, n in places) or any(not 0 <= k < len(places) for k in keys):
        raise ValueError("a sample or keyframe lies outside the file")
    b = Body(data, *found[b"stsd"])
    b.take("I", 3)
    codec = data[b.at : b.at + 4].decode("latin-1").strip()
    width = height = None
    if b"vmhd" in found:  # only a video track's entry has a size
        b.take("B", 28)
        width, height = b.take("H", 2)
    return {"codec": codec, "width": width, "height": height, "seconds": (length or ticks) / timescale, "ticks": ticks, "places": places, "keyframes": [places[x] for x in keys]}


def payload_of(data: bytes, places: list[tuple[int, int]]) -> bytes:
    """The samples' bytes in order; neighbours in the file are read as one piece."""
    parts: list[list[int]] = []
    for at, size in places:
        if parts and parts[-1][1] == at:
            parts[-1][1] += size
        else:
            parts.append([at, at + size])
    return b"".join(data[a:b] for a, b in parts)


MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
FEATURES = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, codec string, width int, height int, duration_s double, n_samples long, n_keyframes long, keyframes array<struct<start:long,size:long>>, feature string"


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text as the payload of a container. Narrow; nothing is shuffled."""

    def write(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(1).to_pylist()
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([write_container(padded(x)) for x in texts], pa.binary())], schema=MEDIA)

    return id_and_text(docs).select("doc_id", text_bytes().alias("data")).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Read containers back: table features, the payload's digests, keyframe byte ranges in the file."""

    def one(data: bytes | None) -> dict:
        if data is None:
            return {}
        out = {"media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
        try:
            t = read_tables(data)
            payload = payload_of(data, t["places"])
        except (ValueError, KeyError, IndexError, struct.error, ZeroDivisionError, OverflowError):
            return out
        keys = t["keyframes"]
        ranges = zlib.crc32(b"".join(struct.pack(">QI", *x) for x in keys))
        return out | {
            "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "codec": t["codec"], "width": t["width"], "height": t["height"],
            "duration_s": t["seconds"], "n_samples": len(t["places"]), "n_keyframes": len(keys), "keyframes": [{"start": a, "size": b} for a, b in keys],
            "feature": f"{t['codec']} {t['width']}x{t['height']} {t['seconds']:.3f}s samples={len(t['places'])} keyframes={len(keys)} ranges={ranges:08x}",
        }

    def read(batches):
        for b in batches:
            rows = [{"doc_id": d, "n_bytes": n} | one(m) for d, n, m in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_FEATURES)

    return media.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), "media").mapInArrow(read, FEATURES)


ARROW_FEATURES = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32())]
    + [("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframes", pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())]))), ("feature", pa.string())]
)
