"""ISO base media files in a column: building, storing, and reading their sample tables without decoding payloads.

Samples of every track are read, those of sample tables (stsz, or stz2 with sizes of 4, 8 or 16 bits) first and then those of movie
fragments (trun).  Edit lists aren't read.  Counts in a file are checked against the bytes there are before anything
is made of them; a file whose tables can't be right is ``Malformed``, which makes one row that says so and stops no job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_schema, id_text, slices, work_path

#: Bytes of a sample, samples of a chunk, samples from one keyframe to the next, and samples' bytes a second.
FRAME, PER_CHUNK, KEY_EVERY, RATE = 192, 32, 16, 8000
#: Boxes whose content is boxes.
NESTED = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"})

STORED = "doc_id long, n_bytes long, media binary"
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes long, first_keyframe string, last_keyframe string, track long, keyframe_starts array<long>, keyframe_lengths array<long>"


#: Boxes within boxes.
DEEPEST = 16


class Malformed(ValueError):
    """What a file's boxes say can't be."""


def box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *content: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *content)


_UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def build(payload: bytes) -> bytes:
    """A file of one track of 8-bit samples; ``payload`` has a multiple of FRAME bytes, each FRAME of them one sample."""
    n = len(payload) // FRAME
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16))
    sizes = full(b"stsz", struct.pack(">II", FRAME, n))
    times = full(b"stts", struct.pack(">III", 1, n, FRAME))
    whole, rest = divmod(n, PER_CHUNK)
    runs = [(1, PER_CHUNK)] * bool(whole) + [(whole + 1, rest)] * bool(rest)
    chunks = full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", first, k, 1) for first, k in runs))
    keys = range(1, n + 1, KEY_EVERY)
    sync = full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys))

    def moov(start: int) -> bytes:
        at = [start + i * PER_CHUNK * FRAME for i in range(whole + bool(rest))]
        wide = bool(at) and at[-1] >= 1 << 32
        offsets = full(b"co64" if wide else b"stco", struct.pack(f">I{len(at)}{'Q' if wide else 'I'}", len(at), *at))
        table = box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), times, sync, chunks, sizes, offsets)
        url = full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))
        media = box(
            b"mdia",
            full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n * FRAME, 0x55C4, 0)),
            full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", url), table),
        )
        track = box(b"trak", full(b"tkhd", struct.pack(">IIIII8xHHHH", 0, 0, 1, 0, n * FRAME, 0, 0, 0x100, 0), _UNITY, bytes(8), flags=3), media)
        head = full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n * FRAME, 0x10000, 0x100), _UNITY, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    # the offsets' values don't change the length of moov unless they need 64 bits
    lead = len(ftyp) + len(moov(0)) + 8
    lead = len(ftyp) + len(moov(lead)) + 8
    return ftyp + moov(lead) + box(b"mdat", payload)


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    deltas: list[tuple[int, int]] = field(default_factory=list)
    sizes: list[int] | tuple[int, int] = field(default_factory=list)  # or (each, count)
    runs: list[tuple[int, int]] = field(default_factory=list)  # (first chunk, samples in it)
    offsets: list[int] = field(default_factory=list)
    sync: list[int] | None = None  # None: every sample
    fragments: list[tuple[int, int, bool]] = field(default_factory=list)  # (start, length, is a keyframe) of fragments' samples

    @property
    def tabled(self) -> int:
        return self.sizes[1] if isinstance(self.sizes, tuple) else len(self.sizes)

    @property
    def samples(self) -> int:
        return self.tabled + len(self.fragments)

    def ranges(self) -> Iterator[tuple[int, int]]:
        """Start and length in the file of every sample, in order."""
        yield from self._tabled()
        yield from ((at, n) for at, n, _ in self.fragments)

    def _tabled(self) -> Iterator[tuple[int, int]]:
        fixed = self.sizes[0] if isinstance(self.sizes, tuple) else None
        k = 0
        for i, (first, per) in enumerate(self.runs):
            last = self.runs[i + 1][0] if i + 1 < len(self.runs) else len(self.offsets) + 1
            for c in range(first, last):
                at = self.offsets[c - 1]
                for _ in range(per):
                    if k == self.tabled:
                        return
                    size = fixed if fixed is not None else self.sizes[k]
                    yield at, size
                    at += size
                    k += 1

    def keyframes(self) -> list[tuple[int, int]]:
        every = list(self._tabled())
        tabled = every if self.sync is None else [every[s - 1] for s in self.sync if 0 < s <= len(every)]
        return tabled + [(at, n) for at, n, key in self.fragments if key]


def walk(data: memoryview, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Path, first byte and end of the content of every box; a box that says more than its parent holds ends the walk."""
    end = len(data) if end is None else end
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        elif size == 0:
            size = end - at
        if size < head or at + size > end:
            return
        yield (*path, kind), at + head, at + size
        if kind in NESTED:
            if len(path) == DEEPEST:
                raise Malformed("boxes are nested too deep")
            yield from walk(data, at + head, at + size, (*path, kind))
        at += size


class _Fragments:
    """Adds the samples of moof boxes to their tracks."""

    def __init__(self, length: int):
        self.left = length  # samples that the file can still hold
        self.tracks: dict[int, Track] = {}
        self.defaults: dict[int, tuple[int, int, int]] = {}  # of a track: duration, size and flags of a sample
        self.track: Track | None = None
        self.own, self.moof, self.base, self.at = (0, 0, 0), 0, 0, 0

    def box(self, view: memoryview, kind: bytes, at: int, end: int) -> None:
        if kind == b"trex":
            number, _, *own = struct.unpack_from(">5I", view, at + 4)
            self.defaults[number] = tuple(own)
        elif kind == b"moof":
            short = struct.unpack_from(">I4s", view, at - 8) in ((end - at + 8, kind), (0, kind))
            self.moof = self.at = at - (8 if short else 16)
        elif kind == b"traf":
            self.track = None
        elif kind == b"tfhd":
            flags, number = struct.unpack_from(">II", view, at)
            self.track, at = self.tracks.get(number), at + 8
            # without a base of its own a track's data follow those of the track before, in the first one they count from moof
            self.base = self.moof if flags & 0x20000 else self.at
            if flags & 1:
                self.base, at = struct.unpack_from(">Q", view, at)[0], at + 8
            at += 4 * bool(flags & 2)
            own = list(self.defaults.get(number, (0, 0, 0)))
            for k, bit in enumerate((8, 16, 32)):
                if flags & bit:
                    own[k], at = struct.unpack_from(">I", view, at)[0], at + 4
            self.own, self.at = tuple(own), self.base
        elif kind == b"trun":
            self.run(view, at)

    def run(self, view: memoryview, at: int) -> None:
        flags, n = struct.unpack_from(">II", view, at)
        flags, at, first = flags & 0xFFFFFF, at + 8, None
        self.left -= n
        if self.left < 0:
            raise Malformed("more samples than bytes")
        if flags & 1:
            self.at, at = self.base + struct.unpack_from(">i", view, at)[0], at + 4
        if flags & 4:
            first, at = struct.unpack_from(">I", view, at)[0], at + 4
        given = [bool(flags & bit) for bit in (0x100, 0x200, 0x400, 0x800)]
        for k in range(n):
            values = iter(struct.unpack_from(f">{sum(given)}I", view, at))
            at += 4 * sum(given)
            duration, size, marks = (next(values) if g else d for g, d in zip(given[:3], self.own, strict=True))
            if k == 0 and first is not None:
                marks = first
            if self.track is not None:
                self.track.fragments.append((self.at, size, not marks & 0x10000))
                self.track.deltas.append((1, duration))
            self.at += size


def parse(data: bytes) -> list[Track]:
    """The tracks of a file, from its sample tables and its fragments' runs alone."""
    view, tracks, fragments = memoryview(data), [], _Fragments(len(data))
    try:
        for path, at, end in walk(view):
            if path[-1] == b"trak":
                tracks.append(Track())
            inside = view[:end]  # so that no field is read beyond its box
            if path[0] == b"moof" or path[-1] == b"trex":
                fragments.box(inside, path[-1], at, end)
            elif b"trak" in path and end - at >= 8:
                _field(tracks[-1], fragments, inside, path[-1], at)
    except struct.error as e:
        raise Malformed(f"a box is shorter than its fields: {e}") from None
    for t in tracks:
        _check(t, len(data))
    return tracks


#: Tables: integers of an entry, and their kind.
TABLES = {b"stts": (2, "I"), b"stsc": (3, "I"), b"stss": (1, "I"), b"stco": (1, "I"), b"co64": (1, "Q")}


def _field(t: Track, fragments: "_Fragments", view: memoryview, kind: bytes, at: int) -> None:
    """What one box adds to its track."""
    if kind == b"tkhd":
        fragments.tracks[struct.unpack_from(">I", view, at + (20 if view[at] else 12))[0]] = t
    elif kind == b"mdhd":
        t.timescale, t.duration = struct.unpack_from(">IQ" if view[at] else ">II", view, at + (20 if view[at] else 12))
    elif kind == b"hdlr":
        t.handler = bytes(view[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd":
        t.codec = bytes(view[at + 12 : at + 16]).decode("latin-1")
    elif kind in TABLES:
        n, (width, letter) = struct.unpack_from(">I", view, at + 4)[0], TABLES[kind]
        if n * width * struct.calcsize(f">{letter}") > len(view) - at - 8:
            raise Malformed(f"{kind.decode()} has fewer entries than it says")
        flat = struct.unpack_from(f">{n * width}{letter}", view, at + 8)
        if kind == b"stts":
            t.deltas = list(zip(flat[::2], flat[1::2], strict=True))
        elif kind == b"stsc":
            t.runs = list(zip(flat[::3], flat[1::3], strict=True))
        elif kind == b"stss":
            t.sync = list(flat)
        else:
            t.offsets = list(flat)
    elif kind == b"stsz":
        each, n = struct.unpack_from(">II", view, at + 4)
        if not each and 4 * n > len(view) - at - 12:
            raise Malformed("stsz has fewer entries than it says")
        t.sizes = (each, n) if each else list(struct.unpack_from(f">{n}I", view, at + 12))
    elif kind == b"stz2":
        bits, n = view[at + 7], struct.unpack_from(">I", view, at + 8)[0]
        if bits not in (4, 8, 16) or (n * bits + 7) // 8 > len(view) - at - 12:
            raise Malformed("stz2 has fewer entries than it says, or of no known width")
        if bits == 4:  # the first of two in the high half
            t.sizes = [x for b in view[at + 12 : at + 12 + (n + 1) // 2] for x in (b >> 4, b & 15)][:n]
        else:
            t.sizes = list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", view, at + 12))


def _check(t: Track, length: int) -> None:
    """Whether a file of ``length`` bytes can hold the samples that a track's tables list."""
    if t.tabled > length:
        raise Malformed("more samples than bytes")
    firsts = [first for first, _ in t.runs]
    if t.tabled and (not firsts or firsts[0] != 1 or firsts[-1] > len(t.offsets) or any(a >= b for a, b in zip(firsts, firsts[1:]))):
        raise Malformed("chunks don't ascend from 1 to their count")
    count = total = 0
    for at, n in t.ranges():
        count, total = count + 1, total + n
        if at + n > length or total > length:
            raise Malformed("samples reach beyond the file")
    if count < t.samples:
        raise Malformed("chunks hold fewer samples than there are sizes")


def padded(text: str | None) -> tuple[bytes, int]:
    data = (text or "").encode("utf-8", "replace")
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data)), len(data)


def store(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write each text's payload as a media file into the binary column of a Parquet table: doc_id, n_bytes, media.

    A null or empty text is one sample of spaces.  Rows that repeat are stored as often, a null id stays null,
    other columns are ignored, an empty table gives an empty one.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(STORED)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 256):
                made = [padded(t) for t in texts[at : at + 256].to_pylist()]
                yield pa.RecordBatch.from_arrays([ids[at : at + 256], pa.array([n for _, n in made], pa.int64()), pa.array([build(p) for p, _ in made], pa.binary())], schema=schema)

    id_text(docs, id_col, text_col).mapInArrow(task, STORED).write.option("compression", "zstd").parquet(path)


def describe(media: bytes, track: Track | None = None) -> dict:
    """What a track of a file holds, its first one if none is given: codec, keyframes, and its samples' bytes as they lie in the file."""
    t = track or next(iter(parse(media)), None)
    if t is None:
        return {"payload": b"", "codec": None, "duration": None, "keys": [], "feature": ""}
    payload, keys = b"".join([media[at : at + n] for at, n in merged(t.ranges())]), t.keyframes()
    seconds = sum(n * d for n, d in t.deltas) / t.timescale if t.timescale else 0.0
    ranges = hashlib.sha256(",".join(f"{at}+{n}" for at, n in keys).encode()).hexdigest()[:16]
    return {"payload": payload, "codec": t.codec.strip(), "duration": seconds, "keys": keys, "feature": f"{t.codec.strip()}/{t.handler}/{t.timescale};samples={t.samples};seconds={seconds:.3f};keys={len(keys)}:{ranges}"}


def merged(ranges: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Neighbouring ranges as one."""
    first = end = None
    for at, n in ranges:
        if at != end:
            if first is not None:
                yield first, end - first
            first = at
        end = at + n
    if first is not None:
        yield first, end - first


def read(spark: SparkSession, path: str) -> DataFrame:
    """Features of a stored table's files, a row for each track; codec, duration and keyframes' byte ranges come from the boxes alone.

    ``track`` counts from 0, and payload_bytes to keyframe_lengths are that track's.  keyframe_starts and keyframe_lengths are
    the ranges of all keyframes in the file, in the order of samples.  A file without a track is one row, its track null; so is a
malformed one, whose feature says why and whose payload is empty.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(READ)
        for batch in slices(batches):
            rows = []
            for doc, n, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                media = media or b""
                try:
                    tracks = parse(media) or [None]
                except Malformed as e:
                    rows.append((doc, n, 0, hashlib.sha256(b"").hexdigest(), 0, len(media), hashlib.sha256(media).hexdigest(), f"malformed: {e}", None, None, 0, None, None, None, [], []))
                    continue
                whole = hashlib.sha256(media).hexdigest()
                for k, t in enumerate(tracks):
                    d = describe(media, t)
                    p, keys = d["payload"], [f"{at}+{size}" for at, size in d["keys"]]
                    starts, lengths = [at for at, _ in d["keys"]], [size for _, size in d["keys"]]
                    rows.append((doc, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(media), whole, d["feature"], d["codec"], d["duration"], len(keys), keys[0] if keys else None, keys[-1] if keys else None, None if t is None else k, starts, lengths))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return spark.read.schema(STORED).parquet(path).mapInArrow(task, READ)


def media_features(docs: DataFrame) -> DataFrame:
    path = work_path(docs.sparkSession, "media")
    store(docs, path)
    return read(docs.sparkSession, path)
