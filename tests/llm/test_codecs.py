"""Tokenisers, token files, media and packing: exact round trips."""

import collections
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings, strategies as st

from vellum.llm import media, packing, piece_codec, token_binary, vocab

from . import odd

TEXT = st.text(alphabet=st.sampled_from(list("ab Zé\n\t .,!'s1\x1c\xa0\x00\x01　字😀")), max_size=40)
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocab.byte_bpe())


def reference(tokenizer, texts):
    return [np.array(x.ids, "<u4").tobytes() for x in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=20))
def test_cached_ids_are_the_library_s(texts):
    assert vocab.encoder(vocab.byte_bpe()).ids(texts) == reference(tokenizers.Tokenizer.from_file(vocab.byte_bpe()), texts)


def test_added_tokens_are_the_file_s():
    fresh = tokenizers.Tokenizer.from_file(vocab.byte_bpe())
    mark = "<|endoftext|>"
    texts = [f"a {mark} it's", mark, mark * 3, f"a{mark}b {mark}c\n{mark}\nd", f" {mark}  {mark}\t\n x  {mark} ", f"{mark} \u3000{mark}\xa0y", f"\1{mark} z", "<|endof text|>", "plain"]
    texts += [r[1] for r in odd.rows(4)]
    got = vocab.Encoder(vocab.byte_bpe()).ids(texts)
    assert got == reference(fresh, texts) and np.frombuffer(got[0], "<u4").tolist() == [64, 220, 50256, 340, 338]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|", "|>", " ", "\n", "\t", "\x01", "\u3000", "a", "'s", "1"]), max_size=12).map("".join), max_size=8))
def test_added_tokens_among_white_space(texts):
    assert vocab.encoder(vocab.byte_bpe()).ids(texts) == reference(tokenizers.Tokenizer.from_file(vocab.byte_bpe()), texts)


def test_cache_turns_over(monkeypatch, library):
    monkeypatch.setattr(vocab, "CACHE", 20)
    monkeypatch.setattr(vocab, "PORTION", 100)
    texts = [r[1] for r in odd.rows(4)]
    assert vocab.Encoder(vocab.byte_bpe()).ids(texts) == reference(library, texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 9), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=300))
def test_simple8b(ids):
    words = token_binary.encode(np.array(ids, np.uint64))
    assert token_binary.decode(words).tolist() == ids


def test_restart_points():
    ids = np.arange(40_000) % 3000
    words, offsets = token_binary.block_words(ids)
    for k, at in enumerate(offsets):
        assert token_binary.decode(words[at:])[:10].tolist() == ids[k * token_binary.RESTART :][:10].tolist()
    for start, n in ((0, 0), (0, 40_000), (8191, 2), (8192, 1), (30_000, 9_999)):
        assert token_binary.decode_range(words, offsets, start, n).tolist() == ids[start : start + n].tolist()


def test_token_files(spark, tmp_path, library, monkeypatch):
    monkeypatch.setattr(token_binary, "BLOCK", 500)
    data = [r for r in odd.rows(2) if r[0] is not None]
    token_binary.write(odd.clashing(odd.frame(spark, data)), str(tmp_path / "t"), vocab.byte_bpe(), 2)
    end = np.array([2], "<u4").tobytes()
    want, start = collections.Counter(), 0
    for (i, t), b in zip(sorted((r[0], r[1] or "") for r in data), reference(library, [x for _, x in sorted((r[0], r[1] or "") for r in data)]), strict=True):
        want[i, start, len(b) // 4 + 1, zlib.crc32(b + end)] += 1
        start += len(b) // 4 + 1
    got = token_binary.read(spark, str(tmp_path / "t"))
    rows = [tuple(r) for r in got.collect()]
    # rows that share an id may stand in either order; their place in the file is the same
    assert sorted(r[1] for r in rows)[0] == 0 and sorted((r[0], r[2], r[3]) for r in rows) == sorted((k[0], k[2], k[3]) for k in want.elements())
    unique = {i for i, n in collections.Counter(r[0] for r in data).items() if n == 1}
    assert {r for r in rows if r[0] in unique} == {k for k in want if k[0] in unique}
    ids = {r.doc_id: r.ids for r in token_binary.read_ids(spark, str(tmp_path / "t")).collect() if r.doc_id in unique}
    text = {r[0]: r[1] for r in data}
    assert all(v == library.encode(text[k] or "", add_special_tokens=False).ids + [2] for k, v in ids.items())
    some = sorted(unique)[5:9]
    few = {r.doc_id: r.ids for r in token_binary.read_ids(spark, str(tmp_path / "t"), some[0], some[-1]).collect() if r.doc_id in unique}
    assert few == {i: ids[i] for i in some}
    token_binary.write(odd.frame(spark, odd.rows(2)), str(tmp_path / "n"), vocab.byte_bpe(), 2)
    nulls = [tuple(r) for r in token_binary.read(spark, str(tmp_path / "n")).collect()]
    assert len(nulls) == len(odd.rows(2)) and {r[1] for r in nulls if r[0] is None} <= set(range(200)) and sorted(r[1] for r in nulls)[0] == 0
    token_binary.write(odd.frame(spark, []), str(tmp_path / "e"), vocab.byte_bpe(), 2)
    assert token_binary.read(spark, str(tmp_path / "e")).collect() == []


def test_differencing():
    rng = random.Random(1)
    for k in (1, 2, 7):
        sizes = [rng.randint(1, 200) for _ in range(60)]
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(60)) and len(parts) == k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 8
    assert sorted(packing.balanced([600, 600, 600], 1024)) == [[0], [1], [2]]


def test_packing(spark, library):
    data = [r for r in odd.rows(5) if r[0] is not None]
    unique = {i for i, n in collections.Counter(r[0] for r in data).items() if n == 1}
    rows = packing.packed(odd.clashing(odd.frame(spark, data))).collect()
    ids = {r[0]: np.array(library.encode(r[1] or "", add_special_tokens=False).ids + [0], "<u4") for r in data if r[0] in unique}
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        if r.doc_id in unique:
            part = ids[r.doc_id][r.start : r.start + r.length]
            assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
            pieces[r.doc_id].append((r.start, r.length))
    for i, p in pieces.items():
        at = 0
        for start, n in sorted(p):
            assert start == at
            at += n
        assert at == len(ids[i])
    assert set(pieces) == unique
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    total = sum(r.length for r in rows)
    assert sum(r.doc_tokens for r in {(x.doc_id, x.doc_tokens): x for x in rows if x.doc_id in unique}.values()) <= total
    assert packing.packed(odd.frame(spark, [])).collect() == []


def test_large_pools_pad_little():
    p, rng = packing._Packer(0, 1024), random.Random(2)
    for i in range(1500):
        p.add(i, b"abcd" * int(rng.lognormvariate(6, 1) + 1))
    p.flush()
    sums = collections.Counter()
    for r in p.rows:
        sums[r[5]] += r[2]
    assert max(sums.values()) <= 1024 and sum(1024 - s for s in sums.values()) < 0.02 * sum(sums.values())


@pytest.fixture(scope="module")
def pieces():
    return piece_codec.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_pieces_are_the_library_s(pieces, text):
    own, lib = pieces
    ids = own.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text) and own.decode(ids) == lib.decode(lib.encode(text))


def test_a_long_run_is_streamed(pieces):
    own, lib = pieces
    for text in ("a" * 3000, "ab" * 1500, "=-" * 700):
        before = own.committed
        assert list(own.stream("▁" + text)) == lib.encode(text)
        assert own.committed - before > len(text) / (4 * own.longest)


def test_ids_come_before_the_text_ends(pieces, monkeypatch):
    own, lib = pieces
    monkeypatch.setattr(piece_codec, "PART", 50)
    text = "the words of  this\ntext go on, " * 40 + "x" * 400 + " and end"
    read, out = [], []

    def parts():
        yield " "
        for at in range(0, len(text), 50):
            read.append(at)
            yield text[at : at + 50]

    for ids in own.commits(parts()):
        out.append((len(read) * 50, len(ids) // 4))
    got = np.frombuffer(own.encode(text), "<u4").tolist()
    assert got == lib.encode(text) and sum(n for _, n in out) == len(got)
    assert sum(n for at, n in out if at < len(text) / 2) > len(got) / 3


def test_piece_table(spark):
    got = piece_codec.round_trip(odd.clashing(odd.frame(spark))).collect()
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = sorted((str(r[0]), len(lib.encode(r[1] or "")), hashlib.sha256(lib.decode(lib.encode(r[1] or "")).encode()).hexdigest()) for r in odd.rows())
    assert sorted((str(r.doc_id), r.n_ids, r.decoded_sha256) for r in got) == want
    assert piece_codec.round_trip(odd.frame(spark, [])).collect() == []


def test_media(spark, tmp_path):
    media.store(odd.clashing(odd.frame(spark)), str(tmp_path / "m"))
    got = sorted(((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.read(spark, str(tmp_path / "m")).collect()))
    want = []
    for i, t, *_ in odd.rows():
        b = (t or "").encode()
        p = b + b" " * (max(1, -(-len(b) // 192)) * 192 - len(b))
        want.append((str(i), len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])))
    assert got == sorted(want)
    media.store(odd.frame(spark, []), str(tmp_path / "e"))
    assert media.read(spark, str(tmp_path / "e")).collect() == []


def test_boxes():
    payload = bytes(range(192)) * 70
    data = media.build(payload)
    (t,) = media.parse(data)
    assert (t.codec, t.handler, t.timescale, t.duration, t.samples) == ("raw ", "soun", 8000, len(payload), 70)
    assert b"".join(data[a : a + n] for a, n in t.ranges()) == payload
    assert t.keyframes() == [list(t.ranges())[k] for k in range(0, 70, media.KEY_EVERY)]
    # other files: a 64-bit size, samples of their own sizes, a box that is cut off
    stsz = media.full(b"stsz", struct.pack(">IIII", 0, 2, 3, 5))
    stbl = media.box(b"stbl", stsz, media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"co64", struct.pack(">IQ", 1, 9)))
    wide = struct.pack(">I4sQ", 1, b"moov", 16 + len(media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))) + media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl)))
    (t,) = media.parse(wide)
    assert list(t.ranges()) == [(9, 3), (12, 5)] == t.keyframes()
    assert media.parse(data[:40]) == [] and media.describe(b"")["payload"] == b""


@pytest.mark.parametrize("bits, body", [(4, bytes([0x35])), (8, bytes([3, 5])), (16, bytes([0, 3, 0, 5]))])
def test_compact_sizes(bits, body):
    def track(n):
        stbl = media.box(b"stbl", media.full(b"stz2", bytes([0, 0, 0, bits]) + struct.pack(">I", n) + body), media.full(b"stsc", struct.pack(">IIII", 1, 1, 2, 1)), media.full(b"co64", struct.pack(">IQ", 1, 9)))
        return media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", stbl))))

    (t,) = media.parse(track(2))
    assert list(t.ranges()) == [(9, 3), (12, 5)]
    with pytest.raises(media.Malformed):
        media.parse(track(9))


def two_tracks(first, second):
    """A file of the tracks of two built ones, whose data lie in the same order."""
    boxes = []
    for payload in (first, second):
        data = media.build(payload)
        found = {path: (at, end) for path, at, end in media.walk(memoryview(data))}
        at, end = found[b"moov", b"trak"]
        boxes.append((bytearray(data[at - 8 : end]), found[(b"mdat",)][0]))
    lead = 8 + sum(len(b) for b, _ in boxes) + 8
    for (b, start), to in zip(boxes, (lead, lead + len(first)), strict=True):
        at = bytes(b).index(b"stco") + 8
        n = struct.unpack_from(">I", b, at)[0]
        struct.pack_into(f">{n}I", b, at + 4, *(x - start + to for x in struct.unpack_from(f">{n}I", b, at + 4)))
    return media.box(b"moov", *(bytes(b) for b, _ in boxes)) + media.box(b"mdat", first, second)


def fragmented():
    """Two tracks without tables, and two fragments; also each track's ranges and keyframes."""

    def trak(number):
        hdlr = media.full(b"hdlr", bytes(4), b"vide", bytes(12))
        mdhd = media.full(b"mdhd", struct.pack(">IIIIHH", 0, 0, 10, 0, 0, 0))
        stsd = media.full(b"stsd", struct.pack(">I", 1), media.box(b"raw ", bytes(8)))
        return media.box(b"trak", media.full(b"tkhd", struct.pack(">III", 0, 0, number)), media.box(b"mdia", mdhd, hdlr, media.box(b"minf", media.box(b"stbl", stsd))))

    trex = [media.full(b"trex", struct.pack(">5I", k, 1, 5, 4, 0x10000)) for k in (1, 2)]
    moov = media.box(b"moov", trak(1), trak(2), media.box(b"mvex", *trex))

    def moof(offset):
        # track 1: a run with sizes and first flags, and right after it one with a duration and flags
        one = media.box(
            b"traf", media.full(b"tfhd", struct.pack(">I", 1), flags=0x20000),
            media.full(b"trun", struct.pack(">IiI3I", 3, offset, 0, 3, 4, 5), flags=0x205),
            media.full(b"trun", struct.pack(">3I", 1, 7, 0x10000), flags=0x500),
        )
        # track 2: sizes, durations and flags of tfhd, data after those of track 1
        two = media.box(b"traf", media.full(b"tfhd", struct.pack(">4I", 2, 8, 6, 0), flags=0x38), media.full(b"trun", struct.pack(">I", 2)))
        return media.box(b"moof", media.full(b"mfhd", struct.pack(">I", 1)), one, two)

    n = len(moof(0))
    part = moof(n + 8) + media.box(b"mdat", bytes(range(1, 29)))
    data, want = moov + part + part, ([], [], [], [])
    for start in (len(moov) + n + 8, len(moov) + len(part) + n + 8):
        want[0].extend([(start, 3), (start + 3, 4), (start + 7, 5), (start + 12, 4)])
        want[1].append((start, 3))
        want[2].extend([(start + 16, 6), (start + 22, 6)])
        want[3].extend([(start + 16, 6), (start + 22, 6)])
    return data, want


def test_fragments():
    data, want = fragmented()
    one, two = media.parse(data)
    assert (list(one.ranges()), one.keyframes(), list(two.ranges()), two.keyframes()) == want
    assert (one.samples, two.samples, one.deltas, two.deltas) == (8, 4, ([(1, 5)] * 3 + [(1, 7)]) * 2, [(1, 8)] * 4)
    assert media.describe(data, one)["payload"] == bytes(range(1, 17)) * 2 and media.describe(data, two)["payload"] == bytes(range(17, 29)) * 2


def test_all_keyframes_and_tracks(spark, tmp_path):
    text = "many keyframes " * 700
    media.store(odd.frame(spark, [(1, text, None, None, None)]), str(tmp_path / "m"))
    (stored,) = spark.read.parquet(str(tmp_path / "m")).collect()
    (got,) = media.read(spark, str(tmp_path / "m")).collect()
    payload, start = media.padded(text)[0], len(stored.media) - len(media.padded(text)[0])
    at = list(range(start, start + len(payload), 192 * media.KEY_EVERY))
    assert len(at) == 4 and (got.track, got.keyframe_starts, got.keyframe_lengths, got.keyframes) == (0, at, [192] * 4, 4)
    first, second = bytes(range(192)) * 40, bytes(range(191, -1, -1)) * 20
    files = [(7, 0, bytearray(two_tracks(first, second))), (8, 0, bytearray(fragmented()[0])), (9, 0, bytearray(b"no media"))]
    spark.createDataFrame(files, media.STORED).write.parquet(str(tmp_path / "t"))
    rows = {(r.doc_id, r.track): r for r in media.read(spark, str(tmp_path / "t")).collect()}
    assert set(rows) == {(7, 0), (7, 1), (8, 0), (8, 1), (9, None)}
    for k, part in enumerate((first, second)):
        assert rows[7, k].payload_sha256 == hashlib.sha256(part).hexdigest() and rows[7, k].keyframes == len(rows[7, k].keyframe_starts) == -(-len(part) // 3072)
    assert list(zip(rows[8, 1].keyframe_starts, rows[8, 1].keyframe_lengths, strict=True)) == fragmented()[1][3] and rows[9, None].keyframe_starts == []


def test_malformed_files_are_rows(spark, tmp_path):
    data = media.build(bytes(range(192)) * 40)
    at = {k: data.index(k) + 4 for k in (b"stts", b"stsc", b"stsz", b"stco", b"stss")}
    broken = {}
    for k, where in at.items():
        b = bytearray(data)
        struct.pack_into(">I", b, where + (8 if k == b"stsz" else 4), 0xFFFFFFF0)
        broken[k.decode()] = bytes(b)
    for name, where, value in (("chunk 0", at[b"stsc"] + 8, 0), ("chunk 9", at[b"stsc"] + 20, 9), ("offset", at[b"stco"] + 8, 1 << 30), ("size", at[b"stsz"] + 4, 1 << 30)):
        b = bytearray(data)
        struct.pack_into(">I", b, where, value)
        broken[name] = bytes(b)
    deep = b""
    for _ in range(500):
        deep = media.box(b"moov", deep)
    broken["deep"] = deep
    rows = [(i, 1, b) for i, b in enumerate([data, None, b"", *broken.values()])]
    spark.createDataFrame(rows, media.STORED).write.parquet(str(tmp_path / "m"))
    got = {r.doc_id: r for r in media.read(spark, str(tmp_path / "m")).collect()}
    assert len(got) == len(rows) and got[0].keyframes == 3 and got[0].payload_bytes == 7680 and got[1].track is None and got[1].payload_bytes == 0
    assert all(got[k + 3].feature.startswith("malformed: ") and got[k + 3].payload_bytes == 0 for k in range(len(broken))), broken.keys()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 1), st.lists(st.tuples(st.integers(0, 2000), st.integers(0, 255)), max_size=6), st.integers(0, 4000))
def test_any_bytes_are_read_or_malformed(which, changes, cut):
    data = bytearray((media.build(bytes(192 * 3)), fragmented()[0])[which])
    for at, value in changes:
        data[at % len(data)] = value
    data = bytes(data[: cut or None])
    try:
        tracks = media.parse(data)
    except media.Malformed:
        return
    for t in tracks:
        assert len(media.describe(data, t)["payload"]) <= len(data)


def test_features_follow_texts(spark):
    rows = {}
    for r in media.media_features(odd.frame(spark)).collect():
        rows.setdefault(r.payload_sha256, set()).add((r.feature, r.media_sha256, r.media_bytes, r.tail_crc32))
    texts = {hashlib.sha256(media.padded(r[1])[0]).hexdigest(): media.build(media.padded(r[1])[0]) for r in odd.rows()}
    assert rows.keys() == texts.keys()
    for sha, found in rows.items():
        ((feature, media_sha, n, _),) = found
        assert media_sha == hashlib.sha256(texts[sha]).hexdigest() and n == len(texts[sha]) and feature.startswith("raw/soun/8000;samples=")


def test_runs_parsed_together_are_the_streamed_ones(monkeypatch):

    texts = [t for _, t, *_ in odd.rows()] + ["aa aab aaba ab " * 30, "née naïve 😀😀 ▁▁ x", "\x00\x01 zz\x02", "y" * 70 + " " + "y" * 71]
    monkeypatch.setattr(piece_codec, "CACHE", 40)
    monkeypatch.setattr(piece_codec, "TOGETHER", 600)
    many, one = (piece_codec.Pieces(public_tokenizers.path("piece_bpe_32k.model")) for _ in range(2))
    assert many.encode_many(texts) == [one.encode(t) for t in texts]
    assert many.encode_many([]) == []
