"""SentencePiece ids by a streaming lattice, and texts from ids.

The vocabulary is of the BPE kind, so the best path is not the one of the greatest sum of scores: it is the one whose
neighbouring pieces are all stable, which means that merging their characters by score gives these two pieces again.  Every
prefix of a text then has exactly one last piece, so Viterbi's recursion has one backpointer at each place, and
a window of the longest piece's length holds all that later places can point to.  What lies before the place at which
the backpointer paths of the whole window meet can't change any more and is committed.

A text goes through the lattice as a stream of characters.  Paths meet at two kinds of places: where white space starts, as no
piece of the vocabulary goes on across such a place (tested when it is read; the window then holds one path), and
inside a longer run, where the paths of all places in the window are followed back.  What is committed between
two places where white space starts depends on the characters between them alone, so a worker remembers it: CACHE runs of up
to LONG characters are looked up instead of running the lattice again.  New runs of many texts go through it in their order, as
what a lattice holds up to some place depends on the characters before it alone: a run goes on where it parts from the one before.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, id_text

SPACE = "▁"
#: Characters of a text that are read at once.
PART = 1 << 14
#: Texts, and about their characters, whose new runs are parsed in one go.
ROWS, TOGETHER = 1024, 3 << 20
#: Runs that a worker keeps (at twice as many the older half goes), and the longest that it keeps.
CACHE, LONG = 300_000, 64
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
ENCODED = "doc_id long, n_ids long, ids binary, sha256 string"


class Pieces:
    """A vocabulary file's pieces; its own library only reads the file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.ids, self.score, self.byte, self.out = {}, {}, {}, []
        for k in range(size):
            p = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.byte[int(p[1:-1], 16)] = k
                self.out.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(k):
                self.out.append(b"")
            elif sp.is_unknown(k):
                self.out.append(" ⁇ ".encode())
            else:
                self.ids[p], self.score[p] = k, sp.get_score(k)
                self.out.append(p.replace(SPACE, " ").encode())
        self.longest = max(map(len, self.ids), default=1)
        # every end of a piece, and whether it is one itself
        self.ends = {p[k:]: False for p in self.ids for k in range(1, len(p))} | dict.fromkeys(self.ids, True)
        # all paths meet where white space starts, unless a piece goes on across such a place
        self.meet = re.compile(f"(?<=[^{SPACE}])(?={SPACE})") if not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids) else re.compile(r"(?!)")
        self.committed = 0
        self.piece = {k: p for p, k in self.ids.items()}
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.stable = lru_cache(1 << 19)(self._stable)
        self.built = lru_cache(1 << 16)(self._built)
        self.encoded = lru_cache(1 << 16)(lambda piece: array("I", self._ids(piece)).tobytes())

    def _built(self, piece: str) -> tuple[bool, list[tuple[float, str, str]]]:
        """Whether merging a piece's characters gives it back, and each merge: its score, and the first and last part after it.

        The pair whose union scores highest merges first, the leftmost of equals.
        """
        parts, merges = list(piece), []
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            merges.append((best, parts[0], parts[-1]))
        return parts == [piece], merges

    def _stable(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives these two pieces: no union across their border may come first.

        Both are built side by side, the better merge first; the left one wins ties, as merges go from left to right.
        """
        (one, a), (two, b) = self.built(left), self.built(right)
        if not (one and two):
            return False
        x, y, i, j = left[-1], right[0], 0, 0
        while True:
            over = self.score.get(x + y)
            p, q = a[i][0] if i < len(a) else None, b[j][0] if j < len(b) else None
            if over is not None and (p is None or over > p) and (q is None or over >= q):
                return False
            if p is None and q is None:
                return True
            if q is None or (p is not None and p >= q):
                x, i = a[i][2], i + 1
            else:
                y, j = b[j][1], j + 1

    def stream(self, text: str) -> Iterator[int]:
        """Ids of characters after which paths meet, each as soon as it is certain: in a window of the longest piece's length beside what isn't committed."""
        last: dict[int, str] = {0: ""}  # the window: a place's last piece; places that are missing have none
        done, due, ids, ends, stable = 0, self.longest, self.ids, self.ends, self.stable
        for i in range(1, len(text) + 1):
            # pieces that end here: longer ones are tried only as long as what precedes is the end of a piece
            found, at = [], i - 1
            while at >= done:
                piece = text[at:i]
                whole = ends.get(piece)
                if whole is None:
                    break
                if whole and at in last:
                    found.append(piece)
                at -= 1
            while found:
                piece = found.pop()
                before = last[i - len(piece)]
                if stable(before, piece) if before else self.built(piece)[0]:
                    last[i] = piece
                    break
            else:
                before, piece = last.get(i - 1), text[i - 1]
                if before is not None and piece not in ids:
                    last[i] = piece
            if i > due:
                meet = self._meeting(last, done, i)
                yield from self._path(last, done, meet)
                for p in range(done, min(meet, i - self.longest)):
                    last.pop(p, None)
                done, due = meet, max(meet + self.longest, i + self.longest // 2)
        yield from self._path(last, done, len(text))

    def _meeting(self, last: dict[int, str], done: int, i: int) -> int:
        """The place through which the paths go of all places that a later piece can start from."""
        ends = {p for p in range(i - self.longest + 1, i + 1) if p in last}
        while len(ends) > 1:
            p = max(ends)
            ends.remove(p)
            ends.add(max(done, p - len(last[p])))
        (meet,) = ends
        return meet

    def _path(self, last: dict[int, str], start: int, end: int) -> Iterator[int]:
        back = []
        self.committed += end > start
        while end > start:
            back.append(last[end])
            end -= len(last[end])
        for piece in reversed(back):
            yield from self._ids(piece)

    def _ids(self, piece: str) -> list[int]:
        """A piece's id, or those of the bytes of a character that is none."""
        k = self.ids.get(piece)
        return [k] if k is not None else [self.byte.get(b, self.unknown) for b in piece.encode("utf-8", "replace")]

    def _segment(self, s: str) -> bytes:
        """A run that is in neither half of the cache: streamed, or made of a stem and its marks if their pieces are stable side by side."""
        stem = s.rstrip(MARKS)
        if stem is not s and stem[-1:].isalpha() and len(s) <= LONG:
            head, tail = self._known(stem), self._known(s[len(stem) :])
            left, right = (self.piece.get(struct.unpack_from("<I", b, at)[0]) for b, at in ((head, len(head) - 4), (tail, 0)))
            if left and right and self.stable(left, right):
                return head + tail
        return array("I", self.stream(s)).tobytes()

    def _known(self, s: str) -> bytes:
        b = self.new.get(s)
        if b is None:
            b = self.old.get(s)
            if b is None:
                b = self._segment(s)
            if len(s) <= LONG:
                self.new[s] = b
        return b

    def learn(self, runs: Iterable[str]) -> None:
        """Put runs into the cache, parsed in ascending order by one lattice: what it has of the characters that a run shares with the one before stays."""
        ends, ids, stable, built, encoded, new = self.ends.get, self.ids, self.stable, self.built, self.encoded, self.new
        text, last = "", [""]  # at each place the last piece, None if there is none
        for run in sorted(runs):
            k, most = 0, min(len(text), len(run))
            while k < most and text[k] == run[k]:
                k += 1
            del last[k + 1 :]
            text = run
            for i in range(k + 1, len(run) + 1):
                best, at = [], i - 1
                piece = run[at]
                whole = ends(piece)
                while whole is not None:
                    if whole and last[at] is not None:
                        best.append(piece)
                    at -= 1
                    if at < 0:
                        break
                    piece = run[at:i]
                    whole = ends(piece)
                for piece in reversed(best):
                    before = last[i - len(piece)]
                    if stable(before, piece) if before else built(piece)[0]:
                        last.append(piece)
                        break
                else:
                    piece = run[i - 1]
                    last.append(None if last[i - 1] is None or piece in ids else piece)
            back, at = [], len(run)
            while at:
                piece = last[at]
                back.append(encoded(piece))
                at -= len(piece)
            back.reverse()
            new[run] = b"".join(back)
        self.committed += 1

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` for each of some texts; those of up to TOGETHER characters are split into runs together, so that new runs are met in one go."""
        out: list[bytes | None] = [None] * len(texts)
        some, size = [], 0

        def flush() -> None:
            nonlocal some, size
            wanted = {r for _, runs in some for r in runs}
            fresh = [r for r in wanted if r not in self.new]
            for r in fresh:
                if r in self.old:
                    self.new[r] = self.old[r]
            self.learn(r for r in fresh if r not in self.old and len(r) <= LONG)
            new = self.new
            for k, runs in some:
                out[k] = b"".join([self._known(r) if b is None else b for r, b in zip(runs, map(new.get, runs), strict=True)])
            if len(self.new) > CACHE:
                self.old, self.new = self.new, {}
            some, size = [], 0

        for k, t in enumerate(texts):
            if not t or len(t) > TOGETHER:
                out[k] = self.encode(t)
                continue
            some.append((k, self.meet.split(SPACE + t.replace(" ", SPACE))))
            size += len(t)
            if size > TOGETHER:
                flush()
        flush()
        return out

    def commits(self, parts: Iterable[str]) -> Iterator[bytes]:
        """The ids of a text that comes in parts, little-endian unsigned 32-bit, each time that all paths meet where white space starts."""
        held, new = [""], self.new
        for part in parts:
            before = held[-1][-1:]
            *runs, rest = self.meet.split(before + part.replace(" ", SPACE))
            if not runs:
                held.append(rest[len(before) :])
                continue
            runs[0] = "".join([*held, runs[0][len(before) :]])
            held = [rest]
            got = list(map(new.get, runs))
            yield b"".join([self._known(r) if b is None else b for r, b in zip(runs, got, strict=True)] if None in got else got)
            if len(new) > CACHE:
                self.old, self.new = new, {}
                new = self.new
        rest = "".join(held)
        if rest:
            yield self._known(rest)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        return b"".join(self.commits(chain((" ",), (text[at : at + PART] for at in range(0, len(text), PART)))))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.out.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids (little-endian unsigned 32-bit), sha256 (of the text) of every row's whole text.

    A null or empty text has no ids.  Rows that repeat are encoded as often, a null id stays null, other columns are ignored,
    an empty table gives no rows.  A very long text takes a window of memory besides itself and its ids.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, schema = pieces(vocabulary), arrow_schema(ENCODED)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                texts = b.column(1)[at : at + ROWS].to_pylist()
                ids = p.encode_many(texts)
                sha = [hashlib.sha256((t or "").encode("utf-8", "replace")).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + ROWS], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array(sha)], schema=schema)

    return id_text(docs, id_col, text_col).mapInArrow(task, ENCODED)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows as ``encode`` gives them; the rest of their columns stay beside it."""
    out = "doc_id long, text string, n_ids long, ids_crc32 long, sha256 string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, schema = pieces(vocabulary), arrow_schema(out)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                ids = [x or b"" for x in some.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([p.decode(x) for x in ids], pa.string()), some.column("n_ids"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), some.column("sha256")], schema=schema)

    return encoded.mapInArrow(task, out)


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256 and same of every row: its text encoded and decoded again with the 32k vocabulary.

    A null text counts as empty, which has no ids; ``same`` is false where the vocabulary normalises a text.  Rows that repeat give equal rows,
    null ids stay null, other columns are ignored, an empty table gives no rows.
    """
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    text = decode(encode(docs, path), path)
    return text.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("sha256")).alias("same"))
