"""Duplicate passages by relative Lempel-Ziv parsing against blocks of every document.

Every document is cut into reference blocks of BLOCK words (and so many more that a phrase which starts in a block ends in it).
The index of blocks holds phrases: each window of ``size`` words chooses the least hash of its GRAM-word sequences as its
anchor, and the neighbouring windows with one anchor form a phrase.  Equal windows have equal anchors, so looking up
a document's phrases by anchor gives seeds: places of blocks at which the words may go on as they do in the document.

A document is parsed greedily from left to right: at the first seed that no factor holds, every block that its seeds name is
followed word by word, and the longest stretch of at least ``size`` equal words becomes a factor, which goes on over the borders of
blocks.  A seed names one of the places with its words (the least, or the greatest for the least itself), as following all of
those that a common passage has would be the square of them; so a factor is the longest among the named places.  At a factor's end
the windows across the boundary are tried in the same way, so factors overlap where both sides are copied.  What factors
cover is removed: it holds every window that also starts elsewhere, and nothing else, as the words themselves are compared.
"""

from __future__ import annotations

import hashlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, cut, id_text, slices, spread_join
from .wordhash import encoded, grouped, mix, new_key, odd_numbers, words

SIZE, GRAM = 35, 8
#: Words of a reference block, besides those that its last phrase goes on for.
BLOCK = 128
#: Places of phrases or blocks that are broadcast at most, about 16 bytes each; with more the texts are shuffled to them.
PLACES = 1_500_000
#: Stands in for a null id within joins, where null has no equal.
NO_ID = -(2**63)

PHRASES = "anchor long, phrase long, id long, mark long, first long, windows long"
WINDOWS = "anchor long, win long, m long, id long, mark long, first long"
BLOCKS = "ref_key long, ref_mark long, block long, words binary"
KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, n_factors long"
SPANS = "doc_id long, first_word long, words long, ref_doc_id long, ref_word long"


class _Parsed:
    """Hashes of all word sequences of some texts.

    The hash of 2^k words is made of those of its halves, and that of any number of the first and the last 2^k of its words; each step
    multiplies by its own keyed number and folds, so no pattern of words makes hashes meet.
    """

    def __init__(self, texts: list[bytes], size: int, key: int):
        self.w, self.size = words(texts, lower=False, key=key), size
        self.odd, self.levels = odd_numbers(key, 66), [self.w.hashes]

    def _pair(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        x = (a ^ self.odd[k]) * self.odd[k + 1]
        x = ((x ^ (x >> np.uint64(32))) + b) * self.odd[k + 2]
        return x ^ (x >> np.uint64(29))

    def _twice(self, k: int) -> np.ndarray:
        """Of every 2^k words."""
        while len(self.levels) <= k:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            n = max(0, len(last) - step)
            self.levels.append(self._pair(last[:n], last[step : step + n], len(self.levels) - 1))
        return self.levels[k]

    def run(self, first: np.ndarray, length) -> np.ndarray:
        """Of ``length`` words from ``first`` on; one length for all or one for each."""
        length = np.broadcast_to(np.asarray(length, np.int64), first.shape)
        out, wide = np.zeros(len(first), np.uint64), np.frexp(length)[1] - 1
        for k in np.unique(wide).tolist():
            own = slice(None) if wide.min() == wide.max() else wide == k
            at, n = first[own], length[own]
            some = self._twice(k)
            out[own] = mix(self._pair(some[at], some[at + n - (1 << k)], 63) + n.astype(np.uint64))
        return out

    def phrases(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each text with a window: its number and its phrases' anchors, hashes, first words and windows."""
        n, size = len(self.w.hashes), self.size
        gram = min(GRAM, size)
        if n < size:
            return
        value = self.run(np.arange(n - gram + 1), gram)
        at = np.arange(len(value))
        wide, reach = 1, size - gram + 1
        while wide < reach:  # the first of the least among the next ``wide`` sequences
            step = min(wide, reach - wide)
            less = value[step:] < value[:-step]
            value, at, wide = np.where(less, value[step:], value[:-step]), np.where(less, at[step:], at[:-step]), wide + step
        for k, (a, z) in enumerate(zip(self.w.bounds[:-1].tolist(), self.w.bounds[1:].tolist(), strict=True)):
            if z - a < size:
                continue
            own = at[a : z - size + 1]
            first = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
            count = np.diff(np.concatenate((first, [len(own)])))
            yield k, value[a : z - size + 1][first], self.run(a + first, count + size - 1), first, count


def _column(c) -> pa.Array:
    return c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64))


def _rows(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_column(c) for c in columns], schema=arrow_schema(names))


def _phrases(docs: DataFrame, size: int, key: int, anchors_only: bool) -> DataFrame:
    """Phrases of rows (id, text, mark), or their anchors and how often each is met."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for _, texts in grouped(encoded(iter([b.select([0, 1])]))):
                ids, marks, at = b.column(0).slice(at, len(texts)), b.column(2).slice(at, len(texts)), at + len(texts)
                got = list(_Parsed(texts, size, key).phrases())
                if not got:
                    continue
                anchor = np.concatenate([g[1] for g in got])
                if anchors_only:
                    yield _rows("anchor long, n long", *np.unique(anchor, return_counts=True))
                    continue
                row = pa.array(np.repeat([g[0] for g in got], [len(g[1]) for g in got]))
                yield _rows(PHRASES, anchor, np.concatenate([g[2] for g in got]), ids.take(row), marks.take(row), np.concatenate([g[3] for g in got]), np.concatenate([g[4] for g in got]))

    return docs.mapInArrow(task, "anchor long, n long" if anchors_only else PHRASES)


def _joined(task, names: str):
    """``task`` with its many small batches put together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for b in task(batches):
            some.append(b)
            size += b.num_rows
            if size > 20_000:
                yield from pa.Table.from_batches(some).combine_chunks().to_batches()
                some, size = [], 0
        if some:
            yield from pa.Table.from_batches(some, arrow_schema(names)).combine_chunks().to_batches()

    return run


def _windows(rows: DataFrame, size: int, key: int) -> DataFrame:
    """The windows of phrases: of rows (id, text, mark, asked), where asked has the phrases' anchors, first words, windows and m."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i, t, mark, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                p = _Parsed([t.encode("utf-8", "replace")], size, key)
                first = np.array([x["first"] for x in asked], np.int64)
                count = np.array([x["windows"] for x in asked], np.int64)
                n = int(count.sum())
                start = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(n)
                anchor, m = (np.repeat(np.array([x[c] for x in asked], np.int64), count) for c in ("anchor", "m"))
                yield _rows(WINDOWS, anchor, p.run(start, size), m, pa.array([i] * n, pa.int64()), pa.array([mark] * n, pa.int64()), start)

    return rows.mapInArrow(_joined(task, WINDOWS), WINDOWS)


def _key(column: str):
    return F.coalesce(column, F.lit(NO_ID))


def _other(there, lo="lo", hi="hi"):
    """The least place, or the greatest for the least itself."""
    return F.when(there == F.col(lo), F.col(hi)).otherwise(F.col(lo))


def seeds(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(id, mark, first, windows, ref): places of phrases or windows of rows (id, text, mark), and one other place with the same hashes.

    Places are told apart by id and by ``mark``, a hash of the text.  Rows that repeat both have the same places and are counted as often.
    """
    texts, key = docs.where("text is not null"), new_key()
    twice = cut(_phrases(texts, size, key, anchors_only=True).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1"), "anchors")
    met = cut(spread_join(_phrases(texts, size, key, anchors_only=False), twice, ["anchor"], "n", by=("id", "first")), "phrases")
    where = F.struct("id", "mark", "first")
    kinds = met.groupBy("anchor", "phrase", "windows").agg(F.count(F.lit(1)).alias("m"), F.min(where).alias("lo"), F.max(where).alias("hi"))
    kinds = cut(kinds, "kinds")
    kind = ["anchor", "phrase", "windows"]
    whole = spread_join(met, kinds.where("m > 1").select(*kind, "m", "lo", "hi"), kind, "m", by=("id", "first")).select("id", "mark", "first", "windows", _other(where).alias("ref"))
    # phrases of one anchor that aren't equal can still share windows
    mixed = cut(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "mixed")
    asked = spread_join(kinds.select(*kind, "m", "lo"), mixed, ["anchor"], "k", by=("phrase",))
    asked = asked.groupBy("lo.id", "lo.mark").agg(F.collect_list(F.struct("anchor", F.col("lo.first").alias("first"), "windows", "m")).alias("asked"))
    asked = cut(asked, "asked")
    wins = cut(_windows(_with_text(texts, asked, "asked", ["asked"]), size, key), "windows")
    again = wins.groupBy("anchor", "win").agg(F.sum("m").alias("all"), F.count(F.lit(1)).alias("c"), F.min(where).alias("lo"), F.max(where).alias("hi")).where("all > 1")
    again = cut(again.select("anchor", "win", "c", "lo", "hi"), "again")
    single = spread_join(wins.where("m = 1"), again, ["anchor", "win"], "c", by=("id", "first")).select("id", "mark", "first", F.lit(1).cast("long").alias("windows"), _other(where).alias("ref"))
    return whole.unionByName(single)


def _with_text(texts: DataFrame, wanted: DataFrame, sized: str, columns: list[str]) -> DataFrame:
    """(id, text, mark, *columns): one row for each of ``wanted``, which have id, mark and an array ``sized``; of rows that repeat id and text one is taken."""
    places = wanted.agg(F.sum(F.size(sized))).first()[0] or 0
    side = wanted.select(_key("id").alias("key"), "mark", *columns)
    return texts.withColumn("key", _key("id")).join(F.broadcast(side) if places <= PLACES else side, ["key", "mark"]).select("id", "text", "mark", *columns)


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ref_key, ref_mark, block, words): blocks of rows (id, text, mark, blocks), by number; words are joined by spaces."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(BLOCKS)
        for b in slices(batches):
            for i, t, mark, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = t.encode("utf-8", "replace").split()
                made = [b" ".join(w[k * BLOCK : (k + 1) * BLOCK + 2 * size]) for k in wanted]
                n = len(wanted)
                yield pa.RecordBatch.from_arrays([pa.array([NO_ID if i is None else i] * n, pa.int64()), pa.array([mark] * n, pa.int64()), pa.array(wanted, pa.int64()), pa.array(made, pa.binary())], schema=schema)

    return rows.mapInArrow(_joined(task, BLOCKS), BLOCKS)


def _stretch(a: list[bytes], i: int, b: list[bytes], j: int) -> int:
    """How many words are equal from a[i] and b[j] on."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 32
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, 2 * step
        elif step == 1:
            break
        else:
            step = max(1, step // 2)
    return max(n, 0)


def greedy_factors(w: list[bytes], found: list[tuple], size: int) -> list[tuple[int, int, int | None, int]]:
    """Factors (first word, words, reference, its word) of a document's words.

    ``found`` are blocks: (reference, its number, its words, seeds), and seeds are (first word here, windows, first word there).  The factor
    from a place is the longest of those that its blocks give; a seed that a factor holds isn't followed, one that goes on across a
    factor's end is followed from the first window that does.  A factor goes on over the borders of its reference's blocks.
    """
    starts = sorted(((first, windows, there, k) for k, (_, _, _, own) in enumerate(found) for first, windows, there in own))
    out, end, at = [], 0, 0
    while at < len(starts):
        first, windows, _, _ = starts[at]
        if first + windows + size - 1 <= end:
            at += 1
            continue
        place, best = max(first, end - size + 1), (0, None, 0)
        k = at
        while k < len(starts) and starts[k][0] <= place:
            s, n, there, which = starts[k]
            k += 1
            if s + n <= place:  # none of its windows starts here
                continue
            ref, number, words_there, _ = found[which]
            got = _stretch(w, place, words_there, there + place - s - number * BLOCK)
            goes_on = out and out[-1][2:] == (ref, there + place - s - (place - out[-1][0]))
            if got > best[0] or got == best[0] and goes_on:
                best = (got, ref, there + place - s)
        if best[0] >= size:
            end = place + best[0]
            if out and place <= sum(out[-1][:2]) and out[-1][2:] == (best[1], best[2] - (place - out[-1][0])):
                out[-1] = (out[-1][0], end - out[-1][0], *out[-1][2:])  # the next block of the same document: one factor
            else:
                out.append((place, *best))
            continue
        at += 1  # hashes were equal and words aren't: the seed's next window may do
        if place + 1 < first + windows:
            insort(starts, (place + 1, first + windows - place - 1, starts[at - 1][2] + place + 1 - first, starts[at - 1][3]), lo=at)
    return out


def _parsed(docs: DataFrame, size: int, names: str, row) -> DataFrame:
    """``row(id, words, factors)`` gives the rows (of ``names``) for each of ``docs`` (id, text, mark)."""
    found = cut(seeds(docs, size), "seeds")
    block = ["ref_key", "ref_mark", "block"]
    found = found.select(_key("id").alias("key"), "mark", "first", "windows", _key("ref.id").alias("ref_key"), F.col("ref.mark").alias("ref_mark"), F.col("ref.first").alias("there"), (F.col("ref.first") / BLOCK).cast("long").alias("block"))
    found = cut(found.groupBy("key", "mark", *block).agg(F.collect_set(F.struct("first", "windows", "there")).alias("own")), "block-seeds")
    wanted = cut(found.groupBy(*block).agg(F.count(F.lit(1)).alias("c")), "wanted")
    asked = cut(wanted.groupBy(F.col("ref_key").alias("id"), F.col("ref_mark").alias("mark")).agg(F.collect_list("block").alias("blocks")), "asked-blocks")
    blocks = _blocks(_with_text(docs.where("text is not null"), asked, "blocks", ["blocks"]), size).groupBy(*block).agg(F.first("words").alias("words"))
    near = spread_join(found, cut(blocks.join(wanted, block), "blocks"), block, "c", by=("key", "mark"))
    near = near.groupBy("key", "mark").agg(F.collect_list(F.struct("ref_key", "block", "words", "own")).alias("found"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(names)
        for b in slices(batches):
            rows = []
            for i, t, got in zip(*(c.to_pylist() for c in b.columns), strict=True):
                w = (t or "").encode("utf-8", "replace").split()
                near_by = [(None if x["ref_key"] == NO_ID else x["ref_key"], x["block"], x["words"].split(), [(s["first"], s["windows"], s["there"]) for s in x["own"]]) for x in got or ()]
                rows += row(i, w, greedy_factors(w, near_by, size))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.withColumn("key", _key("id")).join(near, ["key", "mark"], "left").select("id", "text", "found").mapInArrow(task, names)


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def duplicate_spans(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, first_word, words, ref_doc_id, ref_word: the factors of every document, and where each can be copied from.

    A text that is null, empty or shorter than ``size`` words has none; a null id stays null; rows that repeat are copies of each other, so both have factors;
    a text of any length is one document, whose factors go on over blocks; an empty table gives no rows.
    """
    return _parsed(_marked(docs, id_col, text_col), size, SPANS, lambda i, w, factors: [(i, first, n, ref, there) for first, n, ref, there in factors])


def without_duplicates(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_factors of every row, and the kept text if asked for.

    Words are runs of characters other than ASCII white space.  Each word is removed that a window of ``size`` words
    covers whose words also start anywhere else, same document included; all windows are judged on the input.
    A null text has no words; a text with fewer words than a window stays; rows that repeat are copies of each other;
    rows that share an id are told apart by their texts; null ids stay null; an empty table gives no rows.
    """

    def row(i, w, factors):
        keep = np.ones(len(w), bool)
        for first, n, _, _ in factors:
            keep[first : first + n] = False
        left = b" ".join([x for x, k in zip(w, keep.tolist(), strict=True) if k]) if factors else b" ".join(w)
        return [(i, len(w), len(w) - int(keep.sum()), hashlib.sha256(left).hexdigest(), len(factors), *[left.decode()] * keep_text)]

    return _parsed(_marked(docs, id_col, text_col), size, KEPT + ", kept string" * keep_text, row)
