"""Near-duplicate classes by a grouped prefix join on word shingles.

Two documents link when the Jaccard similarity of their shingle sets reaches a threshold; classes are what links connect.

1. A document's shingles are put in one order for all documents: frequent ones last.  Documents that link share a shingle
   of their prefixes, the first few in that order.
2. Documents with equal sets collapse into one, and those with equal prefix and size into a group.  Only groups are
   joined on prefix shingles, and pairs of groups are filtered by the bounds that sizes and places in the prefix give.
3. What is left of groups' pairs is expanded to members and verified on whole sets.  First each document is compared with one
   partner (of its group, or the group that shares most of its prefix); what links forms trees.  Then pairs of groups are
   joined that don't lie in one tree, and expanded to members of different trees, so no link between two classes is missed
   and no pair within one is made.  Members of one group that lie in different trees must share one of the next few
   shingles after the prefix as well, so they are joined on those and not all with all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_schema, cut, freeing, id_text, spread_join, thin
from .wordhash import encoded, grouped, new_key, shingles, words

#: Partners of one set that meet in a task, and entries of a list.
PARTNERS = 256
#: Shingles that are put last, by how many documents have them; at most so many, the most frequent ones.
HOT_SHINGLES, HOT_FROM = 1 << 19, 16

PREFIXES = "id long, mark long, n long, sdig binary, pdig binary, prefix array<long>, second array<long>"


def prefix_length(n: int, percent: int) -> int:
    """A set of n that links has at least ceil(n * percent / 100) shingles in common, so one of the first so many."""
    return n - -(-percent * n // 100) + 1 if n else 0


class Shingling(NamedTuple):
    """Words of a shingle, and the key of all hashes of this run."""

    size: int
    key: int


def _sets(batches: Iterator[pa.RecordBatch], how: Shingling) -> Iterator[tuple[list, list[np.ndarray]]]:
    for ids, texts in grouped(encoded(batches)):
        yield ids, list(shingles(words(texts, lower=True, key=how.key), how.size))


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of (tok, cnt), ascending, and their counts: HOT_SHINGLES of them at most, the most frequent."""
    counts = cut(counts.groupBy("tok").agg(F.sum("cnt").alias("cnt")).where(F.col("cnt") >= HOT_FROM), "hot-shingles")
    least = HOT_FROM
    while counts.where(F.col("cnt") >= least).count() > HOT_SHINGLES:
        least *= 2
    got = counts.where(F.col("cnt") >= least).toArrow()
    tok = got["tok"].to_numpy().view(np.uint64)
    order = np.argsort(tok)
    return tok[order], got["cnt"].to_numpy()[order]


def _counts_in(hot: tuple[np.ndarray, np.ndarray], s: np.ndarray) -> np.ndarray:
    """How frequent each shingle of ``s`` is; 0 if it isn't among the frequent ones."""
    tok, cnt = hot
    if not len(tok):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(tok, s), len(tok) - 1)
    return np.where(tok[at] == s, cnt[at], 0)


def _hot(docs: DataFrame, how: Shingling, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles and their counts.

    They are first counted over twice every document's prefix in order of hashes.  Where so many of those are frequent that
    fewer than a prefix is left, as in large groups of near copies, the document's other shingles are counted too.
    Any order gives right results; this one keeps the lists that are joined short, as what sets a copy apart comes first.
    """
    counted = "tok long, cnt long"

    def summed(some: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if some:
            tok, cnt = np.unique(np.concatenate(some), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(tok.view(np.int64)), pa.array(cnt.astype(np.int64))], schema=arrow_schema(counted))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, how):
            yield from summed([s[: 2 * prefix_length(len(s), percent)] for s in sets])

    found = _most_frequent(docs.mapInArrow(freeing(first), counted))
    sent = docs.sparkSession.sparkContext.broadcast(found)

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches, how):
            some = []
            for s in sets:
                p = prefix_length(len(s), percent)
                if np.count_nonzero(_counts_in(sent.value, s[: 2 * p]) == 0) < p < len(s) / 2:
                    some.append(s[2 * p :])
            yield from summed(some)

    known = docs.sparkSession.createDataFrame(pa.table({"tok": found[0].view(np.int64), "cnt": found[1]}, schema=arrow_schema(counted)))
    return _most_frequent(docs.mapInArrow(freeing(rest), counted).unionByName(known)) if len(found[0]) else found


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _lists(some: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*some, np.zeros(0, np.uint64)]).view(np.int64)))


def _sliced(batches: Iterator[pa.RecordBatch], how: Shingling) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Rows whose first two columns are id and text, and their sets."""
    for b in batches:
        at = 0
        for _, sets in _sets(iter([b.select([0, 1])]), how):
            yield b.slice(at, len(sets)), sets
            at += len(sets)


def _prefixes(docs: DataFrame, how: Shingling, percent: int) -> DataFrame:
    """Each document's set size, digests of its set and its prefix, the prefix, and as many shingles after it; ``mark`` is a hash of the text."""
    sent = docs.sparkSession.sparkContext.broadcast(_hot(docs, how, percent))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, hot = arrow_schema(PREFIXES), sent.value
        for b, sets in _sliced(batches, how):
            sdig, pdig, prefix, second = [], [], [], []
            for s in sets:
                p = prefix_length(len(s), percent)
                first = s[np.argsort(_counts_in(hot, s), kind="stable")[: 2 * p]]
                sdig.append(_digest(s))
                pdig.append(_digest(first[:p]))
                prefix.append(first[:p])
                second.append(first[p:])
            columns = (b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(sdig, pa.binary()), pa.array(pdig, pa.binary()), _lists(prefix), _lists(second))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return docs.select("id", "text", "mark").mapInArrow(freeing(task), PREFIXES)


def _with_sets(rows: DataFrame, how: Shingling) -> DataFrame:
    """(a, b, set) of those rows (id, text, a, b, sdig) whose text has the set of that digest: rows that share an id and a mark are told apart."""
    out = "a long, b long, set array<long>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema(out)
        for b, sets in _sliced(batches, how):
            own = [k for k, (s, d) in enumerate(zip(sets, b.column(4).to_pylist(), strict=True)) if _digest(s) == d]
            if own:
                b = b.take(pa.array(own))
                yield pa.RecordBatch.from_arrays([b.column(2), b.column(3), _lists([sets[k] for k in own]).cast(schema.field(2).type)], schema=schema)

    return rows.select("id", "text", "a", "b", "sdig").mapInArrow(freeing(task), out)


def _verified(docs: DataFrame, sets: DataFrame, pairs: DataFrame, how: Shingling, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) of sets' numbers whose whole sets link.

    A pair's set of b moves to where a's is, once; an a with many partners is split over tasks.
    """
    asked = cut(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("c")), "partners")
    rows = pairs.count()

    def fetched(wanted: DataFrame) -> DataFrame:
        return _with_sets(docs.join(thin(wanted, rows), ["id", "mark"]), how)

    where = sets.select("sid", "id", "mark", "sdig")
    left = fetched(asked.join(where, F.col("a") == F.col("sid")).select("id", "mark", "a", F.lit(0).cast("long").alias("b"), "sdig"))
    left = left.select("a", F.col("set").alias("set_a")).join(asked, "a")
    right = fetched(pairs.join(where, F.col("b") == F.col("sid")).select("id", "mark", "a", "b", "sdig"))
    hot = asked.where(F.col("c") > PARTNERS).select("a", F.ceil(F.col("c") / PARTNERS).cast("int").alias("parts"))
    right = right.join(thin(hot), "a", "left").withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("c") / PARTNERS).cast("int") - 1)))
    both = F.size(F.array_intersect("set_a", "set"))
    return right.join(left, ["a", "salt"]).where(100 * both >= percent * (F.size("set_a") + F.size("set") - both)).select("a", "b").distinct()


def _roots(parents: DataFrame) -> DataFrame:
    """(id, root) from (id, parent), where parents have smaller ids; paths halve each time."""
    parents = cut(parents, "parents")
    while True:
        up = parents.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        nxt = cut(parents.join(up, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")), "parents")
        if nxt.where("moved").isEmpty():
            return nxt.select("id", F.col("parent").alias("root"))
        parents = nxt.select("id", "parent")


def connected(links: DataFrame) -> DataFrame:
    """(id, root): the smallest id that links (a, b) lead to, for every id that has a link.

    Each round hangs every node and its larger neighbours on its smallest neighbour, and the other way round, until only stars are left.
    """
    links = cut(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    while True:
        # large star: larger neighbours go to the smallest one around
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        small = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(small, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the smallest of them
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        nxt = large.join(least, "b").select(F.col("m").alias("x"), F.explode(F.array("a", "b")).alias("y")).where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
        nxt = cut(nxt, "links")
        if nxt.join(links, ["a", "b"], "left_anti").isEmpty() and links.join(nxt, ["a", "b"], "left_anti").isEmpty():
            return nxt.select(F.col("b").alias("id"), F.col("a").alias("root")).unionByName(nxt.select(F.col("a").alias("id"), F.col("a").alias("root")).distinct())
        links = nxt


def _fits(percent: int, one, two):
    """Whether two prefixes that share a shingle at these places can belong to sets that link; ``one`` and ``two`` are (size, place)."""
    (na, pa_), (nb, pb) = one, two
    rest = F.least(na - pa_, nb - pb)  # from the first common shingle on
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * rest >= percent * (na + nb))


def _apart(postings: DataFrame, keys: list[str], which: str, percent: int | None = None) -> DataFrame:
    """(a, b), a < b: pairs of ``which`` in one list that don't lie in one tree; ``postings`` have lo and hi, the least and greatest root of each.

    The tree that most of a list lies in isn't compared with itself: one side of the join is without it.  Long lists are
    split over tasks.
    """
    trees = postings.groupBy(*keys, "lo").agg(F.count(F.lit(1)).alias("c"), F.max("hi").alias("hi"))
    lists = trees.groupBy(*keys).agg(F.max_by("lo", "c").alias("top"), F.sum("c").alias("c"), F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h")
    lists = cut(lists.select(*keys, "top", "c"), "lists")
    mixed = cut(spread_join(postings, lists.withColumn("n_met", F.col("c")), keys, "n_met", by=(which,)), "mixed")
    parts = F.ceil(F.col("c") / PARTNERS).cast("int")
    rest = ["lo", "hi", which, *["n", "pos"] * (percent is not None)]
    one = mixed.where("lo <> hi or lo <> top").select(*keys, F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"), *[F.col(c).alias(f"{c}_a") for c in rest])
    two = mixed.select(*keys, F.pmod(F.xxhash64(which), parts).cast("int").alias("salt"), *[F.col(c).alias(f"{c}_b") for c in rest])
    a, b = F.col(f"{which}_a"), F.col(f"{which}_b")
    pairs = one.join(two, [*keys, "salt"]).where((a != b) & (F.least("lo_a", "lo_b") < F.greatest("hi_a", "hi_b")))
    if percent is not None:
        pairs = pairs.where(_fits(percent, (F.col("n_a"), F.col("pos_a")), (F.col("n_b"), F.col("pos_b"))))
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _classes(docs: DataFrame, shingle: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, n, first) of every row: ``first`` is the id and mark of its class's least row, null for a row without id or without words."""
    how = Shingling(shingle, new_key())
    base = id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))
    x = cut(_prefixes(base, how, percent), "prefixes")
    node = ["n", "sdig"]
    real = x.where("n > 0 and id is not null")
    first = F.min(F.struct("id", "mark")).alias("first")
    # every distinct set has a number of its own, whatever ids its rows share with others; numbers ascend with ids, as an original tends
    # to come before its copies, which link with it rather than with each other
    sets = real.groupBy(*node, "pdig").agg(first, F.count(F.lit(1)).alias("rows")).orderBy("first")
    sets = sets.select(F.monotonically_increasing_id().alias("sid"), *node, "pdig", "first.id", "first.mark", "first", "rows")
    sets = cut(sets, "sets")
    groups = cut(sets.groupBy("n", "pdig").agg(F.min("sid").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")
    texts = base.where("id is not null")

    # what groups' prefixes have in common
    heads = sets.join(groups.select(F.col("gid").alias("sid")), "sid", "left_semi").select("sid", "id", "mark", "sdig")
    heads = real.select("id", "mark", "n", "sdig", "prefix").join(heads, ["id", "mark", "sdig"]).groupBy(F.col("sid").alias("gid"), "n").agg(F.first("prefix").alias("prefix"))
    posted = cut(heads.select("gid", "n", F.posexplode("prefix").alias("pos", "tok")), "prefix-places")
    lists = cut(posted.groupBy("tok").agg(F.min(F.struct("gid", "n", "pos")).alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1"), "lists")
    posted = cut(spread_join(posted, lists, ["tok"], "c", by=("gid",)), "postings")

    hub = F.col("hub")
    best = posted.where((F.col("gid") > hub["gid"]) & _fits(percent, (F.col("n"), F.col("pos")), (hub["n"], hub["pos"]))).groupBy("gid", hub["gid"].alias("a")).agg(F.count(F.lit(1)).alias("c"))
    best = best.groupBy(F.col("gid").alias("b")).agg(F.max_by("a", F.struct("c", -F.col("a"))).alias("a")).select("a", "b")
    grouped_sets = cut(sets.select("sid", "n", "pdig").join(groups, ["n", "pdig"]).select("sid", "n", "gid", "members"), "grouped")
    own = grouped_sets.where("sid > gid").select(F.col("gid").alias("a"), F.col("sid").alias("b"))
    asked = cut(best.unionByName(own).distinct(), "pairs")
    links = cut(_verified(texts, sets, asked, how, percent), "verified")
    roots = _roots(links.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")))

    # pairs of groups that share a prefix shingle and don't lie in one tree, filtered, then expanded to members of different trees
    members = grouped_sets.join(roots.withColumnRenamed("id", "sid"), "sid", "left").select("sid", "gid", F.coalesce("root", "sid").alias("root"))
    members = cut(members, "members")
    ranges = cut(members.groupBy("gid").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "ranges")
    pairs = cut(_apart(posted.select("tok", "pos", "gid", "n").join(ranges, "gid"), ["tok"], "gid", percent), "group-pairs")
    side = members.withColumnRenamed("gid", "g")
    wide = pairs.join(side.select(F.col("g").alias("a"), F.col("sid").alias("sid_a"), F.col("root").alias("root_a")), "a").join(side.select(F.col("g").alias("b"), F.col("sid").alias("sid_b"), F.col("root").alias("root_b")), "b")
    across = wide.where("root_a <> root_b").select(F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"))
    # members of one group in different trees share a shingle of the next few
    split = members.join(ranges.where("lo < hi"), "gid", "left_semi").join(sets.select("sid", "id", "mark", "sdig"), "sid")
    next_few = real.select("id", "mark", "sdig", "second").join(split, ["id", "mark", "sdig"]).groupBy("sid", "gid", "root").agg(F.first("second").alias("second"))
    within = _apart(next_few.select("gid", "sid", F.col("root").alias("lo"), F.col("root").alias("hi"), F.explode("second").alias("tok")), ["gid", "tok"], "sid")
    pairs = cut(across.unionByName(within).distinct().join(asked, ["a", "b"], "left_anti"), "pairs")
    more = links.unionByName(_verified(texts, sets, pairs, how, percent))

    # links between trees, and those that the trees left out
    up = roots.select(F.col("id").alias("a"), F.col("root").alias("ra"))
    down = roots.select(F.col("id").alias("b"), F.col("root").alias("rb"))
    between = more.join(up, "a", "left").join(down, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).where("a <> b")
    top = cut(connected(between), "classes")
    label = members.select("sid", "root").join(top.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("sid", F.coalesce("top", "root").alias("top"))
    label = label.join(sets.select("sid", *node, "first", "rows"), "sid")
    least = label.groupBy("top").agg(F.min("first").alias("least"))
    label = cut(label.join(least, "top").select(*node, F.col("least").alias("first"), "rows"), "labels")
    out = spread_join(x.select("id", "mark", *node), label, node, "rows", "left", by=("id", "mark"))
    return out.select("id", "mark", "n", F.when(F.col("id").isNotNull(), F.col("first")).alias("first"))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: its set's size and the smallest id that links lead to.

    Words are runs of characters other than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    ``shingle`` words; a text with fewer words has one shingle of them all, one without any none, and it links with nothing.
    Sets link when 100 * intersection >= ``percent`` * union.  Every row is one row of the result and is judged by its own
    text, also where rows share an id: an id that two texts share links neither.  Rows without id link with nothing and have
    a null component; a row that links with nothing has its own id; an empty table gives no rows; other columns are ignored.
    Words and shingles stand for themselves by 64-bit hashes whose key is drawn anew for each run (:mod:`wordhash`).
    """
    found = _classes(docs, shingle, percent, id_col, text_col)
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the least of their class: smallest id, then smallest hash of the text.

    Rows without id or without words stay.  Rows that share an id are judged by their own texts; rows that repeat an id and a text stay or go together.
    """
    found = _classes(docs, shingle, percent, id_col, text_col).where("first is not null")
    gone = found.where("first.id <> id or first.mark <> mark").select(F.col("id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    own = (docs[f"`{id_col}`"].cast("long") == F.col("__gone")) & (F.xxhash64(docs[f"`{text_col}`"].cast("string")) == F.col("__mark"))
    return docs.join(thin(cut(gone, "gone")), own, "left_anti")
