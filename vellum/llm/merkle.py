"""A Merkle manifest of a table: leaves per row, trees per group, a root, and a proof for each leaf by coordinate lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, thin

#: Children of a node.
FAN = 8
#: Levels with so many nodes in all are looked up from a broadcast: at most about 1.2 times as many rows of a digest.
SMALL_LEVEL = 1 << 15
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(value: Column) -> Column:
    """A value as it goes into a leaf: its number of UTF-8 bytes, a colon and itself; null is a hyphen."""
    said = value.cast("string")
    return F.when(said.isNull(), "-").otherwise(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``pos`` (unique, ascending in group and order), ``idx`` (from 0 in each group, nulls first) and ``size`` (of the group).

    No group is collected: rows are range-partitioned by group and order, numbered where they lie and written; only the rows of one
    (partition, group) are counted, and their offsets are sums over partitions.  Rows equal in all of ``order`` are split by where they were read.
    """
    at = rows.withColumn("__read", F.monotonically_increasing_id())
    dealt = at.repartitionByRange(group, *order, "__read").sortWithinPartitions(group, *order, "__read").drop("__read")
    placed = cut(dealt.withColumn("pos", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("pos", 33)), "merkle-order")
    counted = placed.groupBy("__part", group).agg(F.min("pos").alias("__least"), F.count(F.lit(1)).alias("__n"))
    by = Window.partitionBy(group)
    before = F.coalesce(F.sum("__n").over(by.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut(counted.withColumn("__before", before).withColumn("size", F.sum("__n").over(by)), "merkle-offsets")
    found = placed.join(thin(offsets.drop("__n")), ["__part", group])
    return found.select(*rows.columns, "pos", (F.col("pos") - F.col("__least") + F.col("__before")).alias("idx"), "size")


def width(size: Column, level: int) -> Column:
    """Nodes of a group of ``size`` leaves at a level: rounding up level by level is rounding up once."""
    return F.ceil(size / F.lit(FAN**level)).cast("long")


def depth(size: Column) -> Column:
    """Levels above the leaves, in whole numbers (63 bits have 21 at most)."""
    return sum((F.when(size > F.lit(FAN**k), 1).otherwise(0) for k in range(21)), F.lit(0))


def node_table(leaves: DataFrame, group: str) -> tuple[DataFrame, list[int]]:
    """(group, size, level, idx, digest) of all nodes of each group's tree, and the number of nodes of each level.

    ``leaves`` has group, size, idx and digest.  Each run of FAN consecutive nodes becomes the hash of its digests, level by level,
    until one is left; the table is written level by level.  The number of levels is the logarithm of the largest group.
    """
    level = leaves.select(group, "size", F.lit(0).alias("level"), "idx", "digest")
    n, largest = level.agg(F.count(F.lit(1)), F.max("size")).first()
    levels, counts = [level], [n]
    for k in range(1, 22):
        if (largest or 0) <= FAN ** (k - 1):
            break
        runs = level.where(width(F.col("size"), k - 1) > 1).groupBy(group, "size", F.floor(F.col("idx") / FAN).alias("idx"))
        run = F.array_sort(F.collect_list(F.struct("idx", "digest")))
        made = runs.agg(F.sha2(F.array_join(F.transform(run, lambda x: x["digest"]), ""), 256).alias("digest"))
        level = cut(made.select(group, "size", F.lit(k).alias("level"), "idx", "digest"), "merkle-level")
        levels.append(level)
        counts.append(level.count())
    nodes = levels[0]
    for x in levels[1:]:
        nodes = nodes.unionByName(x)
    return nodes, counts


def tops(nodes: DataFrame, group: str) -> DataFrame:
    """(group, digest): the one node that is left of each group."""
    return nodes.where(F.col("level") == depth(F.col("size"))).select(group, "digest")


def _coordinates(level: int) -> Column:
    """array<struct<level, idx>>: the siblings of a leaf's ancestor at a level, none where its group has one node."""
    here = F.floor(F.col("idx") / F.lit(FAN**level)).cast("long")
    first = here - F.pmod(here, F.lit(FAN))
    run = F.sequence(first, F.least(first + (FAN - 1), width(F.col("size"), level) - 1))
    return F.transform(F.filter(run, lambda i: i != here), lambda i: F.struct(F.lit(level).alias("level"), i.alias("idx")))


def with_paths(leaves: DataFrame, nodes: DataFrame, counts: list[int], group: str) -> DataFrame:
    """``leaves`` (with group, pos, idx, size) and ``path``, each leaf's siblings as array<struct<place, digest>>; place is FAN * level + place in the run.

    Each leaf explodes the coordinates of its siblings from its own index and its group's size, and they are joined with the node
    table.  The many coordinates that ask for the few nodes of upper levels meet a broadcast of those (their number is counted, SMALL_LEVEL);
    a node of a level below is asked for by at most a SMALL_LEVEL-th of the coordinates, so none is hot.
    """
    top = next((k for k, n in enumerate(counts) if n <= SMALL_LEVEL), len(counts))
    wanted = [_coordinates(k) for k in range(len(counts) - 1)]
    if not wanted:
        return leaves.withColumn("path", F.expr("cast(array() as array<struct<place:int,digest:binary>>)"))
    asked = leaves.select("pos", group, F.explode(F.concat(*wanted)).alias("w")).select("pos", group, "w.*")
    named = nodes.select(group, "level", "idx", F.unhex("digest").alias("digest"))
    found = []
    if top:
        found.append(asked.where(F.col("level") < top).join(named.where(F.col("level") < top), [group, "level", "idx"]))
    if top < len(counts):
        found.append(asked.where(F.col("level") >= top).join(F.broadcast(named.where(F.col("level") >= top)), [group, "level", "idx"]))
    got = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    place = (F.col("level") * FAN + F.pmod("idx", F.lit(FAN))).cast("int")
    paths = got.select("pos", F.struct(place.alias("place"), "digest").alias("x")).groupBy("pos").agg(F.array_sort(F.collect_list("x")).alias("path"))
    return leaves.join(paths, "pos", "left").withColumn("path", F.coalesce("path", F.expr("cast(array() as array<struct<place:int,digest:binary>>)")))


def joined(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda x: F.lower(F.hex(x["digest"]))), "")


def folded(path: Column, leaf: Column, idx: Column, size: Column) -> Column:
    """The top that follows from a leaf and its siblings: at each level the digest stands between those left and right of it."""

    def above(digest: Column, k: Column) -> Column:
        mine = F.pmod(F.floor(idx / F.pow(F.lit(FAN), k)), F.lit(FAN)) + k * FAN
        left = F.filter(path, lambda x: (x["place"] >= k * FAN) & (x["place"] < mine))
        right = F.filter(path, lambda x: (x["place"] > mine) & (x["place"] < (k + 1) * FAN))
        return F.sha2(F.concat(joined(left), digest, joined(right)), 256)

    return F.aggregate(F.slice(F.sequence(F.lit(0), F.lit(20)), F.lit(1), depth(size)), leaf, above)


def manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang") -> dict[str, DataFrame]:
    """A Merkle manifest of ``docs``: ``leaves``, ``nodes``, ``subroots`` and ``root`` as tables.

    The leaf of a row hashes ``columns``, the first of which is its id and the last its text; per group leaves ascend by id (nulls
    first; rows with one id by their digest, and equal rows count as often as there are), and groups ascend by name, null first.
    leaves has id, grp, digest, tampered (the leaf that lower-casing A-Z in the text would give where 3 divides the id's crc32, else null), pos, idx and
    size; an empty table has no leaves and no root.
    """
    values = [F.col(f"`{c}`") for c in columns]
    low = F.translate(values[-1].cast("string"), CAPITALS, CAPITALS.lower())
    hit = F.crc32(values[0].cast("string")) % 3 == 0
    rows = docs.select(values[0].alias("id"), field(F.col(f"`{group}`")).alias("grp"), leaf_hash(*values).alias("digest"), F.when(hit, leaf_hash(*values[:-1], low)).alias("tampered"))
    leaves = numbered(cut(rows, "merkle-leaves"), "grp", ["id", "digest"])
    leaves = cut(leaves, "merkle-numbered")
    nodes, counts = node_table(leaves, "grp")
    subs = tops(nodes, "grp").select(F.lit("all").alias("whole"), "grp", "digest", F.expr("if(grp = '-', null, substring(grp, instr(grp, ':') + 1))").alias("name"))
    subs = cut(numbered(cut(subs, "merkle-subroots"), "whole", ["name"]), "merkle-subroots")
    upper, upper_counts = node_table(subs, "whole")
    return {
        "leaves": leaves, "nodes": nodes, "subroots": with_paths(subs, upper, upper_counts, "whole"), "root": tops(upper, "whole").select("digest"),
        "proofs": with_paths(leaves, nodes, counts, "grp"),
    }


def proven(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root and verified, as :func:`manifest` orders them.

    folded_root is what a reader of the tampered row gets from the untampered siblings; verified tells whether that is the root.
    Nulls, ties and repeated rows are as in :func:`manifest`; an empty table gives no rows.
    """
    made = manifest(docs, columns, group)
    root = next((r[0] for r in made["root"].collect()), None)  # one row at most
    up = made["subroots"].select("grp", F.col("digest").alias("subroot"), F.col("idx").alias("up_idx"), F.col("size").alias("up_size"), F.col("path").alias("up_path"))
    rows = made["proofs"].join(thin(cut(up, "merkle-up")), "grp").withColumn("root", F.lit(root))
    sub = folded(F.col("path"), F.coalesce("tampered", "digest"), F.col("idx"), F.col("size"))
    rows = rows.withColumn("own_sub", sub)
    rows = rows.withColumn("folded_root", folded(F.col("up_path"), F.col("own_sub"), F.col("up_idx"), F.col("up_size")))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", "root", F.sha2(F.concat(joined(F.col("path")), joined(F.col("up_path"))), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
