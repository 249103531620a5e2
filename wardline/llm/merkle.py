"""Merkle manifest of a dataset: siblings meet by equi-joins on computed indices, slot-zero rows emit parents.

DataFrame functions only. Per leaf, 32 bytes travel up the tree and the sibling digests of its path, shared by
the leaves of a run, travel down.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import Scratch, ascii_lower

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 32  # bytes; digests are hashed as 64 hexadecimal digits


def hex_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of values, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return digest_of(F.concat(*parts))


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> DataFrame:
    """The rows with ``idx``, their place within the group, and ``n``, the rows of the group.

    Rows are cut into sorted ranges; a place is the place within the range plus the rows that the group has in
    earlier ranges. So a group of any size is spread, and what is summed up is one row per group and range.
    Equal rows are told apart by where they stood, which spreads them too.
    """
    placed = scratch.keep(rows.withColumn("_tie", F.monotonically_increasing_id()))
    keys = [group, *order, "_tie"]
    ranged = scratch.keep(placed.repartitionByRange(*keys).sortWithinPartitions(*keys)
                          .withColumn("_at", F.monotonically_increasing_id()).drop("_tie")
                          .withColumn("_range", F.shiftright("_at", 33)))
    counts = ranged.groupBy(group, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_from"))
    before = Window.partitionBy(group).orderBy("_range")
    offsets = scratch.keep(counts.select(
        group, "_range", "_from", (F.sum("_rows").over(before) - F.col("_rows")).alias("_before"),
        F.sum("_rows").over(Window.partitionBy(group)).alias("n")))
    scratch.drop(placed)
    return (ranged.join(offsets, [group, "_range"])
            .withColumn("idx", F.col("_at") - F.col("_from") + F.col("_before"))
            .drop("_at", "_range", "_from", "_before"))


def runs_of(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(grp, run, n, nodes, digest): per run of consecutive nodes their digests in order and their parent's digest.

    The node at slot zero looks up its siblings, those at ``fanout * run + 1`` and so on, with one equi-join for
    each slot. ``n`` becomes the number of parents of the group.
    """
    at = nodes.select("grp", "n", "digest", F.floor(F.col("idx") / fanout).alias("run"),
                      F.pmod("idx", F.lit(fanout)).alias("slot"))
    joined = at.where("slot = 0").select("grp", "run", "n", F.col("digest").alias("d0"))
    for slot in range(1, fanout):
        sibling = at.where(F.col("slot") == slot).select("grp", "run", F.col("digest").alias(f"d{slot}"))
        joined = joined.join(sibling, ["grp", "run"], "left")
    digests = F.concat(*[F.coalesce(f"d{slot}", F.lit(b"")) for slot in range(fanout)])
    return (joined.select("grp", "run", F.ceil(F.col("n") / fanout).alias("n"), digests.alias("nodes"))
            .withColumn("digest", digest_of(hex_of(F.col("nodes")))))


def climb(nodes: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, leaves first, and (grp, digest) of the tops, one per group.

    ``nodes`` has grp, idx, n, digest. A group that is down to one node takes no part in further levels.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    levels, tops = [], nodes.where("n = 1").select("grp", "digest")
    while most > 1:
        runs = scratch.keep(runs_of(nodes.where("n > 1"), fanout))
        levels.append(runs)
        nodes = runs.select("grp", F.col("run").alias("idx"), "n", "digest")
        tops = tops.unionByName(nodes.where("n = 1").select("grp", "digest"))
        most = -(-most // fanout)
    return levels, tops


def descend(levels: list[DataFrame], tops: DataFrame, scratch: Scratch, fanout: int = FANOUT) -> DataFrame:
    """(grp, run, path): per run of the lowest level what leads from its nodes to the root, and ``top``.

    ``tops`` has grp, top (a digest) and path, the way from the top on. A path is an array of (nodes, slot): the
    digests of a run and the slot of the way there. In its first entry the slot is still open. A path is joined to
    the runs below it, so it is stored once for ``fanout`` nodes. Runs of level 0 only; groups of one node have none.
    """
    above = None
    for number in reversed(range(len(levels))):
        level = levels[number]
        step = F.array(F.struct("nodes", F.lit(None).cast("int").alias("slot")))
        first = (level.where("n = 1").join(tops, "grp")
                 .select("grp", "run", "top", F.concat(step, "path").alias("path")))
        if above is not None:
            slot = F.pmod("run", F.lit(fanout)).cast("int")
            upper = above.select("grp", F.col("run").alias("_up"), "top", F.col("path").alias("_path"))
            taken = F.transform("_path", lambda s, i: F.when(i == 0, F.struct(
                s["nodes"].alias("nodes"), F.col("_slot").alias("slot"))).otherwise(s))
            lower = (level.where("n > 1").withColumn("_slot", slot)
                     .withColumn("_up", F.floor(F.col("run") / fanout)).join(upper, ["grp", "_up"])
                     .select("grp", "run", "top", F.concat(step, taken).alias("path")))
            first = first.unionByName(lower)
        above = scratch.keep(first)
    return above


def _slot_in(path: Column, slot: Column) -> Column:
    """A path whose first entry gets its slot."""
    return F.transform(path, lambda s, i: F.when(i == 0, F.struct(
        s["nodes"].alias("nodes"), slot.cast("int").alias("slot"))).otherwise(s))


def _left(step: Column) -> Column:
    return hex_of(F.substring(step["nodes"], F.lit(1), step["slot"] * DIGEST))


def _right(step: Column) -> Column:
    return hex_of(F.substring(step["nodes"], (step["slot"] + 1) * DIGEST + 1, F.octet_length(step["nodes"])))


def proof_text(path: Column) -> Column:
    """The sibling digests of a path as text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(_left(s), _right(s))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf digest and the siblings of a path give, as hexadecimal text."""
    return F.aggregate(path, hex_of(leaf), lambda h, s: F.sha2(F.concat(_left(s), h, _right(s)), 256))


def manifest(rows: DataFrame, leaf: Column, order: str = "doc_id", group: str = "lang", fanout: int = FANOUT,
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: (id, leaf, subroot, root, path) and the columns of ``carry``, computed on the input.

    ``leaf`` is a 32-byte digest. Leaves of a group ascend by ``order``, ties by their digest; while several nodes
    remain, every ``fanout`` consecutive ones become the digest of their hexadecimal digests. What remains is the
    subroot; subroots ordered by group, null first and else by UTF-8 bytes, give the root likewise. A path holds
    what ``proof_text`` and ``folded`` need. A null ``order`` comes first, so does a null group, which is a group of
    its own; equal rows stand next to each other and have paths of their own; a lone leaf is its subroot, a lone
    subroot the root, and its path is shorter or empty; an empty table gives no rows. Extra columns play no part.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    grp = F.when(F.col(group).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    own = [column.alias(f"c_{name}") for name, column in (carry or {}).items()]
    leaves = rows.select(F.col(order).cast("long").alias("id"), grp.alias("grp"), leaf.alias("digest"), *own)
    nodes = scratch.keep(numbered(leaves, "grp", ["id", "digest"], scratch))
    levels, tops = climb(nodes.select("grp", "idx", "n", "digest"), scratch, fanout)

    groups = numbered(tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), F.col("digest")),
                      "all", ["name"], scratch)
    subroots = scratch.keep(groups.select(F.col("all").alias("grp"), "name", "idx", "n", "digest"))
    outer, summit = climb(subroots.select("grp", "idx", "n", "digest"), scratch, fanout)
    top = summit.first()  # one row: the root
    root = F.lit(None).cast("string") if top is None else F.lit(bytes(top["digest"]).hex())
    none = F.array().cast("array<struct<nodes:binary,slot:int>>")
    named = subroots.select(F.col("name").alias("grp"), F.col("digest").alias("top"), "idx")
    if outer:
        ways = descend(outer, summit.select("grp", F.col("digest").alias("top"), none.alias("path")), scratch, fanout)
        ways = ways.select(F.col("run"), "path")
        named = (named.withColumn("run", F.floor(F.col("idx") / fanout)).join(ways, "run")
                 .select("grp", "top", _slot_in(F.col("path"), F.pmod("idx", F.lit(fanout))).alias("path")))
    else:
        named = named.select("grp", "top", none.alias("path"))
    named = scratch.keep(named)

    own_names = [f"c_{name}" for name in (carry or {})]
    single = nodes.where("n = 1").join(named, "grp").select("id", "digest", *own_names, "top", "path")
    found = single
    if levels:
        ways = descend(levels, named, scratch, fanout)
        several = (nodes.where("n > 1").withColumn("run", F.floor(F.col("idx") / fanout)).join(ways, ["grp", "run"])
                   .select("id", "digest", *own_names, "top",
                           _slot_in(F.col("path"), F.pmod("idx", F.lit(fanout))).alias("path")))
        found = several.unionByName(single)
    return found.select("id", F.col("digest").alias("leaf"), F.col("top").alias("subroot"), root.alias("root"), "path",
                        *[F.col(f"c_{name}").alias(name) for name in (carry or {})])


def document_leaf(text: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a document with a given text."""
    return leaf_digest([text if field == "text" else F.col(field) for field in fields])


def lowered(text: Column) -> Column:
    """A change to test a manifest with: A-Z in lower case, nulls as they are."""
    return ascii_lower(text)
