"""Merkle dataset manifest by sibling-shift self-joins.

Every row is a leaf: the digest of its columns.  The leaves of a group (one
tree) are numbered in order without gathering a group in one task; then each
level joins its nodes with themselves on the computed index of a sibling (XOR
for two to a run, slot offsets otherwise), and the rows of slot zero emit the
parents.  The roots of the trees are the leaves of one more tree.  On the way
down each node hands its children the siblings above them, so that every leaf
gets its proof by one join a level.

H is the lowercase hex sha256 of its inputs, digests as hex text.  A column
counts as ``-`` if null, else as its UTF-8 byte count, ``:`` and its value.
Trees are ordered by group (null first, then UTF-8 bytewise), leaves by id (null
first); rows that share an id by digest, so equal rows are interchangeable.  A
node without siblings is hashed alone; a tree of one leaf has that leaf as its
root.  An empty table has no trees and gives no rows.  Other columns are not
read.  All in DataFrame functions; each level is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trawl.session import bounded_broadcast, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
REST = 8  # levels of one downward job


def digest(*parts: Column) -> Column:
    """sha256 of the concatenated parts, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def as_hex(col) -> Column:
    return F.lower(F.hex(col))


def leaf(columns=COLUMNS, **changed: Column) -> Column:
    """Digest of a row; ``changed`` replaces columns by expressions."""
    parts = []
    for c in columns:
        s = changed.get(c, F.col(c)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return digest(*parts)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` plus ``idx``, the place in its ``tree`` by ``order``, and ``n``, the
    tree's size.  Range partitions number their own rows; where a tree begins in
    a partition is a running sum over one row a partition and tree."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    marked = materialize(dealt.withColumn("_at", F.monotonically_increasing_id())
                         .withColumn("_part", F.shiftright("_at", 33)), "numbered")
    runs = materialize(marked.groupBy("_part", "tree").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n")), "runs")
    w = Window.partitionBy("tree")
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs.select("_part", "tree", F.sum("_n").over(w).alias("n"),
                         (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_base"))
    width = runs.agg(F.max(F.octet_length("tree"))).first()[0] or 0
    return marked.join(bounded_broadcast(placed, runs.count(), 64 + width), ["_part", "tree"]) \
        .withColumn("idx", F.col("_at") + F.col("_base")).drop("_part", "_at", "_base")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Nodes (tree, idx, n, h, ...) plus ``beside``: a byte with the node's slot, then
    its siblings' digests in slot order; and ``up``, the digest of the whole run."""
    slot, out = F.col("idx") % arity, nodes
    for d in range(1, arity):
        # the node that finds this one d slots further on
        seeker = F.col("idx").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("idx") - slot + F.pmod(slot - d, F.lit(arity))
        out = out.join(nodes.select("tree", seeker.alias("idx"), F.col("h").alias(f"_s{d}")), ["tree", "idx"], "left")
    near, none = F.array(*[f"_s{d}" for d in range(1, arity)]), F.lit(b"")
    beside = [F.coalesce(F.get(near, (F.pmod(j - slot, F.lit(arity)) - 1).cast("int")), none) for j in range(arity)]
    mark = F.unhex(F.lpad(F.hex(slot), 2, "0"))
    run = digest(as_hex("h"), *[F.coalesce(as_hex(f"_s{d}"), F.lit("")) for d in range(1, arity)])
    return out.withColumn("beside", F.concat(mark, *beside)) \
        .withColumn("up", F.when(slot == 0, run)).drop(*[f"_s{d}" for d in range(1, arity)])


def climb(leaves: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels with siblings, leaves first, and the trees' roots (tree, level, h)."""
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels, roots = leaves, [], []
    while True:
        roots.append(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "h"))
        if most <= 1:
            break
        levels.append(materialize(with_siblings(nodes.where("n > 1"), arity), f"level_{len(levels)}"))
        nodes = levels[-1].where("up IS NOT NULL").select(
            "tree", F.expr(f"idx div {arity}").alias("idx"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"),
            F.col("up").alias("h"))
        most = -(-most // arity)
    every = roots[0]
    for r in roots[1:]:
        every = every.union(r)
    return levels, materialize(every, "roots")


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int, keep: list[str]) -> DataFrame:
    """``keep`` columns of the leaves plus ``path``, the ``beside`` of every level from
    the leaf up, followed by the path in ``tops`` (tree, level, path, ...), whose
    other columns are handed down."""
    more = [c for c in tops.columns if c not in ("tree", "level", "path")]
    heights = {r[0] for r in tops.select("level").distinct().collect()}
    paths = None
    for k in range(len(levels), -1, -1):
        here = []
        if paths is not None:  # children of the level above
            own = keep if k == 0 else []
            here.append(levels[k].select("tree", "idx", F.expr(f"idx div {arity}").alias("_up"), "beside", *own)
                        .join(paths.withColumnRenamed("idx", "_up"), ["tree", "_up"])
                        .select("tree", "idx", F.concat(F.array("beside"), "path").alias("path"), *more, *own))
        if k in heights:
            t = tops.where(F.col("level") == k).drop("level")
            if k == 0:
                here.append(leaves.where("n = 1").join(t, "tree").select("tree", "idx", "path", *more, *keep))
            else:
                here.append(t.select("tree", F.lit(0).cast("long").alias("idx"), "path", *more))
        if here:
            paths = here[0] if len(here) == 1 else here[0].unionByName(here[1])
            if k and k % REST == 0:
                paths = materialize(paths, "paths")
    return paths.select(*keep, "path", *more)


def proof(path) -> Column:
    """The siblings of a path, hex, left to right."""
    return F.array_join(F.transform(path, lambda s: as_hex(F.substring(s, 2, 1 << 30))), "")


def folded(start, path) -> Column:
    """The root that a leaf's digest and its path give, as 32 bytes."""
    def step(acc, s):
        cut = F.conv(F.hex(F.substring(s, 1, 1)), 16, 10).cast("int") * 32
        left = F.call_function("substring", s, F.lit(2), cut)
        right = F.call_function("substring", s, cut + 2, F.lit(1 << 30))
        return digest(as_hex(left), as_hex(acc), as_hex(right))

    return F.aggregate(path, F.col(start), step)


def manifest(docs: DataFrame, columns=COLUMNS, tree: str = "lang", order: str = "doc_id", arity: int = 2,
             probe: Column | None = None) -> DataFrame:
    """(order, leaf, probe, path, subroot, root) of every row: digests of 32 bytes
    and the path as slots with siblings.  ``probe`` is the digest to be verified,
    the leaf itself unless given."""
    if not 2 <= arity <= 256:
        raise ValueError("a run holds 2 to 256 nodes")
    key = F.coalesce(F.concat(F.lit("1"), F.col(tree).cast("string")), F.lit("0"))
    rows = materialize(docs.select(key.alias("tree"), F.col(order).alias("id"), leaf(columns).alias("h"),
                                   (leaf(columns) if probe is None else probe).alias("probe"),
                                   F.monotonically_increasing_id().alias("row")), "leaves")
    leaves = numbered(rows, "id", "h", "row").select("tree", "idx", "n", "h", "id", "probe")
    levels, roots = climb(leaves, arity)
    # the roots are the leaves of the last tree
    tops = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("key"), "level", "h"), "key")
    tops = materialize(tops, "subroots")
    above, root = climb(tops, arity)
    last = root.withColumn("path", F.array().cast("array<binary>")).withColumnRenamed("h", "root")
    placed = materialize(descend(tops, above, last, arity, ["key", "level", "h"]) if root.count() else
                         tops.selectExpr("key", "level", "h", "CAST(array() AS array<binary>) AS path", "h AS root"), "tops")
    placed = placed.select(F.col("key").alias("tree"), "level", "path", F.col("h").alias("subroot"), "root")
    if not placed.count():
        return leaves.selectExpr(f"id AS `{order}`", "h AS leaf", "probe", "CAST(array() AS array<binary>) AS path",
                                 "h AS subroot", "h AS root")
    return descend(leaves, levels, placed, arity, ["id", "h", "probe"]).select(
        F.col("id").alias(order), F.col("h").alias("leaf"), "probe", "path", "subroot", "root")


def verified(rows: DataFrame) -> DataFrame:
    """A manifest's rows with hex digests, proof_sha256, folded_root and verified."""
    out = rows.withColumn("folded", folded("probe", F.col("path")))
    first = [c for c in rows.columns if c not in ("leaf", "probe", "path", "subroot", "root")]
    return out.select(*first, *[as_hex(c).alias(c) for c in ("leaf", "subroot", "root")],
                      F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), as_hex("folded").alias("folded_root"),
                      (F.col("folded") == F.col("root")).alias("verified"))


def tampered(columns=COLUMNS) -> Column:
    """Digest of a row with 1 added to n_chars where 7 divides crc32 of the id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return F.when(hit & F.col("n_chars").isNotNull(), leaf(columns, n_chars=F.col("n_chars") + 1)).otherwise(leaf(columns))
