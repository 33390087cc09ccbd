"""Merkle manifest of a table: a digest for every row, for every group and for the whole, with inclusion proofs.

A leaf is the SHA-256 of a row's fields, each written as its UTF-8 byte count, a
colon and the value, or `-` for null. Leaves of one group ascend by id; while
several nodes remain, every 8 consecutive ones become the SHA-256 of their
digests in hex. What remains is the group's subroot; the subroots, ordered by
group, give the root by the same rule.

Plan, all of it DataFrame functions:

1. One pass writes a leaf for each row (digests and ids only). A range sort by
   group, id and digest is written once; partition sizes turn places into ranks,
   so no task sees a whole group.
2. A rank's octal digits are columns. DIGITS of them make a block of at most
   8^DIGITS leaves; inside it they are grouped away one after another, the last
   first, children nested as structs in their parent's row. All these groupings
   keep the block's one partitioning, so there is one shuffle.
3. A block's digest is a leaf of the next tier, until one row is left in every
   group; groups are the leaves of the last tiers.
4. From the root down, each block's row meets the siblings above it (a row of
   one tier up) by grouping both on the block's place, and transform and explode
   then emit every child with its siblings: proofs cost no join, and are made
   last, where they are used.

Defined results: null fields are `-`; a null id sorts first; equal rows have
equal leaves and neighbouring places; one leaf is its own subroot, one group's
subroot its own root; an empty table has no rows. Columns beyond the fields and
the two keys are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut

ARITY_BITS = 3  # 8 children
DIGITS = 3  # of a block: 512 leaves, about 100 bytes each
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_LEVEL = "struct<before:string,after:string>"


def written(c: Column) -> Column:
    """Byte count, colon and value; `-` for null."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def leaf(fields: Sequence[Column]) -> Column:
    return digest(*(written(c) for c in fields))


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (with a column g) with rank, the place in g in the given order from 0, and n, the rows of g."""
    row = F.monotonically_increasing_id()
    rows = rows.withColumn("_in", row)  # equal rows may be many: they spread over partitions
    placed = cut(rows.orderBy(F.asc_nulls_first("g"), *(F.asc_nulls_first(c) for c in order), "_in").drop("_in").withColumn("_at", row))
    placed = placed.withColumn("_p", F.shiftright("_at", 33))
    sizes = placed.groupBy("g", "_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    of_group = Window.partitionBy("g")  # one row for each partition that has some of it
    earlier = F.sum("_n").over(of_group.orderBy("_p")) - F.col("_n")
    shift = sizes.select(F.col("g").alias("_g"), F.col("_p").alias("_q"), (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(of_group).alias("n"))
    here = F.col("g").eqNullSafe(F.col("_g")) & (F.col("_p") == F.col("_q"))
    return placed.join(shift, here).withColumn("rank", F.col("_at") + F.col("_shift")).drop("_at", "_p", "_g", "_q", "_shift")


def _node(children: Column) -> Column:
    """The digest of an ordered run of nodes; a single one of a full tree's top stays as it is (see _rolled)."""
    return F.sha2(F.array_join(F.transform(children, lambda c: c["h"]), ""), 256)


def _rolled(leaves: DataFrame, digits: int) -> DataFrame:
    """(g, block, n, h, kids): blocks of 8^digits leaves (g, rank, n, h, item) with their subtrees nested.

    n: the leaves of g. A node whose level has one node only is the top: it is
    handed up unhashed.
    """
    place = F.shiftright("rank", ARITY_BITS * digits).alias("block")
    columns = [F.shiftright("rank", ARITY_BITS * k).bitwiseAND(F.lit((1 << ARITY_BITS) - 1)).cast("int").alias(f"d{k}") for k in range(digits)]
    rows = leaves.select("g", "n", place, *columns, "h", F.col("item").alias("kids")).repartition("g", "block")
    for k in range(digits):
        left = [f"d{i}" for i in range(k + 1, digits)]
        rows = rows.groupBy("g", "block", *left).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("d"), "h", "kids"))).alias("kids"))
        whole = F.col("n") <= (1 << ARITY_BITS * k)  # the level below has one node
        rows = rows.withColumn("h", F.when(whole, F.col("kids")[0]["h"]).otherwise(_node(F.col("kids"))))
    return rows


def _siblings(kids: Column, at: Column, whole: Column) -> Column:
    """The siblings of child `at` (from 0) as a path of one level, or none where there is but one node."""
    join = lambda some: F.array_join(F.transform(some, lambda c: c["h"]), "")
    level = F.struct(join(F.slice(kids, F.lit(1), at)).alias("before"), join(F.slice(kids, at + 2, F.lit(1 << ARITY_BITS))).alias("after"))
    return F.when(whole, F.array().cast(f"array<{_LEVEL}>")).otherwise(F.array(level))


def _unrolled(blocks: DataFrame, digits: int, *keep: str) -> DataFrame:
    """keep, item, path of every leaf of blocks (g, block, n, kids, path): its siblings level by level, lowest first."""
    rows = blocks.select(*keep, "n", F.col("kids").alias("node"), "path")
    for k in reversed(range(digits)):
        whole = F.col("n") <= (1 << ARITY_BITS * k)
        below = F.transform("node", lambda c, i: F.struct(c["kids"].alias("kids"), F.concat(_siblings(F.col("node"), i, whole), F.col("path")).alias("path")))
        rows = rows.select(*keep, "n", F.explode(below).alias("x")).select(*keep, "n", F.col("x.kids").alias("node"), F.col("x.path").alias("path"))
    return rows.select(*keep, F.col("node").alias("item"), "path")


def _tiers(leaves: DataFrame, digits: int) -> list[DataFrame]:
    """Blocks (g, block, n, h, kids) of leaves (g, rank, n, h, item), blocks of these blocks, and so on up to one row a group."""
    tiers, level = [], leaves
    while True:
        tiers.append(cut(_rolled(level, digits)))
        if tiers[-1].filter("block > 0").isEmpty():
            return tiers
        n = F.shiftright(F.col("n") + F.lit((1 << ARITY_BITS * digits) - 1), ARITY_BITS * digits)
        level = tiers[-1].select("g", F.col("block").alias("rank"), n.alias("n"), "h", F.col("block").alias("item"))


def _proofs(tiers: list[DataFrame], above: DataFrame, digits: int, *keep: str) -> DataFrame:
    """g, keep, item, path of every leaf; above: g, keep and the path of each group's top."""
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, blocks in reversed(list(enumerate(tiers))):
        # a block's subtree and what stands above it meet in a group of two rows
        kinds = {f.name: f.dataType for f in [*blocks.schema, *above.schema]}
        columns = ["n", "kids", *keep, "path"]
        side = lambda df, own: df.select("g", "block", *(F.col(c) if c in own else F.lit(None).cast(kinds[c]).alias(c) for c in columns))
        both = side(blocks, ("n", "kids")).unionByName(side(above, (*keep, "path")))
        met = both.groupBy("g", "block").agg(*(F.first(c, ignorenulls=True).alias(c) for c in columns))
        above = _unrolled(met, digits, "g", *keep)
        if k:
            above = above.select("g", F.col("item").alias("block"), *keep, "path")
    return above


def manifest(docs: DataFrame, fields: Sequence[str] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", tampered: Column | None = None, digits: int = DIGITS) -> DataFrame:
    """doc_id, leaf, other, subroot, root and path of every row.

    path: siblings level by level, lowest first, each level as what stands
    `before` and `after` the node itself, in hex. other: the leaf of the row with
    its text replaced by `tampered`, null where that is null.
    """
    changed = F.lit(None).cast("string")
    if tampered is not None:
        changed = F.when(tampered.isNotNull(), leaf([tampered if c == "text" else F.col(c) for c in fields]))
    leaves = cut(docs.select(F.col(group_col).cast("string").alias("g"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("h"), changed.alias("other")))
    ranked = _ranked(leaves, ["id", "h"]).select("g", "rank", "n", "h", F.struct("id", "h", "other").alias("item"))
    tiers = _tiers(ranked, digits)

    groups = _ranked(tiers[-1].select(F.lit("").alias("g"), F.col("g").alias("name"), "h"), ["name"])
    upper = _tiers(groups.select("g", "rank", "n", "h", F.struct("name", "h").alias("item")), digits)
    top = upper[-1].select("g", F.col("h").alias("root"), F.array().cast(f"array<{_LEVEL}>").alias("path"))
    tops = _proofs(upper, top, digits, "root").select(F.col("item.name").alias("g"), F.col("item.h").alias("subroot"), "root", "path")
    found = _proofs(tiers, cut(tops), digits, "subroot", "root")
    return found.select(F.col("item.id").alias("doc_id"), F.col("item.h").alias("leaf"), F.col("item.other").alias("other"), "subroot", "root", "path")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda h, level: digest(level["before"], h, level["after"]))


def verify(proofs: DataFrame) -> DataFrame:
    """proofs (see manifest) with folded_root, from the tampered leaf where there is one, and verified."""
    root = folded(F.coalesce("other", "leaf"), F.col("path"))
    return proofs.withColumn("folded_root", root).withColumn("verified", F.col("folded_root") == F.col("root"))


def proof_digest(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["before"], level["after"])), ""), 256)


def report(docs: DataFrame) -> DataFrame:
    """The digests of manifest() over documents, where every third text is tampered with: its A-Z lower-cased."""
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    proofs = manifest(docs, tampered=F.when(third, lower_ascii(F.col("text"))))
    return verify(proofs).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")
