"""A Merkle manifest of a dataset: trees of hashes by group, a tree over their roots, and each row's proof.

Leaves are numbered within their tree by one range sort of narrow rows; a tree of any size is spread over all tasks.
The levels go bottom-up, each a table in the shared folder: a node is the hash of up to ``fan`` consecutive ones below
and keeps them as ``kids``. Then proofs go top-down: a level joins the paths of its nodes, and every kid puts its own
siblings before the path that it inherits. So the proof of a leaf is made only where the leaf is, of a path that its
parent's eighth of the rows carries. Groups, however many, never meet on the driver; only the root does.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: left and right are the digests of the siblings before and after, joined; one entry a level, from below.
PATH = "array<struct<left:string,right:string>>"
Stage = Callable[[DataFrame, str], DataFrame]


def digest(values: list[Column]) -> Column:
    """Lowercase hex sha256 of the values, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def numbered(rows: DataFrame, order: list[str], stage: Stage, name: str) -> DataFrame:
    """idx (from 0) and n: the place of a row in its ``tree`` by ``order``, and the tree's size.

    One range sort, then counts by task and tree; no tree meets in one task. ``order`` has to be total.
    """
    tasks = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pos = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    ranged = rows.repartitionByRange(tasks, "tree", *order).sortWithinPartitions("tree", *order)
    ranged = stage(ranged.select("*", F.spark_partition_id().alias("part"), pos.alias("pos")), name)
    counts = ranged.groupBy("part", "tree").agg(F.count("*").alias("rows"), F.min("pos").alias("first"))
    w = W.partitionBy("tree")
    before = F.sum("rows").over(w.orderBy("part")) - F.col("rows") - F.col("first")
    starts = stage(counts.select("part", "tree", before.alias("shift"), F.sum("rows").over(w).alias("n")), f"{name}_starts")  # so that its size is known
    return ranged.join(starts, ["part", "tree"]).withColumn("idx", F.col("pos") + F.col("shift")).drop("part", "pos", "shift")


def levels(nodes: DataFrame, fan: int, stage: Stage, name: str, keep: list[str] = ()) -> list[DataFrame]:
    """The levels above ``nodes`` (tree, idx, n, digest), each a staged table of tree, idx, n, digest, kids.

    kids are in order and carry the ``keep`` columns of the nodes in the first level. A tree stops at one node.
    """
    found, most = [], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        kid = F.struct("idx", "digest", *(keep if not found else ()))
        place = [F.expr(f"idx div {fan}").alias("idx"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n")]
        up = nodes.where("n > 1").groupBy("tree", *place).agg(F.sort_array(F.collect_list(kid)).alias("kids"))  # fan kids at most
        nodes = stage(up.withColumn("digest", F.sha2(_joined(F.col("kids.digest")), 256)), f"{name}_{len(found) + 1}")
        found.append(nodes)
        most = -(-most // fan)
    return found


def roots(nodes: DataFrame, above: list[DataFrame]) -> DataFrame:
    """tree, depth and digest of the node that remains of each tree."""
    out = None
    for depth, level in enumerate([nodes, *above]):
        top = level.where("n = 1").select("tree", F.lit(depth).alias("depth"), "digest")
        out = top if out is None else out.unionByName(top)
    return out


def pushed(above: list[DataFrame], tops: DataFrame, stage: Stage, name: str) -> DataFrame:
    """The lowest nodes of trees that have a level above them: tree, the tops' other columns, kid and path.

    ``tops`` are tree, depth, path and columns that every node of the tree inherits.
    """
    rest = [c for c in tops.columns if c not in ("tree", "depth", "path")]
    above_it = None
    for depth in range(len(above), 0, -1):
        paths = tops.where(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("idx"), "path", *rest)
        paths = paths if above_it is None else paths.unionByName(above_it)
        joined = above[depth - 1].select("tree", "idx", "kids").join(paths, ["tree", "idx"])
        each = joined.select("tree", *rest, "path", "kids", F.posexplode("kids").alias("at", "kid"))
        own = F.struct(_joined(F.slice("kids.digest", 1, F.col("at"))).alias("left"), _joined(F.slice("kids.digest", F.col("at") + 2, F.size("kids"))).alias("right"))
        each = each.select("tree", *rest, "kid", F.concat(F.array(own), F.col("path")).cast(PATH).alias("path"))
        if depth == 1:
            return each
        above_it = stage(each.select("tree", F.col("kid.idx").alias("idx"), "path", *rest), f"{name}_{depth - 1}")
    return None


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda got, p: F.sha2(F.concat(p["left"], got, p["right"]), 256))


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf to the root and left to right."""
    return F.sha2(_joined(F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def prove(leaves: DataFrame, group: str, order: list[str], stage: Stage, fan: int = 8, keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` with leaf, subroot, root and path for every row of ``leaves``.

    Leaves of a ``group`` ascend by ``order`` (nulls first), then by their hash; rows alike in all of that are
    exchangeable. Every ``fan`` consecutive nodes become the hash of their digests until one remains, the group's
    subroot. Subroots, by group in bytewise order with null first, give the root likewise. A null group is a group; an
    empty table gives no rows.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))  # "-" comes before "="
    rows = leaves.select(tree.alias("tree"), F.col("leaf").alias("digest"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*keep).alias("own"), F.monotonically_increasing_id().alias("nth"))
    rows = stage(rows, "leaves")
    nodes = stage(numbered(rows, [*[f"o{i}" for i in range(len(order))], "digest", "nth"], stage, "sorted").select("tree", "idx", "n", "digest", "own"), "level_0")
    above = levels(nodes, fan, stage, "level", ["own"])
    subroots = stage(roots(nodes, above), "subroots")

    top = subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("of"), "depth")
    top = stage(numbered(top, ["of"], stage, "ranked").select("tree", "idx", "n", "digest", F.struct("of", "depth").alias("own")), "top_0")
    over = levels(top, fan, stage, "top", ["own"])
    found = roots(top, over).select("digest").first()
    root, none = F.lit(found[0] if found else ""), F.array().cast(PATH)
    flat = lambda kid: [kid["own"]["of"].alias("tree"), kid["own"]["depth"].alias("depth"), kid["digest"].alias("subroot")]
    if over:
        seed = leaves.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(len(over)).alias("depth"), none.alias("path"))
        tops = pushed(over, seed, stage, "top_path").select(*flat(F.col("kid")), "path")
    else:  # one group, whose subroot is the root
        tops = top.select(*flat(F.struct("own", "digest")), none.alias("path"))
    tops = stage(tops, "tops")

    alone = nodes.where("n = 1").join(tops, "tree").select("own.*", F.col("digest").alias("leaf"), "subroot", "path")
    out = alone if not above else alone.unionByName(pushed(above, tops, stage, "path").select("kid.own.*", F.col("kid.digest").alias("leaf"), "subroot", "path"))
    return out.withColumn("root", root)


def verify(docs: DataFrame, stage: Stage, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", id_col: str = "doc_id", text_col: str = "text", every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row, against a tampered copy.

    Rows whose id's crc32 ``every`` divides (none without an id) have the text's A-Z in lower case in the copy;
    folded_root is what the copy's leaf and the manifest's proof give, and verified whether that is the root. Null
    cells are part of a leaf; repeated rows are leaves of their own, exchangeable in the order; other columns don't
    matter; an empty table gives no rows.
    """
    altered = F.translate(F.col(text_col), string.ascii_uppercase, string.ascii_lowercase)
    cells = [F.col(c) for c in columns]
    drawn = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % every == 0, F.lit(False))
    changed = drawn & F.col(text_col).rlike("[A-Z]")
    copy = F.when(changed, digest([altered if c == text_col else F.col(c) for c in columns]))
    leaves = docs.select(F.col(id_col).alias("doc_id"), F.col(group).cast("string").alias("group"), digest(cells).alias("leaf"), copy.alias("copy"))
    proved = prove(leaves, "group", ["doc_id"], stage, keep=["doc_id", "copy"])
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("copy", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
