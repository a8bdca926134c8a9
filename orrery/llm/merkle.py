"""Merkle manifest of a dataset: levels are built bottom-up and stored, proofs are pushed top-down through them.

The leaves of each group, in order, are the lowest level of a binary tree; the groups' roots, in order, are the leaves of one more tree
above them. Levels are stored in strata of `STRATUM` binary levels: a row of a stratum is a node with all that is below it down to the
stratum's foot, so that a tree of n leaves takes log2(n) / STRATUM shuffles of shrinking tables. Proofs go down by joining a stratum's
rows to their parents': each child takes the siblings on its way through the row, and after them the proof that its parent has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.llm.common import new_folder, placed, shared_table

#: Binary levels in a stratum: its rows hold 2^STRATUM children at most.
STRATUM = 6
WIDTH = 1 << STRATUM


def digest(*inputs: Column) -> Column:
    """Lowercase hex SHA-256 of the inputs' texts, one after another."""
    return F.sha2(F.concat(*inputs), 256)


def field_text(value: Column) -> Column:
    """A field as a leaf holds it: its UTF-8 bytes' number, a colon and its text, or a dash if it is null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """The leaf of a row with these fields."""
    return digest(*map(field_text, values))


def _level_above(level: Column) -> Column:
    """The nodes above a level within a stratum's row: every two consecutive ones become their digest, a last one alone its own."""
    places = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
    return F.transform(places, lambda i: digest(F.get(level, 2 * i), F.coalesce(F.get(level, 2 * i + 1), F.lit(""))))


def _stratum(nodes: DataFrame) -> DataFrame:
    """Rows (grp, above, n, children, levels) of nodes (grp, pos, n, hash, content): `levels` has the row's binary levels from its
    children's on, the last of one node alone. A tree with more nodes than a row holds goes up by all levels of the stratum, the last
    row too; one that fits in a row ends where one node is left."""
    rows = nodes.groupBy("grp", F.shiftright("pos", STRATUM).alias("above"), "n").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "content"))).alias("children"))
    size = F.size("children")
    height = F.when(F.col("n") > WIDTH, F.lit(STRATUM)).when(size > 1, F.length(F.bin(size - 1))).otherwise(F.lit(0))
    foot = F.array(F.transform("children", lambda c: c["hash"]))
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("levels", F.aggregate(steps, foot, lambda levels, _: F.concat(levels, F.array(_level_above(F.element_at(levels, -1))))))


@dataclass
class Tree:
    """Strata of the trees of all groups, from the leaves up, and the groups' roots (grp, hash, top: the stratum in which each ended)."""

    strata: list[DataFrame]
    roots: DataFrame


def _grow(nodes: DataFrame, path: str) -> Tree:
    """Store the strata above the nodes (grp, pos, n, hash, content) below `path`."""
    spark = nodes.sparkSession
    strata, roots = [], None
    while True:
        at = f"{path}/{len(strata)}"
        rows = _stratum(nodes)
        rows.write.parquet(at)
        rows = spark.read.schema(rows.schema).parquet(at)
        strata.append(rows)
        top = rows.select("grp", F.col("above").alias("pos"), "n", F.element_at("levels", -1)[0].alias("hash"))
        ended = top.where(F.col("n") <= WIDTH).select("grp", "hash", F.lit(len(strata) - 1).alias("top"))
        roots = ended if roots is None else roots.unionByName(ended)
        above = top.where(F.col("n") > WIDTH)
        if above.isEmpty():
            return Tree(strata, roots)
        nodes = above.select("grp", "pos", F.ceil(F.col("n") / WIDTH).cast("long").alias("n"), "hash", F.lit(None).cast("string").alias("content"))


def _siblings(levels: Column, place: Column) -> Column:
    """The way of a child up through its row: at each level its sibling's digest after L or R, the side on which it stands, or nothing
    if it stands alone."""

    def step(k: Column) -> Column:
        at = F.call_function("shiftright", place, k)  # the literal's function takes no column
        other = F.get(F.get(levels, k), at.bitwiseXOR(F.lit(1)))
        return F.coalesce(F.concat(F.when(at % 2 == 1, F.lit("L")).otherwise(F.lit("R")), other), F.lit(""))

    ways = F.sequence(F.lit(0), F.size(levels) - 2)
    return F.when(F.size(levels) > 1, F.transform(ways, step)).otherwise(F.array().cast("array<string>"))


def _push(tree: Tree, proofs: DataFrame) -> DataFrame:
    """Rows (grp, pos, content, hash, proof) of all leaves: `proofs` (grp, top, proof) has that of each group's root."""
    children = None
    for k in range(len(tree.strata) - 1, -1, -1):
        parents = proofs.where(F.col("top") == k).select(F.col("grp").alias("p_grp"), F.lit(0).cast("long").alias("p_above"), "proof")
        if children is not None:
            parents = parents.unionByName(children.select(F.col("grp").alias("p_grp"), F.col("pos").alias("p_above"), "proof"))
        joined = tree.strata[k].join(parents, F.col("grp").eqNullSafe(F.col("p_grp")) & (F.col("above") == F.col("p_above")))
        way = lambda c, i: F.struct(c["pos"].alias("pos"), c["content"].alias("content"), c["hash"].alias("hash"), F.concat(_siblings(F.col("levels"), i), F.col("proof")).alias("proof"))
        children = joined.select("grp", F.inline(F.transform("children", way)))
    return children


@dataclass
class Manifest:
    """A stored manifest: the groups' trees, the tree above them, and where they are."""

    path: str
    groups: Tree
    above: Tree

    def root(self) -> str | None:
        """The dataset's digest; none of an empty one."""
        row = self.above.roots.select("hash").first()
        return row[0] if row else None

    def subroots(self) -> DataFrame:
        """Rows (grp, subroot)."""
        return self.groups.roots.select("grp", F.col("hash").alias("subroot"))


def build_manifest(leaves: DataFrame, group: str, order: str, path: str | None = None) -> Manifest:
    """Build and store the manifest of `leaves`: a column `leaf` (the digest), the group's and the order's columns, and any others,
    which come back with the proofs.

    Leaves ascend by the order's column in their group (null first, then by digest and place of reading: repeated rows are leaves of
    their own). Groups ascend likewise, null first, strings bytewise. Empty tables have no root. A group of a third of all rows is
    sorted and hashed in as many tasks as its size asks for.
    """
    path = path or f"{new_folder(leaves.sparkSession)}/manifest"
    content = F.struct(*[F.col(f"`{c}`") for c in leaves.columns if c != "leaf"])
    rows = shared_table(leaves.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{order}`").alias("at"), F.col("leaf").alias("hash"), content.alias("content"), F.monotonically_increasing_id().alias("row")), "leaves")
    groups = _grow(placed(rows, ["grp"], ["at", "hash", "row"]).select("grp", "pos", "n", "hash", "content"), f"{path}/groups")
    tops = shared_table(groups.roots, "subroots")
    ordered = placed(tops, [], ["grp"]).select(F.lit(0).alias("grp"), "pos", "n", "hash", F.col("grp").alias("content"))
    return Manifest(path, Tree(groups.strata, tops), _grow(ordered, f"{path}/above"))


def open_manifest(spark: SparkSession, path: str) -> Manifest:
    """A manifest that build_manifest() stored."""

    def tree(at: str) -> Tree:
        folder = spark._jvm.org.apache.hadoop.fs.Path(at)
        files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
        strata = [spark.read.parquet(f"{at}/{k}") for k in range(len(files))]
        ended = [s.where(F.col("n") <= WIDTH).select("grp", F.element_at("levels", -1)[0].alias("hash"), F.lit(k).alias("top")) for k, s in enumerate(strata)]
        roots = ended[0]
        for e in ended[1:]:
            roots = roots.unionByName(e)
        return Tree(strata, roots)

    return Manifest(path, tree(f"{path}/groups"), tree(f"{path}/above"))


def proofs(manifest: Manifest) -> DataFrame:
    """All leaves with their columns, `leaf`, `root` and `proof`: the siblings from the leaf's level up to the root, each after the
    side on which it stands (L or R), empty where the node stood alone."""
    none = F.array().cast("array<string>")
    roots = manifest.above.roots.select("grp", "top", none.alias("proof"), F.col("hash").alias("root"))
    pushed = _push(manifest.above, roots).select(F.col("content").alias("of"), "proof")
    tops = manifest.groups.roots.join(pushed, F.col("grp").eqNullSafe(F.col("of"))).select("grp", "top", "proof")
    out = _push(manifest.groups, tops)
    root = F.lit(manifest.root()).cast(T.StringType())
    return out.select("content.*", F.col("hash").alias("leaf"), "proof", root.alias("root"))


def proof_digest(proof: Column) -> Column:
    """The digest of a proof's siblings, one after another."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.substring(s, 2, 64)), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    other = lambda s: F.substring(s, 2, 64)
    step = lambda node, s: F.when(s.startswith("L"), digest(other(s), node)).when(s.startswith("R"), digest(node, other(s))).otherwise(digest(node))
    return F.aggregate(proof, leaf, step)


def changed_rows(manifest: Manifest, leaves: DataFrame, order: str) -> DataFrame:
    """Rows (order, leaf, side) in which a dataset's leaves differ from a manifest's: `missing` ones are the manifest's alone, `added`
    ones the dataset's alone; a changed row is both. Repeated rows count as often as they are there. An empty table has all missing."""
    kept = manifest.groups.strata[0].select(F.explode("children").alias("c")).select(F.col(f"c.content.`{order}`").alias("id"), F.col("c.hash").alias("leaf"), F.lit(1).alias("k"))
    here = leaves.select(F.col(f"`{order}`").alias("id"), "leaf", F.lit(-1).alias("k"))
    left = kept.unionByName(here).groupBy("id", "leaf").agg(F.sum("k").alias("k")).where("k <> 0")
    return left.select(F.col("id").alias(order), "leaf", F.when(F.col("k") > 0, "missing").otherwise("added").alias("side"), F.abs("k").alias("n"))
