"""A Merkle manifest of a table: one tree per source and one over the sources, with proofs for single rows.

Checkpoint and recompute: of a tree's levels only every third is stored. A proof needs siblings of the levels between; they are made anew
from the stored nodes of the aligned subtree they lie in (at most 27), and nothing of them is kept. So the manifest takes
1/26 more nodes than leaves, and a subtree is the most that a task holds of a tree, however large a source is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ward_analytics.llm.ordering import placed
from ward_analytics.llm.tables import cut

#: Nodes that become one of the next level.
FANOUT = 3
#: Levels from one that is stored to the next.
STRIDE = 3
#: What a leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_WIDTHS = [FANOUT**i for i in range(STRIDE + 1)]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts one after another, digests as hex text."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf(**changed: Column) -> Column:
    """The digest of a row's fields: ``-`` for a null, else the number of UTF-8 bytes, a colon and the value."""
    parts = []
    for field in FIELDS:
        text = changed.get(field, F.col(field)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def height(n: Column) -> Column:
    """Levels above the leaves of a tree of n leaves."""
    powers = F.array(*(F.lit(FANOUT**i).cast("long") for i in range(40)))
    return F.size(F.filter(powers, lambda p: p < n))


@dataclass
class Manifest:
    """Stored levels from the leaves up (tree, place, height, digest; the leaves with what was carried along), and the same of the tree over the sources."""

    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None

    def write(self, path: str) -> None:
        for name, levels in (("sources", self.levels), ("top", self.top)):
            for i, level in enumerate(levels):
                level.write.mode("overwrite").parquet(f"{path}/{name}/level={i * STRIDE}")

    @staticmethod
    def read(spark: SparkSession, path: str) -> Manifest:
        def tree(name: str) -> list[DataFrame]:
            found, base = [], f"{path}/{name}"
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
            files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            stored = {f.getPath().getName() for f in files.listStatus(hadoop)}
            while f"level={len(found) * STRIDE}" in stored:
                found.append(spark.read.parquet(f"{base}/level={len(found) * STRIDE}"))
            return found

        levels, top = tree("sources"), tree("top")
        return Manifest(levels, top, _only(top))


def build(documents: DataFrame, carry: dict[str, Column] | None = None) -> Manifest:
    """The manifest of a table with the columns FIELDS.

    Leaves of a source ascend by doc_id (null first), those of equal ids by their digest; repeated rows are leaves of their own, one
    after another. A null source is a source. Extra columns count for nothing, unless they are in ``carry`` (name: value), which the
    leaves keep. An empty table has no tree, and its root is None.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # "" sorts before every "="
    extra = carry or {}
    leaves = cut(documents.select(tree.alias("tree"), "doc_id", leaf().alias("digest"), *(v.alias(k) for k, v in extra.items())))
    levels = _levels(_with_height(placed(leaves, ["tree"], ["doc_id", "digest"])))
    subroots = _roots(levels).select("digest", F.col("tree").alias("source_tree"), F.col("height").alias("source_height"), F.lit("").alias("tree"))
    subroots = cut(subroots)
    top = _levels(_with_height(placed(subroots, ["tree"], ["source_tree"])))
    return Manifest(levels, top, _only(top))


def _with_height(leaves: DataFrame) -> DataFrame:
    return leaves.withColumn("height", height(F.col("n"))).drop("n")


def _levels(leaves: DataFrame) -> list[DataFrame]:
    levels = [cut(leaves)]
    tallest = levels[0].agg(F.max("height")).first()[0] or 0
    while STRIDE * (len(levels) - 1) < tallest:
        below = _subtrees(levels[-1], STRIDE * (len(levels) - 1))
        node = F.when(F.col("step") == STRIDE, F.col(f"d{STRIDE}")[0])
        for step in range(1, STRIDE):
            node = F.when(F.col("step") == step, F.col(f"d{step}")[0]).otherwise(node)
        levels.append(cut(below.select("tree", "place", "height", node.alias("digest"))))
    return levels


def _subtrees(nodes: DataFrame, level: int) -> DataFrame:
    """The aligned subtrees above the nodes of a stored level: their nodes in order (``members``), the digests of each level up to their
    root (``d0`` ...), the levels they span (``step``) and the place of their root."""
    step = F.least(F.lit(STRIDE), F.col("height") - level)
    width = F.element_at(F.array(*map(F.lit, _WIDTHS)), step + 1)
    rest = [c for c in nodes.columns if c not in ("tree", "place", "height")]
    grouped = (
        nodes.where(F.col("height") > level)
        .withColumns({"step": step, "_parent": F.floor(F.col("place") / width)})
        .groupBy("tree", "height", "step", F.col("_parent").alias("place"))
        .agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("members"))
        .withColumn("d0", F.col("members.digest"))
    )
    for t in range(STRIDE):
        grouped = grouped.withColumn(f"d{t + 1}", _next(F.col(f"d{t}")))
    return grouped


def _next(nodes: Column) -> Column:
    """The digests of the runs of a level."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest(F.array_join(F.slice(nodes, i * FANOUT + 1, FANOUT), "")))


def _roots(levels: list[DataFrame]) -> DataFrame:
    """The root of each tree, from the level that holds it."""
    found = levels[0].where("height = 0").select("tree", "place", "height", "digest")
    for i, level in enumerate(levels[1:], 1):
        ends = F.col("height").between(STRIDE * (i - 1) + 1, STRIDE * i)
        found = found.unionByName(level.where(ends).select("tree", "place", "height", "digest"))
    return found


def _only(top: list[DataFrame]) -> str | None:
    rows = _roots(top).take(1) if top else []
    return rows[0].digest if rows else None


def _segment(j: Column) -> Column:
    """Siblings of a subtree's j-th node, level by level: what stands left and right of the path in its run."""
    parts = []
    for t, width in enumerate(_WIDTHS[:-1]):
        at = F.floor(j / width).cast("int")
        left = F.array_join(F.slice(f"d{t}", at - at % FANOUT + 1, at % FANOUT), "")
        right = F.array_join(F.slice(f"d{t}", at + 2, FANOUT - 1 - at % FANOUT), "")
        parts.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*parts), F.lit(1), F.col("step"))


def _paths(levels: list[DataFrame], roots: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """The leaves with their paths, from the stored levels. ``roots``: tree, place 0, height, path of the root, and columns to hand down to all leaves."""
    handed = [c for c in roots.columns if c not in ("tree", "place", "height", "path")]
    above = roots.drop("height")
    for i in range(len(levels) - 1, -1, -1):
        here = levels[i]
        deep = _subtrees(here, STRIDE * i)
        if wanted is not None:
            part = wanted.select("tree", F.floor(F.col("place") / FANOUT ** (STRIDE * i)).alias("place"), "height")
            step = F.least(F.lit(STRIDE), F.col("height") - STRIDE * i)
            need = part.where(step > 0).select("tree", F.floor(F.col("place") / F.element_at(F.array(*map(F.lit, _WIDTHS)), step + 1)).alias("place"))
            deep = deep.join(need.distinct(), ["tree", "place"], "left_semi")
        nodes = F.transform("members", lambda m, j: F.struct(m.alias("m"), _segment(j).alias("s")))
        opened = deep.join(above, ["tree", "place"]).select("tree", "height", "path", *handed, F.explode(nodes).alias("x"))
        rest = [c for c in here.columns if c not in ("tree", "height")]
        opened = opened.select(
            "tree", "height", *(F.col(f"x.m.{c}").alias(c) for c in rest), F.concat("x.s", "path").alias("path"), *handed
        )
        if i:
            passed = opened.select("tree", "place", "path", *handed)
            # Trees whose roots lie no higher than this level begin below it.
            above = passed.unionByName(roots.where(F.col("height") <= STRIDE * i).drop("height"))
    single = levels[0].where("height = 0").join(roots.drop("place", "height"), "tree").select(*opened.columns)
    return opened.unionByName(single)


def prove(manifest: Manifest, wanted: DataFrame | None = None) -> DataFrame:
    """One row per leaf (or per leaf of ``wanted``, which has its tree, place and height): the columns of the leaves, the root of its
    source, and the path: for each level from the leaf to the root of all what stands left and right of it in its run."""
    start = _roots(manifest.top).select("tree", "place", "height", F.array().cast("array<struct<left:string,right:string>>").alias("path"))
    over = _paths(manifest.top, start)
    roots = cut(over.select(
        F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("place"), F.col("source_height").alias("height"), "path",
        F.col("digest").alias("subroot"),
    ))
    proofs = _paths(manifest.levels, roots, wanted)
    if wanted is not None:
        proofs = proofs.join(wanted.select("tree", "place"), ["tree", "place"], "left_semi")
    return proofs


def fold(leaf_digest: Column, path: str = "path") -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, leaf_digest, lambda node, run: digest(run["left"], node, run["right"]))


def siblings_digest(path: str = "path") -> Column:
    """The digest of all siblings of a path, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda run: F.concat(run["left"], run["right"])), "").cast("binary"), 256)
