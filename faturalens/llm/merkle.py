"""Merkle manifest of a dataset: built levels as parent-linked node rows, climbed by a recursive query.

A row's leaf is the hash of its fields. The leaves of a source, by id, form a tree in which runs
of three make a parent; the sources' roots form a tree of the same kind, whose root stands for
the dataset. H is the SHA-256 of texts set one after the other, digests as lowercase hex.

Leaves get their places by range partitions (`plans.running.numbered`), so a hot source needs no
task of its own. A tree is built a block of 3^6 nodes at a time: a block's levels are arrays in
one row, and the tops of the blocks are the nodes of the next round. The levels are then stored as
node rows, each with its siblings and a link to the parent; to move less, a row stands for a rise of
up to three levels and links to the ancestor there. A block of leaves is a
lane; nodes above a lane are stored once for each lane below them, so that no node is the key of
more than 729 climbing leaves. The climb is one recursive SQL query: it starts at every leaf with the
digest recomputed from the (tampered) row, joins the node rows, appends a row with the siblings
and the folded digest, and goes on at the ancestor until there is none. The rows of a leaf, put
together by depth, give its proof and the root that it folds to.

Nulls in any field have a mark of their own in the leaf. A null source is a source, first in order; rows
with a null id come first in theirs, and are never tampered with. Empty texts differ from null
ones. Texts of any length are hashed where they are read. Rows with equal ids stand by their leaves; equal
rows have equal leaves side by side, each with a proof. A lone leaf is its source's root, a lone
source's root is that of the dataset. An empty table gives an empty one. Other columns aren't read.

The recursive query may return any number of rows: `prepare_climb` lifts the session's row limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faturalens.plans.running import numbered
from faturalens.plans.shared import written

RUN = 3
BLOCK_LEVELS = 6
BLOCK = RUN**BLOCK_LEVELS
# Levels that a node row rises; blocks are a whole number of rises.
RISE = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(value: Column) -> Column:
    """A field as the leaf spells it."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(fields[name]) for name in FIELDS]), 256))


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def prepare_climb(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    return spark


def leaves(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, key of the source, leaf and tampered leaf; `tamper` says which rows are tampered with."""
    fields = {name: F.col(name) for name in FIELDS}
    other = {**fields, "text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}
    tamper = is_tampered(F.col("doc_id")) if tamper is None else tamper
    changed = F.when(tamper & F.col("text").contains("\n"), leaf(other))
    # Bytes of UTF-8 sort as their hex does; null comes before all of them.
    key = F.when(F.col("source").isNull(), "-").otherwise(F.concat(F.lit("0"), F.hex(F.encode("source", "UTF-8"))))
    kept = docs.select("doc_id", key.alias("key"), leaf(fields).alias("leaf"), changed.alias("changed"))
    return kept.withColumn("changed", F.coalesce("changed", "leaf"))


def height(count: Column, most: int) -> Column:
    """Levels above `count` nodes, up to `most`."""
    steps = F.lit(0)
    for level in range(most):
        steps = F.when(count > RUN**level, level + 1).otherwise(steps)
    return steps


def together(run: Column) -> Column:
    """The parent of a run of nodes."""
    return F.unhex(F.sha2(F.lower(F.array_join(F.transform(run, F.hex), "")), 256))


def above(nodes: Column) -> Column:
    """The parents of an array of nodes."""
    count = F.floor((F.size(nodes) + (RUN - 1)) / RUN).cast("int")
    return F.transform(F.sequence(F.lit(1), count), lambda i: together(F.slice(nodes, RUN * i - (RUN - 1), RUN)))


def build(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks over (tree, place, count, digest), and (tree, root, depth), all written.

    A round has tree, block, count and levels: levels[i][j] is the digest of the block's node j at
    the i-th level of the round. `count` is the tree's number of nodes where the round begins.
    """
    rounds, roots, depth = [], [], 0
    while True:
        blocks = nodes.groupBy("tree", "count", F.floor(F.col("place") / BLOCK).alias("block")).agg(
            F.transform(F.sort_array(F.collect_list(F.struct("place", "digest"))), lambda x: x["digest"]).alias("base")
        )
        steps = height(F.col("count"), BLOCK_LEVELS)
        grown = F.aggregate(
            F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")),
            F.array("base"),
            lambda levels, _: F.concat(levels, F.array(above(F.element_at(levels, -1)))),
        )
        table = written(blocks.select("tree", "block", "count", grown.alias("levels")))
        rounds.append(table)
        tops = table.select(
            "tree",
            F.col("block").alias("place"),
            F.floor((F.col("count") + (BLOCK - 1)) / BLOCK).alias("count"),
            F.element_at(F.element_at("levels", -1), 1).alias("digest"),
            (F.size("levels") - 1 + depth).alias("depth"),
        )
        roots.append(tops.where("count = 1").select("tree", F.col("digest").alias("root"), "depth"))
        nodes = tops.where("count > 1").drop("depth")
        if nodes.isEmpty():
            break
        depth += BLOCK_LEVELS
    whole = roots[0]
    for more in roots[1:]:
        whole = whole.union(more)
    return rounds, written(whole)


def power(exponent: Column) -> Column:
    return F.pow(F.lit(float(RUN)), exponent).cast("long")


def node_rows(rounds: list[DataFrame]) -> DataFrame:
    """(tree, depth, node, rise, parent, left, right): the nodes below their tree's root that a climb stops at.

    left[i] and right[i] are the siblings, set together, of the ancestor i levels up.
    """
    tables = []
    joined = lambda part: F.unhex(F.array_join(F.transform(part, F.hex), ""))
    for number, table in enumerate(rounds):
        stops = table.where(F.size("levels") > 1).select("*", F.explode(F.sequence(F.lit(0), F.size("levels") - 2, F.lit(RISE))).alias("step"))
        stops = stops.withColumn("rise", F.least(F.lit(RISE), F.size("levels") - 1 - F.col("step")))
        base = F.col("block") * power(F.lit(BLOCK_LEVELS) - F.col("step"))

        def sibling(at: Column, up: Column, behind: bool) -> Column:
            level, place = F.get("levels", F.col("step") + up), F.floor(at / power(up)).cast("int")
            slot = place % RUN
            first = place - slot + 1
            return joined(F.slice(level, first + slot + 1, RUN - 1 - slot) if behind else F.slice(level, first, slot))

        def row(digest: Column, at: Column) -> Column:
            ups = F.sequence(F.lit(0), F.col("rise") - 1)
            node = base + at
            return F.struct(
                node.alias("node"),
                F.floor(node / power(F.col("rise"))).alias("parent"),
                F.transform(ups, lambda up: sibling(at, up, False)).alias("left"),
                F.transform(ups, lambda up: sibling(at, up, True)).alias("right"),
            )

        rows = F.transform(F.get("levels", F.col("step")), row)
        depth = (F.col("step") + number * BLOCK_LEVELS).alias("depth")
        tables.append(stops.select("tree", depth, "rise", F.inline(rows)).select("tree", "depth", "node", "rise", "parent", "left", "right"))
    whole = tables[0]
    for more in tables[1:]:
        whole = whole.union(more)
    return whole


def lane_nodes(nodes: DataFrame, above_sources: DataFrame, trees: DataFrame) -> DataFrame:
    """The node rows that a climb meets: lane, depth, node, next_depth, next_node, left, right.

    Nodes with at most a lane's leaves below them are in one lane; all higher ones, those above the
    sources included, are repeated for each lane below them.
    """
    met = ["tree", "lane", "depth", "node", "next_depth", "next_node", "left", "right"]
    next_depth = F.col("depth") + F.col("rise")
    # A source's root goes on as the node of its source among the sources.
    next_node = F.when(next_depth == F.col("height"), F.col("tree")).otherwise(F.col("parent"))
    linked = {"next_depth": next_depth, "next_node": next_node}
    low = nodes.where(F.col("depth") < BLOCK_LEVELS).join(trees.select("tree", "height"), "tree")
    in_lane = low.withColumn("lane", F.floor(F.col("node") / power(F.lit(BLOCK_LEVELS) - F.col("depth")))).withColumns(linked)

    lanes = trees.select("tree", "height", F.explode(F.sequence(F.lit(0), F.floor((F.col("count") - 1) / BLOCK))).alias("lane"))
    # Lanes and their few nodes above: one row for 729 leaves each.
    stops = F.explode(F.sequence(F.lit(BLOCK_LEVELS), F.col("height") - 1, F.lit(RISE))).alias("depth")
    steps = lanes.where(F.col("height") > BLOCK_LEVELS).select("*", stops)
    at = F.floor(F.col("lane") / power(F.col("depth") - BLOCK_LEVELS))
    high = nodes.where(F.col("depth") >= BLOCK_LEVELS)
    over_lane = steps.withColumn("node", at).join(high, ["tree", "depth", "node"]).withColumns(linked)

    top = above_sources.select(F.col("depth").alias("step"), "node", "rise", "parent", "left", "right")
    most = above_sources.agg(F.max("depth")).first()[0]
    found = in_lane.select(*met).union(over_lane.select(*met))
    if most is None:
        return found
    walk = lanes.select("*", F.explode(F.sequence(F.lit(0), F.lit(most), F.lit(RISE))).alias("step"))
    walk = walk.withColumn("node", F.floor(F.col("tree") / power(F.col("step"))))
    over_sources = walk.join(top, ["step", "node"]).withColumn("depth", F.col("height") + F.col("step"))
    over_sources = over_sources.withColumns({"next_depth": next_depth, "next_node": F.col("parent")})
    return found.union(over_sources.select(*met))


# The digest `{value}` folded with a node's siblings, level by level.
FOLD = "aggregate(sequence(0, size(n.left) - 1), {value}, (a, i) -> unhex(sha2(lower(hex(concat(n.left[i], a, n.right[i]))), 256)))"
CLIMB = f"""
WITH RECURSIVE climb AS (
  SELECT l.number, l.tree, l.lane, n.depth, n.next_depth, n.next_node, n.left, n.right, {FOLD.format(value="l.changed")} AS folded
  FROM {{leaves}} l JOIN {{nodes}} n ON n.tree = l.tree AND n.lane = l.lane AND n.node = l.node
  WHERE n.depth = 0
  UNION ALL
  SELECT c.number, c.tree, c.lane, n.depth, n.next_depth, n.next_node, n.left, n.right, {FOLD.format(value="c.folded")}
  FROM climb c JOIN {{nodes}} n ON n.tree = c.tree AND n.lane = c.lane AND n.depth = c.next_depth AND n.node = c.next_node
  WHERE n.depth > 0)
SELECT number, depth, left, right, folded FROM climb
"""


def manifest(docs: DataFrame, tamper: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    spark = prepare_climb(docs.sparkSession)
    rows = numbered(written(leaves(docs, tamper)), ["key"], ["doc_id", "leaf"])
    sources = numbered(rows.groupBy("key").agg(F.first("_count").alias("count")), [], ["key"])
    sources = written(sources.select("key", "count", F.col("_place").alias("tree")))
    number = F.monotonically_increasing_id()
    place = F.col("_place")
    own = F.when(F.col("_count") > 1, place).otherwise(F.col("tree"))
    placed = rows.join(sources.select("key", "tree"), "key").select(
        "tree", place.alias("place"), F.col("_count").alias("count"), F.floor(place / BLOCK).alias("lane"),
        own.alias("node"), "doc_id", "leaf", "changed", number.alias("number"),
    )
    placed = written(placed)

    rounds, roots = build(placed.select("tree", "place", "count", F.col("leaf").alias("digest")))
    trees = written(sources.join(roots, "tree").select("tree", "count", F.col("root").alias("subroot"), F.col("depth").alias("height")))
    total = F.lit(trees.count()).cast("long")
    tops, top = build(trees.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), total.alias("count"), F.col("subroot").alias("digest")))
    nodes = written(lane_nodes(node_rows(rounds), node_rows(tops), trees))
    found = top.first()
    root = F.lit(found["root"].hex() if found else None).cast("string")

    name = f"climb_{uuid.uuid4().hex}"
    placed.createOrReplaceTempView(f"{name}_leaves")
    nodes.createOrReplaceTempView(f"{name}_nodes")
    climbed = spark.sql(CLIMB.format(leaves=f"{name}_leaves", nodes=f"{name}_nodes"))
    steps = climbed.select("number", F.struct("depth", "left", "right", "folded").alias("step"), *[F.lit(None).cast(t).alias(c) for c, t in (("tree", "long"), ("doc_id", placed.schema["doc_id"].dataType), ("leaf", "binary"))])
    # The leaf itself is step -1: it gives the row its columns, and the digest that a lone leaf folds to.
    nothing = F.array().cast("array<binary>")
    begin = F.struct(F.lit(-1).alias("depth"), nothing.alias("left"), nothing.alias("right"), F.col("changed").alias("folded"))
    begun = placed.select("number", begin.alias("step"), "tree", "doc_id", "leaf")
    gathered = begun.unionByName(steps).groupBy("number").agg(
        F.sort_array(F.collect_list("step")).alias("steps"),
        F.max("tree").alias("tree"),
        F.max("doc_id").alias("doc_id"),
        F.max("leaf").alias("leaf"),
    )
    level = lambda pair: F.lower(F.hex(F.concat(pair["left"], pair["right"])))
    siblings = F.array_join(F.transform("steps", lambda s: F.array_join(F.transform(F.arrays_zip(s["left"].alias("left"), s["right"].alias("right")), level), "")), "")
    folded = F.lower(F.hex(F.element_at("steps", -1)["folded"]))
    return gathered.join(trees.select("tree", "subroot"), "tree").select(
        "doc_id",
        F.lower(F.hex("leaf")).alias("leaf"),
        F.lower(F.hex("subroot")).alias("subroot"),
        root.alias("root"),
        F.sha2(siblings, 256).alias("proof_sha256"),
        folded.alias("folded_root"),
        (folded == root).alias("verified"),
    )
