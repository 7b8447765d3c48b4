"""Merkle manifest of a dataset: a digest per row, a tree per group, a tree over the groups, and a proof per row.

A row's leaf is the SHA-256 of its columns, each written as its length in bytes, a colon and its value, or ``-`` for null. In each
group the leaves stand in order of the key; every ``ARITY`` consecutive digests become the digest of their concatenation, level by
level, until one is left, the group's subroot. The subroots, in order of their groups, become the root in the same way.

Proofs are found by pointer jumping. A node holds a pointer to an ancestor and the segment of siblings on the way there, at
first those of its own run. A round joins the table of nodes with itself: the pointer moves on to the ancestor's ancestor and
the ancestor's segment is put behind the node's own, so the distance doubles and a tree of height h takes log2(h) rounds. The
leaves of a run share their way up: they travel inside their parent's row, which jumps for them, and part again at the end.

No step gathers a group: leaves are numbered in ranges, a run has ``ARITY`` members, and an ancestor that many nodes point at
is copied, so that ``SHARE`` pointers at most meet in one key. Every level and round is written to the shared folder.

Defined results: null in any column is ``-`` and differs from empty text; a null group is a group of its own and comes first, a
null key comes first in its group; rows with equal keys stand in order of their leaves, and equal rows are leaves each; a
group of one row has its leaf as subroot, a table of one group its subroot as root; the members of a last, shorter run become
a digest too, even a single one; an empty table has no root and gives an empty result. Other columns of the table are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyveer.llm.common import field, stored

#: Digests that become one.
ARITY = 8
#: Columns of ``documents``, in the order they are digested.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Pointers that meet in one key of a join.
SHARE = 64
#: Levels that a 64-bit row number can need, at two digests a run.
LEVELS = 63
#: Tree number of the tree over the groups.
TOP = -1

STEP = "struct<left:string,right:string>"


def digest_of(values: Sequence[Column]) -> Column:
    """Lowercase hex SHA-256 of values written so that no two rows read alike."""
    texts = [v.cast("string") for v in values]
    written = [F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*written), 256)


def leaves(
    docs: DataFrame,
    columns: Sequence[str] = COLUMNS,
    key: str = "doc_id",
    group: str = "lang",
    seen: Mapping[str, Column] | None = None,
) -> DataFrame:
    """``id, grp, leaf, seen`` of each row; ``seen`` is the digest of the row with the given columns replaced."""
    values = [field(c) for c in columns]
    changed = [seen[c] if seen and c in seen else field(c) for c in columns]
    return docs.select(
        field(key).alias("id"),
        field(group).cast("string").alias("grp"),
        digest_of(values).alias("leaf"),
        digest_of(changed).alias("seen"),
    )


def in_order(rows: DataFrame, group: Sequence[str], order: Sequence[str], purpose: str) -> DataFrame:
    """``rows`` with their place ``idx`` in their group, from 0, and the group's row count ``n``.

    Rows are dealt into ranges and stored in order; what stands before a range is known from counts per range and group.
    """
    sort = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    fixed = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    fixed = stored(fixed.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), purpose)
    spans = fixed.groupBy("part", *group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    whole = Window.partitionBy(*group)
    before = F.sum("held").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(
        F.col("part").alias("_part"),
        *[F.col(g).alias(f"_{g}") for g in group],
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("held").over(whole).alias("n"),
    )
    same = F.col("part") == F.col("_part")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = fixed.join(spans, same).withColumn("idx", F.col("at") + F.col("shift"))
    return out.drop("part", "at", "shift", "_part", *[f"_{g}" for g in group])


def height_of(n: Column, arity: int) -> Column:
    """Levels above ``n`` leaves."""
    out = F.when(n <= 1, 0)
    for k in range(1, LEVELS):
        if arity**k >= 1 << 63:
            break
        out = out.when(n <= arity**k, k)
    return out.otherwise(k)


def joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def climbed(nodes: DataFrame, height: int, arity: int) -> list[DataFrame]:
    """The runs of each level above ``nodes`` (tree, idx, height, digest): tree, idx, height, run, digest."""
    levels = []
    for level in range(1, height + 1):
        above = nodes.where(F.col("height") >= level).groupBy("tree", F.floor(F.col("idx") / arity).alias("idx"), "height")
        runs = above.agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("run"))
        runs = runs.withColumn("run", F.col("run.digest")).withColumn("digest", F.sha2(joined(F.col("run")), 256))
        nodes = stored(runs, f"manifest-level-{level}")
        levels.append(nodes)
    return levels


def beside(run: Column, at: Column) -> Column:
    """The siblings of member ``at`` (from 0) of a run, before and after it."""
    return F.struct(
        joined(F.slice(run, F.lit(1), at)).alias("left"), joined(F.slice(run, at + 2, F.size(run))).alias("right")
    )


def first_pointers(levels: Sequence[DataFrame], start: int, arity: int, over: bool) -> list[DataFrame]:
    """Every member of a run points to the run's digest, beside its siblings.

    The members of the first run have level ``start``. Where there is a tree over the groups (``over``), a subroot is named as
    that tree's leaf; a root is not named, pointers to it are null.
    """
    tables = []
    for level, runs in enumerate(levels, start + 1):
        is_top, last = F.col("tree") == TOP, F.col("height") == level
        pointer = F.when(~last, F.struct("tree", F.lit(level).alias("level"), "idx"))
        if over:
            subroot = F.struct(F.lit(TOP).cast("long").alias("tree"), F.lit(0).alias("level"), F.col("tree").alias("idx"))
            pointer = F.when(last & ~is_top, subroot).otherwise(pointer)
        members = runs.select("tree", "idx", "run", pointer.alias("up"), F.posexplode("run").alias("at", "one"))
        tables.append(
            members.select(
                "tree",
                F.lit(level - 1).alias("level"),
                (F.col("idx") * arity + F.col("at")).alias("idx"),
                F.col("up.tree").alias("up_tree"),
                F.col("up.level").alias("up_level"),
                F.col("up.idx").alias("up_idx"),
                F.array(beside(F.col("run"), F.col("at"))).alias("steps"),
            )
        )
    return tables


def jumped(nodes: DataFrame, longest: int, below: Column, width: int, arity: int) -> DataFrame:
    """The pointers of all nodes moved to the root, with the whole way in ``steps``.

    ``longest`` is the longest way in levels, ``below`` the levels below a node, ``width`` the nodes of the lowest level. After
    a round that began at distance d, each pointer is null or 2d levels up. At most ``arity ** d`` nodes point at one ancestor;
    it is copied so often that ``SHARE`` of them meet.
    """
    distance = 1
    while distance < longest:
        copies = max(1, min(arity**distance, width) // SHARE)
        above = nodes.where(below >= distance).select(
            F.col("tree").alias("a_tree"),
            F.col("level").alias("a_level"),
            F.col("idx").alias("a_idx"),
            F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("a_copy"),
            F.struct("up_tree", "up_level", "up_idx", "steps").alias("a"),
        )
        meet = (
            (F.col("up_tree") == F.col("a_tree"))
            & (F.col("up_level") == F.col("a_level"))
            & (F.col("up_idx") == F.col("a_idx"))
            & (F.pmod(F.col("idx"), F.lit(copies)).cast("int") == F.col("a_copy"))
        )
        out = nodes.join(above, meet, "left").select(
            "tree",
            "level",
            "idx",
            *[F.col(f"a.{c}").alias(c) for c in ("up_tree", "up_level", "up_idx")],
            F.when(F.col("a").isNull(), F.col("steps")).otherwise(F.concat("steps", "a.steps")).alias("steps"),
        )
        nodes = stored(out, f"manifest-jump-{distance}")
        distance *= 2
    return nodes


def prove(rows: DataFrame, arity: int = ARITY) -> DataFrame:
    """``id, grp, leaf, seen, idx, subroot, root, steps`` of each leaf (``rows`` as from :func:`leaves`).

    ``idx`` is the leaf's place in its group; ``steps`` holds, from the leaf's level to the root, the digests of its
    siblings before and after it, each concatenated.
    """
    rows = stored(rows, "manifest-digests")  # the ranges are drawn from a first look at them; texts are read once
    placed = in_order(rows, ["grp"], ["id", "leaf"], "manifest-leaves")
    groups = in_order(placed.where("idx = 0").select("grp", F.col("n").alias("size")), [], ["grp"], "manifest-groups")
    groups = stored(
        groups.select(
            F.col("grp").alias("_grp"), F.col("idx").alias("tree"), height_of(F.col("size"), arity).alias("height"), "n", "size"
        ),
        "manifest-trees",
    )
    found = groups.agg(F.max("height"), F.max("n"), F.sum("size")).first()
    if found[0] is None:
        return rows.select(
            *rows.columns, F.lit(0).cast("long").alias("idx"), F.lit("").alias("subroot"), F.lit("").alias("root"),
            F.array().cast(f"array<{STEP}>").alias("steps"),
        ).where(F.lit(False))
    height, trees, total = found
    top_height = next(k for k in range(LEVELS) if arity**k >= trees)

    # leaves in runs: rows of their parents, or of the leaf itself in a group of one
    member = F.struct("idx", "leaf", "id", "seen")
    numbered = placed.drop("n").join(groups.drop("n", "size"), F.col("grp").eqNullSafe(F.col("_grp")))
    runs = numbered.groupBy("tree", F.floor(F.col("idx") / arity).alias("idx"), "height").agg(
        F.sort_array(F.collect_list(member)).alias("members"), F.first("grp").alias("grp")
    )
    runs = runs.withColumn("run", F.col("members.leaf"))
    digest = F.when(F.col("height") == 0, F.get("run", 0)).otherwise(F.sha2(joined(F.col("run")), 256))
    runs = stored(runs.withColumn("digest", digest), "manifest-runs")

    levels = climbed_from(runs, height, arity)
    subroots = runs.where("height <= 1").select("tree", "digest")
    for level, table in enumerate(levels, 2):
        subroots = subroots.union(table.where(F.col("height") == level).select("tree", "digest"))
    subroots = stored(subroots, "manifest-subroots")
    tops = subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(top_height).alias("height"), "digest"
    )
    top_levels = climbed(tops, top_height, arity)
    root = (top_levels[-1] if top_levels else tops).first()["digest"]

    tables = first_pointers(levels, 1, arity, top_height > 0) + first_pointers(top_levels, 0, arity, False)
    way = None
    if tables:
        nodes = tables[0]
        for table in tables[1:]:
            nodes = nodes.union(table)
        nodes = stored(nodes, "manifest-pointers")
        below = F.when(F.col("tree") == TOP, F.col("level") + max(height - 1, 0)).otherwise(F.col("level") - 1)
        way = jumped(nodes, max(height - 1, 0) + top_height, below, -(-total // arity), arity)

    alone = F.col("height") <= 1  # the run's digest, or the leaf, is the subroot
    runs = runs.withColumns(
        {
            "b_tree": F.when(alone, F.lit(TOP)).otherwise(F.col("tree")),
            "b_level": F.when(alone, 0).otherwise(1),
            "b_idx": F.when(alone, F.col("tree")).otherwise(F.col("idx")),
        }
    )
    if way is None:
        runs = runs.withColumn("steps", F.array().cast(f"array<{STEP}>"))
    else:
        way = way.select(*[F.col(c).alias(f"w_{c}") for c in ("tree", "level", "idx")], "steps")
        same = (F.col("b_tree") == F.col("w_tree")) & (F.col("b_level") == F.col("w_level")) & (F.col("b_idx") == F.col("w_idx"))
        runs = runs.join(way, same, "left").withColumn("steps", F.coalesce("steps", F.array().cast(f"array<{STEP}>")))
    subroots = subroots.select(F.col("tree").alias("s_tree"), F.col("digest").alias("subroot"))
    runs = runs.join(subroots, F.col("tree") == F.col("s_tree"))
    out = runs.select("grp", "height", "run", "steps", "subroot", F.posexplode("members").alias("at", "one"))
    own = F.array(beside(F.col("run"), F.col("at")))
    return out.select(
        F.col("one.id").alias("id"),
        "grp",
        F.col("one.leaf").alias("leaf"),
        F.col("one.seen").alias("seen"),
        F.col("one.idx").alias("idx"),
        "subroot",
        F.lit(root).alias("root"),
        F.when(F.col("height") == 0, F.col("steps")).otherwise(F.concat(own, "steps")).alias("steps"),
    )


def climbed_from(runs: DataFrame, height: int, arity: int) -> list[DataFrame]:
    """The levels above the leaves' parents: the runs are the first level, so theirs is counted from it."""
    nodes = runs.where("height >= 2").select("tree", "idx", (F.col("height") - 1).alias("height"), "digest")
    above = climbed(nodes, max(height - 1, 0), arity)
    return [table.withColumn("height", F.col("height") + 1) for table in above]


def folded(digest: Column, steps: Column) -> Column:
    """The root that a digest and the siblings on its way lead to."""
    return F.aggregate(steps, digest, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(steps: Column) -> Column:
    """SHA-256 of all siblings, level by level, left to right."""
    return F.sha2(joined(F.transform(steps, lambda s: F.concat(s["left"], s["right"]))), 256)


def verified(proofs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Digests of the proofs, and whether the digest that was seen leads to the root."""
    reached = proofs.withColumn("folded_root", folded(F.col("seen"), F.col("steps")))
    return reached.select(
        F.col("id").alias(key),
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("steps")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
