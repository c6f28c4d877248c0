"""A prefix trie of conversations, rolled up by centroid decomposition.

Every distinct sequence of first turns is a node; its parent lacks the last turn. A node is known by the smallest
conversation that starts with it and its depth. Running XORs of digests (of a turn and its place) give every prefix a
128-bit key, so a node is a group of equal keys. Conversations are cut into range partitions for that, with one carried
value for a partition, so a very long one is not held in one task.

Sums over subtrees come from the forest of parent edges by centroid decomposition. In every component the deepest node
whose subtree holds half of the component is taken out; the totals of what hangs below it are added once to every node
on the path from it to the component's top, and the subtrees below it and the rest above go on as components of their
own, at most half as large. So a node's total arrives in a logarithmic number of additions, however deep the chains are.
Components of more than ``HELD`` nodes are split with joins and grouped sums, a level at a time; smaller ones are finished
inside a task, many at once. Only sizes are needed to find centroids, and they follow from the trie without a rollup:
below a node stand all nodes of which its other members are the smallest member, and the rest of its own chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from creditloom.sources.intermediate import materialise

# The largest component that one task finishes.
HELD = 1 << 15
SEED_TURNS = 6
_TOP = ["top_conv", "top_depth"]
_NODE = ["conv_id", "depth"]


def _stored(rows: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """Rows stored in range partitions of ``order``; ``block`` is the number of a row's partition."""
    laid_out = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(laid_out.withColumn("block", F.spark_partition_id()), "blocks")


def _running(stored: DataFrame, key: str, order: Sequence[str | Column], counted: str | None, mixed: Sequence[str]) -> DataFrame:
    """Running totals inside each key over stored blocks: the number of rows (``counted``) and the XOR of each of ``mixed``.

    A key that reaches over several blocks carries one row from each, so no task sees it whole.
    """
    sums = {c: F.bit_xor(c) for c in mixed} | ({counted: F.count(F.lit(1))} if counted else {})
    inside = Window.partitionBy("block", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    partial = stored.groupBy("block", key).agg(*[c.alias(f"own_{n}") for n, c in sums.items()])
    wide = partial.groupBy(key).agg(F.count(F.lit(1)).alias("blocks")).filter("blocks > 1").select(key)
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carry = {n: F.sum(f"own_{n}").over(before) if n == counted else F.bit_xor(f"own_{n}").over(before) for n in sums}
    carried = partial.join(wide, key, "left_semi").select("block", key, *[c.alias(f"carried_{n}") for n, c in carry.items()])
    running = stored.select("*", *[c.over(inside).alias(f"running_{n}") for n, c in sums.items()])
    joined = running.join(carried, ["block", key], "left")
    zero = F.lit(0).cast("long")
    for n in sums:
        a, b = F.col(f"running_{n}"), F.coalesce(f"carried_{n}", zero)
        joined = joined.withColumn(f"running_{n}", a + b if n == counted else a.bitwiseXOR(b))
    return joined.drop("block", *[f"carried_{n}" for n in sums])


def _rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, length) of every conversation, and the rebuilt turns: conv_id, at, length, first, second, chars."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    own = turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, text).alias("first"),
        F.xxhash64(F.lit(2), role, text).alias("second"),
        F.length(text).cast("long").alias("chars"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "first", "second"]
    placed = _running(_stored(own, order), "conv_id", order[1:], "place", [])
    placed = materialise(placed.withColumn("at", F.col("running_place") - 1).drop("turn", "running_place"), "turns")
    taken = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SEED_TURNS
    counts = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    known = counts.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 100, "taken": taken})
    known = known.join(base.hint("merge"), "base", "left").withColumn("lead", F.least("taken", F.coalesce("base_n", F.lit(0).cast("long"))))
    length = F.col("lead") + F.greatest(F.col("n") - F.col("taken"), F.lit(0).cast("long"))
    convs = materialise(known.select("conv_id", "base", "taken", "lead", length.alias("length")), "conversations")
    seeds = placed.filter(F.col("at") < SEED_TURNS).withColumnRenamed("conv_id", "base")
    columns = ["conv_id", "at", "length", "first", "second", "chars"]
    shared = convs.join(seeds.hint("merge"), "base").filter("at < taken").select(columns)
    later = placed.join(convs.hint("merge"), "conv_id").filter("at >= taken")
    later = later.withColumn("at", F.col("at") - F.col("taken") + F.col("lead")).select(columns)
    return convs.select("conv_id", "length"), shared.unionByName(later)


def _prefixes(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, the prefix's key (one, two), its parent's key (up_one, up_two), chars of its last text, last."""
    keyed = rebuilt.select(
        "conv_id", "at", "chars", (F.col("at") + 1 == F.col("length")).alias("last"),
        F.xxhash64("first", "at").alias("one"), F.xxhash64("second", "at", F.lit(7)).alias("two"),
    )
    run = _running(_stored(keyed, ["conv_id", "at"]), "conv_id", ["at"], None, ["one", "two"])
    up = {f"up_{n}": F.col(f"running_{n}").bitwiseXOR(F.col(n)) for n in ("one", "two")}
    run = run.withColumns(up | {"depth": F.col("at") + 1}).drop("one", "two", "at")
    return materialise(run.withColumnsRenamed({"running_one": "one", "running_two": "two"}), "prefixes")


def _chained_hashes(ends: DataFrame) -> DataFrame:
    """conv_id, depth and ends_sha256 of the nodes at which conversations end; ``ends`` has conv_id, depth and member.

    Ids are joined into one text for a block and node; a node's texts then stream through one digest in order.
    """
    blocks = _stored(ends, [*_NODE, "member"]).groupBy("block", *_NODE).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("member")), lambda c: c.cast("string")), ",").alias("ids")
    )
    ordered = blocks.repartition(*_NODE).sortWithinPartitions(*_NODE, "block")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for conv, depth, ids in zip(*(batch.column(c).to_pylist() for c in (*_NODE, "ids"))):
                if (conv, depth) != node:
                    if node is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], [*_NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, state.hexdigest())], [*_NODE, "ends_sha256"])

    return ordered.mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def rolled_up(up: np.ndarray, depth: np.ndarray, size: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one row a node) over all subtrees of a forest, by centroid decomposition.

    ``up`` is the place of a node's parent, -1 at a top; ``size`` the number of nodes of its subtree.
    """
    up, size = up.copy(), size.copy()
    sums = np.zeros_like(values)
    alive = np.ones(len(up), bool)
    by_depth = np.argsort(depth, kind="stable")
    while len(by_depth):
        cuts = np.flatnonzero(np.diff(depth[by_depth])) + 1
        top = np.arange(len(up))
        for level in np.split(by_depth, cuts):
            below = level[up[level] >= 0]
            top[below] = top[up[below]]
        # The deepest node with half of its component below it; deeper ones are written later.
        heavy = by_depth[2 * size[by_depth] >= size[top[by_depth]]]
        centroid = np.full(len(up), -1)
        centroid[top[heavy]] = heavy
        taken = centroid[centroid >= 0]
        # Cut below the centroids; what now hangs on a cut edge belongs to the subtree of its centroid.
        chosen = np.zeros(len(up), bool)
        chosen[taken] = True
        host = np.where(chosen, np.arange(len(up)), -1)
        for level in np.split(by_depth, cuts):
            below = level[(up[level] >= 0) & ~chosen[level]]
            host[below] = host[up[below]]
        under = by_depth[host[by_depth] >= 0]
        totals = np.zeros_like(values)
        np.add.at(totals, host[under], values[under])
        sums[taken] += totals[taken]
        at, total, gone = up[taken], totals[taken], size[taken]
        while (inside := at >= 0).any():
            at, total, gone = at[inside], total[inside], gone[inside]
            sums[at] += total  # paths of different components share no node
            size[at] -= gone
            at = up[at]
        alive[taken] = False
        cut = by_depth[(up[by_depth] >= 0) & chosen[up[by_depth]]]
        up[cut] = -1
        by_depth = by_depth[alive[by_depth]]
    return sums


def _finished(rows: pa.Table) -> pa.RecordBatch:
    conv, depth, up_conv, top_conv, top_depth, size = (rows[c].to_numpy() for c in (*_NODE, "up_conv", *_TOP, "size"))
    place = {node: i for i, node in enumerate(zip(conv.tolist(), depth.tolist()))}
    is_top = (conv == top_conv) & (depth == top_depth)
    up = np.array([-1 if t else place[c, d - 1] for t, c, d in zip(is_top.tolist(), up_conv.tolist(), depth.tolist())], np.int64)
    own = np.stack([rows[c].to_numpy() for c in ("leaf", "saved")], axis=1)
    before = np.stack([rows[c].to_numpy() for c in ("sum_leaf", "sum_saved")], axis=1)
    sums = before + rolled_up(up, depth, size, own)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (conv, depth, sums[:, 0], sums[:, 1])], [*_NODE, "sum_leaf", "sum_saved"])


def _finish(tree: DataFrame) -> DataFrame:
    """The sums of components that a task can hold; whole components are gathered up to that size at a time."""
    held = HELD
    ordered = tree.repartition(*_TOP).sortWithinPartitions(*_TOP)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < held:
                continue
            rows = pa.Table.from_batches(kept).combine_chunks()
            tops = np.stack([rows[c].to_numpy() for c in _TOP])
            last = int(np.flatnonzero((tops != tops[:, -1:]).any(axis=0)).max(initial=-1)) + 1
            if last:
                yield _finished(rows.slice(0, last))
            kept = rows.slice(last).to_batches()
        if any(b.num_rows for b in kept):
            yield _finished(pa.Table.from_batches(kept))

    return ordered.mapInArrow(finish, "conv_id long, depth long, sum_leaf long, sum_saved long")


def _split(tree: DataFrame, members: DataFrame) -> DataFrame:
    """One level of the decomposition of the components in ``tree``; ``total`` becomes 0 for centroids, which are done.

    ``members`` holds conv_id and depth of every prefix of every conversation, and owner, the conv_id of its node.
    """
    heavy = tree.filter(2 * F.col("size") >= F.col("total")).groupBy(*_TOP)
    # The nodes that hold half lie on one path; the deepest is the smallest.
    centroids = heavy.agg(F.min(F.struct("size", "conv_id", "depth")).alias("z")).select(
        *_TOP, F.col("z.size").alias("z_size"), F.col("z.conv_id").alias("z_conv"), F.col("z.depth").alias("z_depth")
    )
    centroids = materialise(centroids, "centroids")
    child = members.select("conv_id", (F.col("depth") - 1).alias("z_depth"), F.col("owner").alias("child"))
    through = (
        members.select("conv_id", F.col("owner").alias("z_conv"), F.col("depth").alias("z_depth"))
        .join(centroids.select(*_TOP, "z_conv", "z_depth"), ["z_conv", "z_depth"])
        .join(child.hint("merge"), ["conv_id", "z_depth"], "left")
        .select(*_TOP, "conv_id", F.col("z_depth").alias("cut"), "child")
    )
    below = F.col("cut").isNotNull() & (F.col("depth") >= F.col("cut"))
    marked = tree.join(through, [*_TOP, "conv_id"], "left").withColumn("below", below)
    marked = materialise(marked, "marked")
    totals = marked.filter("below").groupBy(*_TOP).agg(F.sum("leaf").alias("z_leaf"), F.sum("saved").alias("z_saved"))
    path = (
        centroids.join(totals, _TOP)
        .join(members.select(F.col("conv_id").alias("z_conv"), "depth", "owner"), "z_conv")
        .filter("depth <= z_depth")
        .select(*_TOP, F.col("owner").alias("conv_id"), "depth", "z_depth", "z_size", "z_leaf", "z_saved")
    )
    added = marked.join(path.hint("merge"), [*_TOP, *_NODE], "left")
    zero = F.lit(0).cast("long")
    is_centroid = F.col("depth") == F.col("z_depth")
    moved = F.col("below") & ~F.coalesce(is_centroid, F.lit(False))
    sorted_out = added.select(
        *_NODE, "up_conv", "leaf", "saved",
        F.when(moved, F.col("child")).otherwise(F.col("top_conv")).alias("top_conv"),
        F.when(moved, F.col("cut") + 1).otherwise(F.col("top_depth")).alias("top_depth"),
        (F.col("size") - F.when(is_centroid, zero).otherwise(F.coalesce("z_size", zero))).alias("size"),
        (F.col("sum_leaf") + F.coalesce("z_leaf", zero)).alias("sum_leaf"),
        (F.col("sum_saved") + F.coalesce("z_saved", zero)).alias("sum_saved"),
        F.coalesce(is_centroid, F.lit(False)).alias("done"),
    )
    sorted_out = materialise(sorted_out, "sorted-out")
    counts = sorted_out.filter("not done").groupBy(*_TOP).agg(F.count(F.lit(1)).alias("total"))
    counted = sorted_out.filter("not done").join(counts.hint("merge"), _TOP).drop("done")
    return materialise(counted.unionByName(sorted_out.filter("done").drop("done").withColumn("total", zero)), "components")


def subtree_sums(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id, depth, sum_leaf and sum_saved of every node.

    ``nodes`` has conv_id, depth, up_conv (null at the root), leaf and saved; ``members`` conv_id, depth and owner for every
    prefix of every conversation, the empty one included.
    """
    owned = nodes.groupBy("conv_id").agg(F.count(F.lit(1)).alias("owned"), F.min("depth").alias("from"))
    hung = members.join(owned.hint("merge"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("owned").alias("all"))
    sized = nodes.join(owned.select("conv_id", "from").hint("merge"), "conv_id").join(hung.hint("merge"), _NODE)
    size = F.col("all") - (F.col("depth") - F.col("from"))
    zero = F.lit(0).cast("long")
    root = nodes.filter("depth = 0").first()
    tree = sized.select(
        *_NODE, "up_conv", "leaf", "saved", F.lit(root["conv_id"] if root else None).cast("long").alias("top_conv"), zero.alias("top_depth"),
        size.alias("size"), zero.alias("sum_leaf"), zero.alias("sum_saved"),
    ).withColumn("total", F.lit(nodes.count()).cast("long"))
    tree = materialise(tree, "tree")
    small, done = [], []
    while True:
        small.append(tree.filter((F.col("total") > 0) & (F.col("total") <= HELD)))
        large = tree.filter(F.col("total") > HELD)
        if large.isEmpty():
            break
        tree = _split(large, members)
        done.append(tree.filter("total = 0"))
    sums = [*_NODE, "sum_leaf", "sum_saved"]
    out = small[0]
    for part in small[1:]:
        out = out.unionByName(part)
    out = _finish(out)
    for part in done:
        out = out.unionByName(part.select(sums))
    return out


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node, longs but the last: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A conversation's turns come in the order of turn (null first; equal ones in an order that role and text decide); null
    role or text count as empty. Every conversation c is rebuilt from the first h turns of conversation c - c % 100 and
    its own turns after its first h, with h = crc32(c) % 6. A node is a distinct sequence of first rebuilt turns, the
    textless root included; conv_id is its smallest member. n_leaves counts childless nodes of its subtree,
    saved_tokens adds (n_convs - 1) times the code points of the last text over it, ends_sha256 is the SHA-256 of the
    comma-joined ids of members that end there. Rows without conv_id take no part, repeated rows are turns of their own,
    an empty table has no nodes. Columns besides conv_id, turn, role and text are not read.
    """
    convs, rebuilt = _rebuilt(turns)
    keyed = _prefixes(rebuilt)
    first, total = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    key = ["depth", "one", "two"]
    inner = materialise(
        keyed.groupBy(*key).agg(
            F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
            F.max("up_one").alias("up_one"), F.max("up_two").alias("up_two"),
        ),
        "nodes",
    )
    parents = inner.select((F.col("depth") + 1).alias("depth"), F.col("one").alias("up_one"), F.col("two").alias("up_two"), F.col("conv_id").alias("up"))
    up = F.when(F.col("depth") == 1, F.lit(first).cast("long")).otherwise(F.col("up")).alias("up_conv")
    linked = inner.join(parents.hint("merge"), ["depth", "up_one", "up_two"], "left").select(*_NODE, up, "n_convs", "chars")
    root = convs.limit(1).select(
        F.lit(first).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("up_conv"),
        F.lit(total).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"),
    )
    linked = materialise(linked.unionByName(root), "linked")
    children = linked.filter("depth > 0").groupBy(F.col("up_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    zero = F.lit(0).cast("long")
    nodes = linked.join(children.hint("merge"), _NODE, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = nodes.withColumns(
        {"leaf": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("chars")}
    )
    nodes = materialise(nodes, "nodes")
    members = keyed.join(inner.select(*key, F.col("conv_id").alias("owner")).hint("merge"), key).select("conv_id", "depth", "owner", "last")
    tops = convs.select("conv_id", zero.alias("depth"), F.lit(first).cast("long").alias("owner"), (F.col("length") == 0).alias("last"))
    members = materialise(members.unionByName(tops), "members")
    ends = members.filter("last").select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("member"))
    sums = subtree_sums(nodes.select(*_NODE, "up_conv", "leaf", "saved"), members.drop("last"))
    return (
        nodes.join(sums.hint("merge"), _NODE)
        .join(_chained_hashes(ends).hint("merge"), _NODE, "left")
        .select(
            "conv_id", "depth", F.col("up_conv").alias("parent_conv_id"), "n_convs", "n_children", F.col("sum_leaf").alias("n_leaves"),
            F.col("sum_saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def trie_sql() -> str:
    """DuckDB SQL for ``conversation_trie`` on the table ``conversations``."""
    step = "list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda acc, b: {step}), 4294967295)"
    return f"""
    WITH own AS (
      SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
             coalesce(role, '') AS role, coalesce(text, '') AS txt FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (SELECT c, c - c % 100 AS base, count(*) AS n, {crc} % 6 AS h FROM own GROUP BY c),
    rebuilt AS (
      SELECT k.c, t.pos AS spot, t.role, t.txt FROM convs k JOIN own t ON t.c = k.base AND t.pos < k.h
      UNION ALL
      SELECT k.c, least(k.h, coalesce(b.n, 0)) + t.pos - k.h, t.role, t.txt
      FROM convs k JOIN own t ON t.c = k.c AND t.pos >= k.h LEFT JOIN convs b ON b.c = k.base),
    prefixes AS (
      SELECT c, list(md5(role) || md5(txt)) OVER w AS path, length(txt) AS chars, spot + 1 = count(*) OVER (PARTITION BY c) AS ends
      FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY spot ROWS UNBOUNDED PRECEDING)
      UNION ALL
      SELECT c, [], 0, c NOT IN (SELECT c FROM rebuilt) FROM convs),
    nodes AS (
      SELECT path, len(path) AS depth, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
      FROM prefixes GROUP BY path),
    linked AS (
      SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.path[:n.depth] = n.path) AS n_children
      FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[:n.depth - 1]),
    above AS (SELECT path[:unnest(range(0, depth + 1))] AS path, n_children = 0 AS leaf, (n_convs - 1) * chars AS saved FROM linked),
    sums AS (SELECT path, count(*) FILTER (WHERE leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM above GROUP BY path)
    SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
    FROM linked JOIN sums USING (path)
    """
