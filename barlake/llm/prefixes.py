"""Conversation prefix trie: nodes for every distinct beginning of conversations, with subtree sums.

Turns are numbered within their conversation, and every conversation is rebuilt: it takes the first
turns of the conversation that opens its hundred, then its own later turns. Sorted by conversation and
turn, rows pass once through tasks that chain SHA-256 digests: the digest of the first d turns is that
of the digest of d - 1 turns and the d-th turn's own. Every prefix is a row; a node is a group of rows
by (depth, digest), counted before the shuffle, so that a beginning shared by a third of all
conversations is one row a task.

A node is known by its smallest member and its depth, and all its ancestors lie on that member's own
path. So the paths, joined with their nodes, are read once by conversation: what the nodes that a
conversation represents add to the subtree sums is exploded to all their ancestors. Nodes with equal
members follow one another on a path and form one run; sums are exploded to runs, and a node's place
in its run does the rest. A conversation gives no more rows than it has turns, where rows for each
pair of node and ancestor would grow with the square of its length.

Members that end at a node are joined in blocks of ids, and the blocks pass through the digest in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from barlake.llm.storage import durable, finished

OPENING = 100  # conversations with ids from a multiple of this up share that one's first turns
MOST_SHARED = 6  # the number of shared turns is a checksum modulo this
ENDS_BLOCK = 4096  # ids in a block
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, size): a conversation's turns in order from 0, by digest and code points."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    framed = F.concat(F.length(role.cast("binary")).cast("string"), F.lit(":"), role, text)  # no two turns give one string
    own = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.unhex(F.sha2(framed, 256)).alias("digest"), F.length(text).cast("long").alias("size"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest")
    return own.select("conv_id", (F.row_number().over(order) - 1).alias("at"), "digest", "size")


def shared_turns(conv_id: Column) -> Column:
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED))


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, at, digest, size) of the rebuilt conversations; ``at`` orders them, with gaps."""
    base = F.col("conv_id") - F.col("conv_id") % OPENING
    own = turns.filter((base == F.col("conv_id")) | (F.col("at") >= shared_turns(F.col("conv_id"))))
    heads = turns.filter((base == F.col("conv_id")) & (F.col("at") < MOST_SHARED - 1)).withColumnRenamed("conv_id", "base")
    takers = turns.filter((F.col("at") == 0) & (base != F.col("conv_id"))).select("conv_id", base.alias("base"), shared_turns(F.col("conv_id")).alias("take"))
    # A base has at most 100 takers on either side of zero and gives each at most five turns.
    lent = takers.filter("take > 0").join(heads, "base").filter("at < take").select("conv_id", "at", "digest", "size")
    return own.unionByName(lent)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefixes of conversations from their turns in order; a row is held until the next one tells whether it ends."""
    held: tuple | None = None
    for batch in batches:
        out = []
        for conv, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "size")), strict=True):
            more = held is not None and held[0] == conv
            if held is not None:
                out.append((*held, not more))
            held = (conv, held[1] + 1 if more else 1, hashlib.sha256((held[2] if more else b"") + digest).digest(), size)
        yield _prefix_batch(out)
    if held is not None:
        yield _prefix_batch([(*held, True)])


def _prefix_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "depth": pa.int64(), "digest": pa.binary(), "size": pa.int64(), "last": pa.bool_()}
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], names=list(kinds))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, size, last): one row for each prefix of at least one turn."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "digest", "size")
    return ordered.mapInArrow(_chain, "conv_id long, depth long, digest binary, size long, last boolean")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read paths in the order of depth; give the nodes that each conversation represents, and what it adds to runs.

    Node rows (kind 0): node, depth, parent, n_convs, above = tokens saved by the run's nodes above it.
    Run rows (kind 1): node and n_convs of a run on the path, leaves and saved = what the conversation's
    nodes in or below that run add. A run is a stretch of the path with equal node and n_convs.
    """
    conv, runs, rows, parent = None, [], [], None

    def finished() -> Iterator[tuple]:
        leaves = saved = 0
        for node, n, own_leaves, own_saved in reversed(runs):
            leaves, saved = leaves + own_leaves, saved + own_saved
            if leaves or saved:
                yield (1, node, None, None, n, None, leaves, saved)

    for batch in batches:
        for own, depth, node, n, ends, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "node", "n_convs", "n_ends", "size")), strict=True):
            if own != conv:
                rows += finished()
                conv, runs, parent = own, [], None
            if not runs or (runs[-1][0], runs[-1][1]) != (node, n):
                runs.append([node, n, 0, 0])
            if node == conv:
                rows.append((0, node, depth, parent, n, runs[-1][3], None, None))
                runs[-1][2] += ends == n
                runs[-1][3] += (n - 1) * size
            parent = node
        yield _walk_batch(rows)
        rows = []
    yield _walk_batch(list(finished()))


_WALKED = "kind long, node long, depth long, parent long, n_convs long, above long, leaves long, saved long"


def _walk_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in _WALKED.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def placed(paths: DataFrame) -> DataFrame:
    """Prefixes with their nodes: smallest member, number of members and of those that end there."""
    # Each key is one row of nodes. As they stand in a table, both sides are shuffled for the join alone, and
    # prefixes with a frequent beginning are split where Spark finds them large.
    nodes = durable(paths.groupBy("depth", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"), F.count_if("last").alias("n_ends")), "node-counts")
    return paths.join(nodes, ["depth", "digest"]).drop("digest")


def walked(on_nodes: DataFrame) -> DataFrame:
    """Represented nodes and sums of runs, from ``placed`` prefixes read by path."""
    by_path = on_nodes.repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return by_path.select("conv_id", "depth", "node", "n_convs", "n_ends", "size").mapInArrow(_walk, _WALKED)


def _digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node from its blocks in order, of which one is held at a time."""
    key, running, out = None, None, []
    for batch in batches:
        for node, depth, ids in zip(*(batch.column(c) for c in ("node", "depth", "ids")), strict=True):
            own = (node.as_py(), depth.as_py())
            if own != key:
                if key is not None:
                    out.append((*key, running.hexdigest()))
                key, running = own, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.as_py().encode())
        yield _ends_batch(out)
        out = []
    if key is not None:
        yield _ends_batch([(*key, running.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])


def ends(members: DataFrame) -> DataFrame:
    """(node, depth, ends_sha256) from (node, depth, conv_id) of conversations that end at a node."""
    block = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(ENDS_BLOCK))
    blocks = members.groupBy("node", "depth", block.alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ordered = blocks.repartition("node", "depth").sortWithinPartitions("node", "depth", "block")
    return ordered.select("node", "depth", "ids").mapInArrow(_digest_ends, "node long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """``nodes`` of the conversations, written once; the tables on the way are removed."""
    return finished(lambda: nodes(conversations), "nodes").select(NODE)


def nodes(conversations: DataFrame) -> DataFrame:
    """Nodes of the prefix trie of rebuilt conversations (conv_id, turn, role, text).

    A conversation's turns are ordered by turn, null first; ties by a digest of role and text. Null roles
    and texts are empty. Conversation c takes the first h turns of conversation c - c % 100 (none if there
    is no such conversation) and then its own turns after its first h, where h = crc32(c) % 6; one that
    opens its hundred stays as it is. Per node: conv_id, its smallest member; depth; parent_conv_id (root:
    null); n_convs, members; n_children; n_leaves, childless nodes in its subtree, itself included;
    saved_tokens, summed over its subtree, (members - 1) times the code points of each node's last text;
    ends_sha256, over the decimal ids of members with no more turns, ascending, joined by commas.

    Rows without conv_id belong to no conversation. Repeated rows are turns of their own. Conversations
    whose rebuilt form has no turn are members of the root alone. An empty table gives no node, not even
    a root. Further columns are not read.
    """
    turns = durable(numbered(conversations), "turns")
    paths = durable(prefixes(rebuilt(turns)), "prefixes")
    on_nodes = durable(placed(paths), "placed")
    by_path = durable(walked(on_nodes), "walked")

    convs = turns.filter("at = 0").select("conv_id")
    first, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    own = by_path.filter("kind = 0").select("node", "depth", F.coalesce("parent", F.lit(first)).alias("parent"), "n_convs", "above")
    sums = by_path.filter("kind = 1").groupBy("node", "n_convs").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    children = own.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    turnless = convs.join(paths.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ended = on_nodes.filter("last").select("node", "depth", "conv_id").unionByName(turnless.select(F.lit(first).alias("node"), F.lit(0).cast("long").alias("depth"), "conv_id"))

    # The root is one row of sums over all nodes; without turns it is its own leaf.
    spare = on_nodes.filter(F.col("node") == F.col("conv_id")).agg(F.count_if(F.col("n_ends") == F.col("n_convs")).alias("leaves"), F.sum((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    root = spare.select(
        F.lit(first).cast("long").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent"), F.lit(n).cast("long").alias("n_convs"),
        F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"),
    ).filter(F.lit(n > 0))
    below = own.join(sums, ["node", "n_convs"]).select("node", "depth", "parent", "n_convs", "n_leaves", (F.col("saved") - F.col("above")).alias("saved_tokens"))
    every = below.unionByName(root).join(children, ["node", "depth"], "left").join(ends(ended), ["node", "depth"], "left")
    return every.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )


#: Prefixes by list slices; ancestors of a node lie on its smallest member's path.
ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) - 1 AS i,
    sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS x, length(coalesce(text, '')) AS size
  FROM conversations WHERE conv_id IS NOT NULL
), hashed AS (
  SELECT c, c - c % {OPENING} AS base, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda a, d: list_reduce(list_prepend(xor(a, d), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda p, q: xor(p >> 1, (p & 1) * 3988292384::BIGINT)))) % {MOST_SHARED} AS h
  FROM (SELECT DISTINCT c FROM t)
), r AS (
  SELECT t.c, i, x, size FROM t JOIN hashed USING (c) WHERE i >= h OR c = base
  UNION ALL SELECT k.c, i, x, size FROM hashed k JOIN t ON t.c = k.base WHERE k.c <> k.base AND i < h
), lists AS (SELECT c, list(x ORDER BY i) AS xs, list(size ORDER BY i) AS sizes FROM r GROUP BY 1),
p AS (SELECT c, CAST(d AS BIGINT) AS d, sha256(array_to_string(xs[1:d], ',')) AS k, sizes[d] AS size, d = len(xs) AS last FROM (SELECT c, xs, sizes, unnest(range(1, len(xs) + 1)) AS d FROM lists)
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM lists) FROM hashed),
n AS (SELECT d, k, min(c) AS m, count(*) AS n, max(size) AS size, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS e FROM p GROUP BY 1, 2),
up AS (SELECT n.m, n.d, q.d AS pd, q.m AS pm, n.n, n.size FROM n JOIN p ON p.c = n.m AND p.d <= n.d JOIN n q ON q.d = p.d AND q.k = p.k),
kids AS (SELECT pm AS m, pd AS d, count(*) AS kids FROM up WHERE pd = d - 1 GROUP BY 1, 2),
sums AS (SELECT pm AS m, pd AS d, sum((n - 1) * size) AS saved, count(*) FILTER (kids IS NULL) AS leaves FROM up LEFT JOIN kids USING (m, d) GROUP BY 1, 2)
SELECT n.m AS conv_id, n.d AS depth, u.pm AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, e AS ends_sha256
FROM n JOIN sums USING (m, d) LEFT JOIN kids USING (m, d) LEFT JOIN up u ON u.m = n.m AND u.d = n.d AND u.pd = n.d - 1
"""
