"""A Merkle manifest of a dataset whose tree is persistent: a change copies a path and shares the rest.

Leaves are numbered within their branch (language) and cut into aligned blocks of
``BLOCK``. A task hashes a block up to its top; the tops are nodes of the next round,
cut into blocks again, until each branch has one node. The nodes of the branches make
up the tree of the root in the same way. Back down, every block is told the siblings
of its top on the way to the root: one row per block, never one per leaf.

A changed leaf makes a version of the tree. Inside its block the version copies the
ancestors of the leaf; above the block it goes on along the siblings handed down. All
other nodes are those of the tree as it was.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import sorted_groups
from cohortloom.operators.numbering import number_rows
from cohortloom.session import discard, stage

LEVELS = 10
BLOCK = 1 << LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 7
#: A sibling on the way up, by its side; an empty step has none.
LEFT, RIGHT, ALONE = "<", ">", ""


def hashed(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """The nodes above at most ``BLOCK`` consecutive ones, level by level up to a single one."""

    def __init__(self, nodes: list[str]):
        self.levels = [nodes]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([hashed(*below[k : k + 2]) for k in range(0, len(below), 2)])

    @property
    def top(self) -> str:
        return self.levels[-1][0]

    @property
    def height(self) -> int:
        return len(self.levels) - 1

    def path(self, place: int) -> list[str]:
        """The siblings of a node and of its ancestors below the top, each after its side."""
        steps = []
        for nodes in self.levels[:-1]:
            other = place ^ 1
            steps.append(ALONE if other >= len(nodes) else (LEFT if other < place else RIGHT) + nodes[other])
            place >>= 1
        return steps


def copied(node: str, path: list[str]) -> list[str]:
    """The new ancestors of a version whose node at the foot of ``path`` is ``node``, from the lowest up."""
    out = []
    for step in path:
        if step[:1] == LEFT:
            node = hashed(step[1:], node)
        elif step[:1] == RIGHT:
            node = hashed(node, step[1:])
        else:
            node = hashed(node)
        out.append(node)
    return out


def field_text(name: str) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = F.col(f"`{name}`").cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: tuple[str, ...], changed: str | None = None, change: Column | None = None) -> Column:
    """The leaf of a row, ``changed`` reading as ``change``."""
    parts = []
    for name in fields:
        if name == changed:
            text = change.cast("string")
            parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
        else:
            parts.append(field_text(name))
    return F.sha2(F.concat(*parts), 256)


def is_tampered() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPER_EVERY == 0, F.lit(False))


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each run of equal ``part``, a number."""
    for batch in sorted_groups(batches, ("part",)):
        part = batch.column("part").to_numpy()
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        for low, high in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(part[low]), batch.slice(low, high - low)


def in_blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """``branch, block, members``: the nodes ``(branch, place, node)`` of each aligned block in order, a row each."""
    member = F.struct("place", "node", *carried)
    return (
        nodes.withColumn("block", F.shiftright("place", LEVELS))
        .groupBy("branch", "block").agg(F.array_sort(F.collect_list(member)).alias("members"))
    )


def opened(blocks: DataFrame, *more: str) -> DataFrame:
    """A row for each member; ``more`` columns come with the first member of a block only.

    The members of a block stay together: they come from one row.
    """
    listed = blocks.select("branch", "block", F.xxhash64("branch", "block").alias("part"), F.posexplode("members").alias("k", "m"), *more)
    first = [F.when(F.col("k") == 0, F.col(c)).alias(c) for c in more]
    return listed.select("branch", "block", "part", "m.*", *first)


def tops(blocks: DataFrame) -> DataFrame:
    """``branch, place, node, alone``: the top of each block as a node of the next round.

    Where a branch has several blocks, all of them rise by ``LEVELS`` levels: the last
    one is hashed alone for the levels it lacks, ``alone`` of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches):
            built = Block(group.column("node").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "branch": group.column("branch").slice(0, 1),
                "place": group.column("block").slice(0, 1),
                "node": pa.array([built.top]),
                "height": pa.array([built.height], pa.int32()),
            })

    found = stage(
        opened(blocks).select("branch", "block", "part", "node").mapInArrow(run, "branch string, place long, node string, height int"), "merkle-tops"
    )
    last = found.groupBy("branch").agg(F.max("place").alias("last"))
    alone = F.when(F.col("last") > 0, F.lit(LEVELS) - F.col("height")).otherwise(0)
    risen = F.when(
        F.col("alone") > 0, F.aggregate(F.sequence(F.lit(1), F.col("alone")), F.col("node"), lambda node, _: F.sha2(node, 256))
    ).otherwise(F.col("node"))
    return found.join(last, "branch").withColumn("alone", alone).select("branch", "place", risen.alias("node"), "alone")


def raised(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of each round above ``blocks`` and ``(branch, node)``, the single node of each branch."""
    rounds = []
    while True:
        above = stage(tops(blocks), "merkle-nodes")
        if not above.agg(F.max("place")).first()[0]:
            return rounds, above.select("branch", "node")
        blocks = stage(in_blocks(above, "alone"), "merkle-blocks")
        rounds.append(blocks)
        discard(above)


def lowered(rounds: list[DataFrame], heads: DataFrame) -> DataFrame:
    """``heads (branch, block, path, subroot, root)`` of the last round's blocks carried down to the lowest blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches):
            nodes = group.column("node").to_pylist()
            built, above = Block(nodes), group.column("path")[0].as_py()
            alone = group.column("alone").to_pylist()
            n = len(nodes)
            yield pa.RecordBatch.from_pydict({
                "branch": group.column("branch"),
                "block": group.column("place"),
                "path": pa.array([[ALONE] * alone[k] + built.path(k) + above for k in range(n)], pa.list_(pa.string())),
                "subroot": pa.array([group.column("subroot")[0].as_py()] * n, pa.string()),
                "root": pa.array([group.column("root")[0].as_py()] * n, pa.string()),
            })

    for blocks in reversed(rounds):
        rows = opened(blocks.join(heads, ["branch", "block"]), "path", "subroot", "root")
        heads = stage(rows.mapInArrow(run, "branch string, block long, path array<string>, subroot string, root string"), "merkle-paths")
    return heads


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, changed: str = "n_chars", keep_copies: bool = False) -> DataFrame:
    """Leaf, roots, proof and the root of the version of each of ``docs``, which has ``fields``, ``doc_id`` and ``lang`` among them.

    A leaf is H of all fields, each ``-`` if null, else ``bytes:value``. Leaves ascend by
    ``doc_id`` (null first; rows of one id by their leaf) within ``lang``; a null language
    is a branch of its own and comes first. Rows that ``is_tampered`` names make a version
    in which ``changed`` is one more; a null stays null and so does its leaf. ``folded_root``
    is the root of the row's version, or of the tree if it makes none, from its leaf and the
    siblings; ``verified`` says whether it is the root. Repeated rows are leaves each; an
    empty table gives no rows. ``keep_copies`` adds ``copies``, the new nodes of the version
    from the leaf to the root, null without one.
    """
    branch = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))
    tampered = leaf_of(fields, changed, F.col(f"`{changed}`") + 1)
    leaves = stage(
        docs.select(
            branch.alias("branch"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(fields).alias("node"),
            F.when(is_tampered(), tampered).alias("tampered"), F.monotonically_increasing_id().alias("row"),
        ),
        "merkle-leaves",
    )
    # The row's own number parts equal rows, so that no run of them must lie in one task.
    numbered = number_rows(leaves, ["branch"], ["doc_id", "node", "row"], "place", window_rows=0, rows=1)
    blocks = stage(in_blocks(numbered, "doc_id", "tampered"), "merkle-blocks")
    rounds, subroots = raised(blocks)

    ranked = stage(number_rows(subroots.withColumn("all", F.lit("")), ["all"], ["branch"], "place", window_rows=0, rows=1), "merkle-subroots")
    upper = stage(
        in_blocks(ranked.select(F.col("all").alias("branch"), "place", "node", F.lit(0).alias("alone")), "alone"), "merkle-blocks"
    )
    more, root = raised(upper)
    above = root.select(
        "branch", F.lit(0).cast("long").alias("block"), F.array().cast("array<string>").alias("path"), F.lit("").alias("subroot"), F.col("node").alias("root")
    )
    ways = lowered([upper, *more], above)
    heads = (
        ranked.select(F.col("branch").alias("name"), F.col("place").alias("block"), F.col("node").alias("top")).join(ways, "block")
        .select(F.col("name").alias("branch"), F.lit(0).cast("long").alias("block"), "path", F.col("top").alias("subroot"), "root")
    )
    paths = lowered(rounds, heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groups_of(batches):
            nodes, bad = group.column("node").to_pylist(), group.column("tampered").to_pylist()
            subroot, root = group.column("subroot")[0].as_py(), group.column("root")[0].as_py()
            above = group.column("path")[0].as_py()
            above_text = "".join(s[1:] for s in above)
            built, n = Block(nodes), len(nodes)
            proofs, folded, copies = [], [], []
            for k in range(n):
                path = built.path(k)
                proofs.append(hashed(*[s[1:] for s in path], above_text))
                node = bad[k] or nodes[k]
                new = [node, *copied(node, path)]
                new += copied(new[-1], above)
                folded.append(new[-1])
                copies.append(new if bad[k] else None)
            columns = {
                "doc_id": group.column("doc_id"),
                "leaf": group.column("node"),
                "subroot": pa.array([subroot] * n, pa.string()),
                "root": pa.array([root] * n, pa.string()),
                "proof_sha256": pa.array(proofs, pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([f == root for f in folded], pa.bool_()),
            }
            if keep_copies:
                columns["copies"] = pa.array(copies, pa.list_(pa.string()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    rows = opened(blocks.join(paths, ["branch", "block"]), "path", "subroot", "root")
    return rows.mapInArrow(run, schema + (", copies array<string>" if keep_copies else ""))


OP13_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, CAST(i AS BIGINT) AS c, 0 AS k FROM range(256) r(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), r AS (
  SELECT doc_id, coalesce('=' || lang, '') AS branch, n_chars, CAST(doc_id AS VARCHAR) AS i, CAST(n_chars AS VARCHAR) AS c, CAST(n_chars + 1 AS VARCHAR) AS x,
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), h AS (
  SELECT doc_id, branch, sha256(coalesce(strlen(i) || ':' || i, '-') || head || coalesce(strlen(c) || ':' || c, '-') || tail) AS leaf,
    sha256(coalesce(strlen(i) || ':' || i, '-') || head || coalesce(strlen(x) || ':' || x, '-') || tail) AS bad,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(i, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
      lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) AS crc
  FROM r, crcs
), l AS (
  SELECT row_number() OVER () AS id, doc_id, branch, leaf, CASE WHEN crc % 7 = 0 THEN bad ELSE leaf END AS start,
    row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY branch) AS n
  FROM h
), tree AS (
  SELECT branch, 0 AS level, place, leaf AS node, n FROM l
  UNION ALL
  SELECT branch, level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM tree WHERE n > 1 GROUP BY branch, level, place // 2, n
), subs AS (
  SELECT branch, node AS subroot, level AS height, row_number() OVER (ORDER BY branch) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1
), upper_tree AS (
  SELECT 0 AS level, place, subroot AS node, n FROM subs
  UNION ALL
  SELECT level + 1, place // 2, sha256(string_agg(node, '' ORDER BY place)), (n + 1) // 2
  FROM upper_tree WHERE n > 1 GROUP BY level, place // 2, n
), top AS (SELECT node AS root, level AS height FROM upper_tree WHERE n = 1
), ways AS (
  SELECT id, k AS step, l.branch, (l.place >> k) AS spot FROM l JOIN subs USING (branch), unnest(range(height)) u(k)
), highways AS (
  SELECT id, subs.height + k AS step, k AS level, (subs.place >> k) AS spot FROM l JOIN subs USING (branch), top, unnest(range(top.height)) u(k)
), steps AS (
  SELECT id, step, node AS sibling, spot & 1 = 1 AS on_left FROM ways LEFT JOIN tree ON tree.branch = ways.branch AND level = step AND place = xor(spot, 1)
  UNION ALL
  SELECT id, step, node, spot & 1 = 1 FROM highways LEFT JOIN upper_tree u ON u.level = highways.level AND u.place = xor(spot, 1)
), fold AS (
  SELECT id, 0 AS step, start AS node FROM l
  UNION ALL
  SELECT id, step + 1, sha256(CASE WHEN sibling IS NULL THEN node WHEN on_left THEN sibling || node ELSE node || sibling END)
  FROM fold JOIN steps USING (id, step)
), folded AS (SELECT id, max_by(node, step) AS folded_root FROM fold GROUP BY id
), proofs AS (SELECT id, sha256(string_agg(coalesce(sibling, ''), '' ORDER BY step)) AS proof FROM steps GROUP BY id)
SELECT doc_id, leaf, subroot, root, coalesce(proof, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM l JOIN subs USING (branch) JOIN folded USING (id) LEFT JOIN proofs USING (id), top
"""
