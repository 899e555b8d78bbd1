"""Near-duplicate vectors by binary codes of random rotations.

A vector is turned by random rotations; the signs are its code. The code of the first
rotation and a correction factor give an unbiased estimate of inner products with a
known error, so exact cosines are computed only for pairs whose upper bound reaches the
threshold. Bands of sign bits bring candidates together: their length grows with the
logarithm of the number of vectors, their number follows from the share of pairs right at the
threshold that may be missed.

Equal vectors are one node with a weight. Large band groups are split into blocks, and
each pair of blocks is a group of its own. A pair of nodes is counted in the first band
it shares, so links are summed up by node and never listed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import partitions, smallest_reachable, sorted_groups
from cohortloom.session import stage

THRESHOLD = 0.95
#: Share of the pairs right at the threshold that the bands may miss.
MISSED = 1e-3
#: Standard errors of an estimate that are added before a pair is given up.
SURE = 4.0
BLOCK_ROWS = 2048
#: Rows of a group up to which pairs are formed row by row instead of as a matrix.
SMALL = 48


def band_shape(rows: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors."""
    bits = min(31, max(8, math.ceil(math.log2(max(2, rows))) + 2))
    agree = 1 - math.acos(threshold) / math.pi
    return bits, math.ceil(math.log(MISSED) / math.log(1 - agree**bits))


@lru_cache(maxsize=4)
def rotations(size: int, bits: int) -> np.ndarray:
    """At least ``bits`` rows: random rotations of ``size`` dimensions, one below the other."""
    rng = np.random.default_rng(size)
    blocks = [np.linalg.qr(rng.normal(size=(size, size)))[0] for _ in range(-(-bits // size))]
    return np.concatenate(blocks)


def unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / scale
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def band_keys(turned: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The sign bits of each band as one integer, a row for each vector."""
    signs = (turned[:, : bits * bands] > 0).reshape(len(turned), bands, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def code_and_factor(turned: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the first rotation, and the inner product of a vector with its own code."""
    first = turned[:, :size]
    return np.where(first > 0, 1.0, -1.0), np.abs(first).sum(axis=1) / math.sqrt(size)


def upper_bounds(dots: np.ndarray, factor: np.ndarray, size: int) -> np.ndarray:
    """The estimate of the cosine plus its confidence bound; ``dots``: of codes with turned vectors."""
    error = np.sqrt(np.maximum(1 - factor**2, 0)) / factor / math.sqrt(max(size - 1, 1))
    return dots / (math.sqrt(size) * factor) + SURE * error


def as_matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).astype(np.float64).reshape(len(column), -1)


def by_dimension(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    sizes = batch.column("size").to_numpy()
    for size in np.unique(sizes):
        yield batch.filter(pa.array(sizes == size))


def nodes_of(vectors: DataFrame, kind: str) -> DataFrame:
    """``(vec_id, node)``: rows that may link; equal vectors share a node."""
    good = (
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    node = F.xxhash64(F.col("embedding").cast(f"array<{kind}>"))
    return vectors.select("vec_id", F.when(F.coalesce(good, F.lit(False)), node).alias("node"), "embedding")


def index(nodes: DataFrame, kind: str, bits: int, bands: int) -> DataFrame:
    """``(node, weight, size, vector, code, factor, keys)``: every node with its code, factor and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_dimension(whole):
                if not batch.num_rows:
                    continue
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                size = flat.shape[1]
                turned = unit(flat.astype(np.float64)) @ rotations(size, bits * bands).T
                code, factor = code_and_factor(turned, size)
                keys = band_keys(turned, bits, bands) + (np.arange(bands) << 32) + (size << 44)
                yield pa.RecordBatch.from_pydict({
                    "node": batch.column("node"), "weight": batch.column("weight"),
                    "size": pa.array([size] * len(flat), pa.int32()),
                    "vector": pa.array([v.tobytes() for v in flat.astype(KINDS[kind])], pa.binary()),
                    "code": pa.array([c.tobytes() for c in np.packbits(code > 0, axis=1)], pa.binary()),
                    "factor": pa.array(factor, pa.float64()),
                    "keys": pa.array(list(keys), pa.list_(pa.int64())),
                })

    held = nodes.select("node", "weight", F.size("embedding").alias("size"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    return held.mapInArrow(run, "node long, weight long, size int, vector binary, code binary, factor double, keys array<bigint>")


KINDS = {"float": "<f4", "double": "<f8"}


class Group:
    """Rows that share a band: their links are found, counted and joined into local components."""

    def __init__(self, batch: pa.RecordBatch, kind: str, bits: int, bands: int, threshold: float):
        self.threshold, self.size = threshold, int(batch.column("size")[0].as_py())
        self.vectors = unit(as_matrix(batch.column("vector"), kind))
        turned = self.vectors @ rotations(self.size, bits * bands).T
        self.keys = band_keys(turned, bits, bands)
        self.turned = turned[:, : self.size].astype(np.float32)
        packed = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.code = (np.unpackbits(packed, axis=1, count=self.size).astype(np.float32) * 2 - 1)
        self.factor = batch.column("factor").to_numpy()

    def first_shared(self, a: np.ndarray, b: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Whether ``band`` is the first band that the rows ``a`` and ``b`` share."""
        good = np.ones(len(a), bool)
        for low in range(0, len(a), 1 << 15):
            part = slice(low, low + (1 << 15))
            good[part] = (self.keys[a[part]] == self.keys[b[part]]).argmax(axis=1) == band[part]
        return good

    def links(self, a: np.ndarray, b: np.ndarray, dots: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of rows whose cosine reaches the threshold and which no earlier band brings together."""
        near = upper_bounds(dots, self.factor[a], self.size) >= self.threshold
        a, b, band = a[near], b[near], band[near]
        keep = np.empty(len(a), bool)
        for low in range(0, len(a), 1 << 15):
            part = slice(low, low + (1 << 15))
            keep[part] = np.einsum("ij,ij->i", self.vectors[a[part]], self.vectors[b[part]]) >= self.threshold
        a, b, band = a[keep], b[keep], band[keep]
        keep = self.first_shared(a, b, band)
        return a[keep], b[keep]


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row number reachable by pairs ``a, b`` of ``n`` rows."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def group_links(indexed: DataFrame, kind: str, bits: int, bands: int, threshold: float) -> DataFrame:
    """``(node, root, links)`` by band group: links counted with weights, ``root`` a node it is joined to."""
    keyed = indexed.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    own = keyed.join(sizes, "key").select("key", "node", blocks.alias("blocks"))
    own = own.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each pair of blocks is a group: a row goes where its block is one of the two.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    spread = own.select("key", "node", "block", other).select(
        "key", "node", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")
    )
    parts = partitions(indexed.sparkSession)
    rows = (
        spread.join(indexed.drop("keys"), "node")
        .repartition(parts, "key", "low", "high")
        .sortWithinPartitions("key", "low", "high", "block", "node")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in sorted_groups(batches, ("key", "low", "high")):
            for part in by_dimension(whole):
                yield found(part)

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        group = Group(batch, KINDS[kind], bits, bands, threshold)
        key, low, high, block = (batch.column(c).to_numpy() for c in ("key", "low", "high", "block"))
        band = (key >> 32) & 0xFFF
        n = batch.num_rows
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        ends = np.append(starts[1:], n)
        end_of = np.repeat(ends, ends - starts)
        sizes = ends - starts
        pairs_a, pairs_b = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for gap in range(1, int(sizes[sizes <= SMALL].max(initial=1))):
            a = np.flatnonzero(small[: n - gap] & (np.arange(n - gap) + gap < end_of[: n - gap]))
            a = a[(low[a] == high[a]) | (block[a] != block[a + gap])]
            dots = np.einsum("ij,ij->i", group.code[a], group.turned[a + gap])
            x, y = group.links(a, a + gap, dots, band[a])
            pairs_a.append(x)
            pairs_b.append(y)
        for s, e in zip(starts[sizes > SMALL], ends[sizes > SMALL]):
            # Two different blocks: rows of the first against those of the second.
            middle = s + int(np.searchsorted(block[s:e], high[s])) if low[s] != high[s] else s
            for x in range(s, middle if middle > s else e, 512):
                top = min(x + 512, middle if middle > s else e)
                right = middle if middle > s else x
                dots = group.code[x:top] @ group.turned[right:e].T
                near = np.argwhere(upper_bounds(dots, group.factor[x:top, None], group.size) >= threshold)
                a, b = near[:, 0] + x, near[:, 1] + right
                keep = a < b
                a, b = a[keep], b[keep]
                x_, y_ = group.links(a, b, dots[a - x, b - right], band[a])
                pairs_a.append(x_)
                pairs_b.append(y_)
        a, b = np.concatenate([*pairs_a, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*pairs_b, np.empty(0, np.int64)]).astype(np.int64)
        weight = batch.column("weight").to_numpy()
        links = np.bincount(a, weight[b], n) + np.bincount(b, weight[a], n)
        node = batch.column("node").to_numpy()
        linked = np.flatnonzero(links)
        return pa.RecordBatch.from_pydict({
            "node": pa.array(node[linked], pa.int64()),
            "root": pa.array(node[local_roots(n, a, b)][linked], pa.int64()),
            "links": pa.array(links[linked].astype(np.int64), pa.int64()),
        })

    return rows.mapInArrow(run, "node long, root long, links long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for each of ``vectors (vec_id, embedding)``.

    Vectors link if their cosine in double precision is at least ``threshold``. Those
    that are null, zero or hold null or non-finite components, and rows without an id,
    link with nothing; vectors of different dimensions neither. ``component_id`` is the
    smallest id reachable, null without an id; such rows are kept. Repeated rows are
    vectors of their own and count as links of each other.
    """
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    known = stage(nodes_of(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), kind), "vectors")
    nodes = known.where(F.col("node").isNotNull()).groupBy("node").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("first_id"), F.first("embedding").alias("embedding")
    )
    nodes = stage(nodes, "vector-nodes")
    bits, bands = band_shape(nodes.count(), threshold)
    indexed = stage(index(nodes, kind, bits, bands), "vector-index")
    joined = stage(group_links(indexed, kind, bits, bands, threshold), "vector-links")
    counts = joined.groupBy("node").agg(F.sum("links").alias("links"))
    edges = joined.where("node <> root").select(F.least("node", "root").alias("a"), F.greatest("node", "root").alias("b")).distinct()
    labels = smallest_reachable(nodes.select(F.col("node").alias("id")), edges, "vector-components").toDF("node", "component")
    spread = nodes.select("node", "weight", "first_id").join(labels, "node")
    smallest = spread.groupBy("component").agg(F.min("first_id").alias("component_id"))
    final = spread.join(smallest, "component").join(counts, "node", "left").select(
        "node", "component_id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return (
        known.select("vec_id", "node").join(final, "node", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b
), least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n USING (vec_id) JOIN least USING (vec_id)
"""
