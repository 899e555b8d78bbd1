"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm.tokens import powers
from cohortloom.session import discard, shared_folder, stage, stage_measured

BATCH_CHARS = 1 << 19
ARROW_BYTES = 4 << 20
#: Words of 64 bits in a sieve, at most.
SIEVE_WORDS = 1 << 19


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def new_folder(spark: SparkSession, label: str) -> str:
    """A new folder for files of our own beside those Spark stages."""
    where = f"{shared_folder(spark)}/cohortloom/{label}-{uuid.uuid4().hex}"
    system, path = fs.FileSystem.from_uri(where)
    system.create_dir(path, recursive=True)
    return where


def bounded_batches(spark: SparkSession) -> None:
    """Have the session send rows to Python in batches of at most ``ARROW_BYTES``; a smaller bound of the user stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > ARROW_BYTES:
        spark.conf.set(name, f"{ARROW_BYTES}b")


Batches = Iterator[pa.RecordBatch]


def give_back() -> None:
    """Give the free memory of this process, and what can soon be made anew, back to the system."""
    powers.cache_clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def giving_back(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker, which later tasks use too, gives its free memory back to the system."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        give_back()

    return whole


class Workbench:
    """Stages tables and deletes their files at the end of a ``with`` block, after a failure too."""

    def __init__(self):
        self.held: list[DataFrame] = []

    def __enter__(self) -> Workbench:
        return self

    def __exit__(self, *_) -> None:
        for df in self.held:
            discard(df)

    def stage(self, df: DataFrame, label: str) -> DataFrame:
        self.held.append(stage(df, label))
        return self.held[-1]


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Delete each query's shuffle files when it ends, instead of when the driver collects its garbage.

    For queries that store their result; a lost executor during a query still repeats its part.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def sieved(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with a boolean ``_sieved``: true where the ``keys`` are among those of ``wanted``, and in few other rows.

    Keys set bits in at most ``SIEVE_WORDS`` words, which are broadcast. A join decides on
    the marked rows; the others need not be shuffled for it. The keys are columns of the
    same types in both; the more there are in ``wanted``, the more other rows are marked.
    """
    word, bit = F.pmod(F.xxhash64(*keys), F.lit(SIEVE_WORDS)), F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
    words = wanted.select(word.alias("_word"), one.alias("_bits")).groupBy("_word").agg(F.bit_or("_bits").alias("_bits"))
    marked = rows.withColumn("_at", word).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return marked.withColumn("_sieved", F.coalesce(F.col("_bits").bitwiseAND(one) != 0, F.lit(False))).drop("_at", "_word", "_bits")


def write_file(folder: str, name: str, parts: list[bytes]) -> None:
    """Write a whole file under its final name in one step, so that a repeated task replaces it."""
    system, path = fs.FileSystem.from_uri(folder)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        for p in parts:
            out.write(p)
    system.move(part, f"{path}/{name}")


def by_size(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``chars`` bytes of text, or one row."""
    for batch in batches:
        texts = batch.column(column)
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
        low = 0
        while low < batch.num_rows:
            base = sizes[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(sizes, base + chars, side="right")))
            yield batch.slice(low, high - low)
            low = high


def sorted_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Batches of a partition sorted by ``names``, cut anew so that no group of equal names is torn."""
    waiting: list[pa.RecordBatch] = []

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.stack([batch.column(c).to_numpy() for c in names], axis=1)
        same = (held == held[-1]).all(axis=1)
        # The last group may go on in the next batch.
        cut = 0 if same.all() else int(np.flatnonzero(~same)[-1]) + 1
        ended = cut > 0 or (waiting and any(waiting[-1].column(c)[0].as_py() != v for c, v in zip(names, held[0].tolist())))
        if ended:
            if cut:
                waiting.append(batch.slice(0, cut))
            if waiting:
                yield joined()
            waiting = [batch.slice(cut)]
        else:
            waiting.append(batch)
    if waiting:
        yield joined()


def shielded(docs: DataFrame, *named: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with all columns but the named ones under names no operator uses, and those names."""
    names = {c: c if c in named else f"_carried_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def restored(docs: DataFrame, names: dict[str, str]) -> DataFrame:
    return docs.select(*[F.col(n).alias(c) for c, n in names.items()])


def smallest_reachable(nodes: DataFrame, links: DataFrame, label: str = "components") -> DataFrame:
    """``(id, component)``: the smallest id reachable by ``links (a, b)``, for each of ``nodes (id)``.

    Alternating stars: every id hangs its larger neighbours, then all of its
    neighbours, on the smallest one, so the number of rounds grows with the
    logarithm of the longest chain. Each round is stored, no row leaves Spark.
    Links of null or equal ends are ignored; ids without links are their own.
    """
    first = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges, seen = first, None
    while True:
        smaller = _star(_star(edges, keep_larger_only=True), keep_larger_only=False)
        old = edges
        edges, now = stage_measured(
            smaller, f"{label}-star", n=F.count("*"), h=F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        )
        discard(old)
        if now == seen:
            break
        seen = now
    found = edges.select(F.col("b").alias("id"), F.col("a").alias("component"))
    return nodes.select("id").distinct().join(found, "id", "left").select(
        "id", F.coalesce("component", "id").alias("component")
    )


def _star(edges: DataFrame, keep_larger_only: bool) -> DataFrame:
    """One star step on edges ``a < b``; the result has ``a < b`` again."""
    if keep_larger_only:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        around = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if keep_larger_only:
        moved = joined.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b")).union(
            least.select(F.col("m").alias("a"), F.col("u").alias("b"))
        )
    return moved.where("a < b").distinct()
