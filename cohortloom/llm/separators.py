"""Token counts from flat token files that have no index.

The files hold unsigned 16-bit little-endian ids and nothing else. They are read
in blocks of fixed size that take no notice of documents; each block finds its
separators with one vectorised comparison, and a prefix scan over the blocks
stitches the documents that cross their borders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm.common import by_size, new_folder
from cohortloom.llm.tokens import encoded, tokenizer_path
from cohortloom.session import stage

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 20
FILE_BYTES = 1 << 25


def write_flat(docs: DataFrame, folder: str, path: str | None = None, separator: int = SEPARATOR) -> DataFrame:
    """Encode ``docs (doc_id, text)`` into flat files in ``folder``, in the order in which Spark reads them.

    Returns a stored row per document: ``(doc_id, file, ordinal)``. The strings of
    special tokens in a text are ordinary text, so the separator occurs only at
    the end of a document. A null text is empty.
    """
    path = path or tokenizer_path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from cohortloom.llm.common import write_file

        part, number, kept, size, ordinal = TaskContext.get().partitionId(), 0, [], 0, 0
        for batch in by_size(batches):
            names, places = [], []
            for ids in encoded(batch.column("text").to_pylist(), path, separator, literal=True):
                if size >= FILE_BYTES:
                    write_file(folder, f"part-{part:06d}-{number:06d}.bin", kept)
                    number, kept, size, ordinal = number + 1, [], 0, 0
                names.append(f"part-{part:06d}-{number:06d}.bin")
                places.append(ordinal)
                ordinal += 1
                kept.append(ids.astype("<u2").tobytes())
                size += len(kept[-1])
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "file": pa.array(names, pa.string()), "ordinal": pa.array(places, pa.int64())}
            )
        if kept:
            write_file(folder, f"part-{part:06d}-{number:06d}.bin", kept)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stage(rows.mapInArrow(write, "doc_id long, file string, ordinal long"), "flat-documents")


def blocks(spark: SparkSession, folder: str, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(file, block, first, size)`` of every block; the names and sizes come from Spark's file listing."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length")
    return (
        files.select(
            F.element_at(F.split("path", "/"), -1).alias("file"), F.floor(F.col("length") / 2).alias("n")
        )
        .where("n > 0")
        .select("file", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / tokens))).alias("block"))
        .select("file", "block", (F.col("block") * tokens).alias("first"), F.least(F.lit(tokens), F.col("n") - F.col("block") * tokens).alias("size"))
    )


def scan_blocks(where: DataFrame, folder: str, separator: int = SEPARATOR) -> DataFrame:
    """The places in its file of the separators of each block."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    ids = np.frombuffer(source.read_at(2 * row["size"], 2 * row["first"]), "<u2")
                found = np.flatnonzero(ids == separator) + row["first"]
                yield pa.RecordBatch.from_pydict({
                    "file": [row["file"]], "block": pa.array([row["block"]], pa.int64()),
                    "ends": pa.array([found], pa.list_(pa.int64())),
                })

    spread = where.repartition(max(1, where.sparkSession.sparkContext.defaultParallelism), "file", "block")
    return spread.mapInArrow(scan, "file string, block long, ends array<bigint>")


def stitch(scanned: DataFrame) -> DataFrame:
    """``(file, ordinal, start, n_tokens)`` of the documents of each file.

    A prefix scan gives each block the number of separators before it and the place
    of the last one, so a document may begin any number of blocks before its end.
    The scan sees one row per block; places stay inside the block's row.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = scanned.select(
        "file", "block", "ends",
        F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.try_element_at("ends", F.lit(-1))).over(before), F.lit(-1)).alias("last"),
    ).where(F.size("ends") > 0)
    previous = F.concat(F.array("last"), F.slice("ends", 1, F.size("ends") - 1))
    return (
        carried.select("file", "seen", F.posexplode(F.arrays_zip(previous.alias("p"), F.col("ends").alias("e"))))
        .select(
            "file", (F.col("seen") + F.col("pos")).alias("ordinal"),
            (F.col("col.p") + 1).alias("start"), (F.col("col.e") - F.col("col.p") - 1).alias("n_tokens"),
        )
    )


def token_counts(docs: DataFrame, path: str | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``(doc_id, file, ordinal, start, n_tokens)`` of every document, counted in flat files.

    ``n_tokens`` leaves out the separator, ``start`` is the place in the file. Null
    and empty texts count 0; repeated rows count once each; no rows give none.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "flat")
    written = write_flat(docs, folder, path)
    counted = stitch(scan_blocks(blocks(spark, folder, block_tokens), folder))
    # Both sides grow with the documents and are hardly larger than their blocks, so neither may be broadcast.
    return written.join(counted.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
