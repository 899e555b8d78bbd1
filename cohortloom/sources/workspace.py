"""Named intermediate tables under an analysis prefix."""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from cohortloom.session import list_names, put_text, read_texts, remove_folder

ROWS_PER_KEY = 1_000_000
#: Seconds for which a replaced version is kept for those who read it.
RETAINED = 7 * 24 * 3600
MANIFESTS = "manifests"
PLAIN, CLUSTERED = "plain", "clustered"


def in_slots(keys: list[str], slots: int, wanted: Iterable[int]) -> Column:
    """Whether a row's keys, null ones too, fall into one of ``wanted`` of ``slots`` slots, as buckets are dealt."""
    return F.pmod(F.hash(*[F.col(f"`{k}`") for k in keys]), F.lit(slots)).isin(sorted(set(wanted)))


class Workspace:
    """Computes a named table once and reads it back afterwards.

    Tables live below ``root/prefix`` on shared storage, so later sessions find
    them. Every write is a version: a folder of its own, which becomes the table when
    its manifest, a small JSON file, is put in place in one step. The manifest names the
    bucketing keys, the number of buckets, the schema and the rows, and a version is
    always read by its manifest, whatever a later caller asks for. Replaced versions stay
    for ``retained`` seconds, so that running readers end on what they opened.
    ``cluster_by`` buckets a table: later joins and groupings on the same columns
    and bucket count need no shuffle.
    """

    def __init__(self, spark: SparkSession, root: str, prefix: str, retained: float = RETAINED):
        self.spark, self.prefix, self.retained = spark, prefix, retained
        self.folder = f"{root}/{prefix}"

    def manifests(self, name: str) -> list[dict]:
        """What is known of each version of ``name``, oldest first."""
        place = f"{self.folder}/{name}/{MANIFESTS}"
        return [json.loads(t) for t in read_texts(self.spark, place, sorted(list_names(self.spark, place)))]

    def cached(
        self,
        name: str,
        df: DataFrame,
        cluster_by: list[str] | None = None,
        buckets: int = 200,
        overwrite: bool = False,
        rows_per_key: int = ROWS_PER_KEY,
    ) -> DataFrame:
        """The stored table ``name``; ``df`` runs only if it is absent or to be replaced.

        A table that is there keeps the layout of its manifest: other keys or another
        number of buckets take effect when it is written anew. A bucket is read by one task.
        A table with a key of more than ``rows_per_key`` rows is therefore written once more,
        unbucketed, and its joins are left to the adaptive skew join. ``df`` may read the
        table it replaces.
        """
        known = self.manifests(name)
        if known and not overwrite:
            return self._open(name, known[-1])
        manifest = self._clustered(name, df, cluster_by, buckets, rows_per_key) if cluster_by else self._plain(name, df)
        put_text(self.spark, f"{self.folder}/{name}/{MANIFESTS}", f"{manifest['version']}.json", json.dumps(manifest))
        self._expire(name, [*known, manifest])
        return self._open(name, manifest)

    def table(self, name: str, version: str | None = None) -> DataFrame:
        """A stored table by name: its newest version, or the one named."""
        known = [m for m in self.manifests(name) if version in (None, m["version"])]
        if not known:
            raise KeyError(name)
        return self._open(name, known[-1])

    def subset(self, name: str, keys: list[str], slots: int, wanted: Iterable[int], version: str | None = None) -> DataFrame:
        """The rows of a stored table whose ``keys`` fall into the ``wanted`` of ``slots`` slots.

        The same keys are kept in every table, stored or not: ``in_slots`` is the test. Of a
        table bucketed by ``keys`` into a multiple of ``slots``, only the files of the wanted
        slots' buckets are read, and it is still read as bucketed.
        """
        known = [m for m in self.manifests(name) if version in (None, m["version"])]
        if not known:
            raise KeyError(name)
        manifest, chosen = known[-1], sorted(set(wanted))
        held = self._open(name, manifest)
        columns = [F.col(f"`{c}`") for c in held.columns]
        if manifest["keys"] == list(keys) and manifest["buckets"] % slots == 0:
            # A bucket is the same hash by the number of buckets, and ends the name of its files.
            bucket = F.regexp_extract(F.col("_metadata.file_name"), r"_(\d+)(?:\..*)?$", 1).cast("int")
            held = held.where(F.pmod(bucket, F.lit(slots)).isin(chosen))
        return held.where(in_slots(keys, slots, chosen)).select(*columns)

    def _place(self, name: str, version: str) -> str:
        return f"{self.folder}/{name}/{version}"

    def _plain(self, name: str, df: DataFrame) -> dict:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-{PLAIN}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self._place(name, version))
        return self._manifest(version, df, seen.get["rows"])

    def _clustered(self, name: str, df: DataFrame, keys: list[str], buckets: int, rows_per_key: int) -> dict:
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}-{CLUSTERED}"
        seen = Observation()
        # One writer per bucket, or every task would write a file per bucket.
        (
            df.observe(seen, F.count(F.lit(1)).alias("rows")).repartition(buckets, *keys)
            .write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", self._place(name, version))
            .saveAsTable(self._table(name, version))
        )
        manifest = self._manifest(version, df, seen.get["rows"], keys, buckets)
        # Buckets hold whole keys, so this count needs no shuffle.
        sizes = self._open(name, manifest).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= rows_per_key:
            return manifest
        plain = self._plain(name, self.spark.read.schema(df.schema).parquet(self._place(name, version)))
        self._forget(name, version)
        return plain

    def _manifest(self, version: str, df: DataFrame, rows: int, keys: list[str] | None = None, buckets: int = 0) -> dict:
        return {"version": version, "keys": keys or [], "buckets": buckets, "rows": rows, "schema": json.loads(df.schema.json())}

    def _table(self, name: str, version: str) -> str:
        # Workspaces of one prefix under different roots share a catalogue.
        root = hashlib.sha256(self.folder.encode()).hexdigest()[:12]
        return f"{self.prefix}_{name}_{root}_{version.replace('-', '_')}"

    def _expire(self, name: str, known: list[dict]) -> None:
        """Delete versions that were replaced long ago, and what failed writes of that time left."""
        limit = time.time_ns() - int(self.retained * 1e9)
        replaced = {m["version"] for m, after in zip(known, known[1:]) if int(after["version"][:20]) <= limit}
        named = {m["version"] for m in known}
        for version in list_names(self.spark, f"{self.folder}/{name}"):
            if version in replaced or version != MANIFESTS and version not in named and int(version[:20]) < limit:
                remove_folder(self.spark, f"{self.folder}/{name}/{MANIFESTS}/{version}.json")
                self._forget(name, version)

    def _forget(self, name: str, version: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self._table(name, version)}`")
        remove_folder(self.spark, self._place(name, version))

    def _open(self, name: str, manifest: dict) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        place = self._place(name, manifest["version"])
        if not manifest["keys"]:
            return self.spark.read.schema(schema).parquet(place)
        # Tell a session that has not seen the table how its files are bucketed.
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        keys = ", ".join(f"`{c}`" for c in manifest["keys"])
        table = self._table(name, manifest["version"])
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS `{table}` ({columns}) USING parquet "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {manifest['buckets']} BUCKETS LOCATION '{place}'"
        )
        return self.spark.table(table)
