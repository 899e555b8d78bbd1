"""The record tables as views of an order-and-part star schema.

Used by tests, checks and the benchmark, which have no health records. Every
table is derived from whole star tables by column expressions; the rules are
given in FIXTURES.md.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortloom.operators.events import coded_events

# Columns used here; a given schema spares a look at the files before each scan.
_SCHEMAS = {
    "nation": "n_nationkey int, n_name string",
    "customer": "c_custkey bigint, c_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_linenumber int, l_shipdate timestamp_ntz",
}
STUDY_END = date(2001, 6, 1)
CONDITION, OUTCOME, SECOND_OUTCOME = "1-URGENT", "2-HIGH", "3-MEDIUM"


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    folder: str

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    def patients(self) -> DataFrame:
        key = F.col("c_custkey")

        def dated(remainder: int, start: date, width: int):
            # Some patients have both leaving dates.
            offset = (key % width).cast("int")
            return F.when((key % 10 == remainder) | (key % 7 == 5), F.date_add(F.lit(start), offset))

        return self.raw("customer").select(
            key.alias("patid"),
            F.col("c_nationkey").alias("pracid"),
            F.when(key % 20 == 0, 0).otherwise(1).alias("acceptable"),
            (1 + key % 2).cast("int").alias("gender"),
            (1915 + key % 37).cast("int").alias("yob"),
            F.when(key % 4 == 0, (1 + key % 12).cast("int")).alias("mob"),
            dated(3, date(1999, 1, 1), 900).alias("regenddate"),
            dated(6, date(1999, 6, 1), 700).alias("emis_ddate"),
        )

    def practices(self) -> DataFrame:
        key = F.col("n_nationkey")
        return self.raw("nation").select(
            key.alias("pracid"),
            F.when(key % 5 != 0, F.date_add(F.lit(date(2000, 6, 1)), (30 * key).cast("int"))).alias("lcd"),
        )

    def observations(self, with_practice: bool = False) -> DataFrame:
        """Events; their own practice id costs a join and is left out unless asked for."""
        key = F.col("o_orderkey")
        events = self.raw("orders").select(
            *([key] if with_practice else []),
            F.col("o_custkey").alias("patid"),
            F.when(F.col("o_orderkey") % 53 != 0, F.col("o_orderdate").cast("date")).alias("obsdate"),
            F.col("o_orderpriority").alias("medcodeid"),
        )
        if not with_practice:
            return events
        practice = self.raw("customer").select(F.col("c_custkey").alias("patid"), "c_nationkey")
        # Every third event was recorded at another practice than the patient's.
        moved = F.when(key % 3 == 0, 1).otherwise(0)
        pracid = ((F.col("c_nationkey") + moved) % 25).cast("int").alias("pracid")
        return events.join(practice, "patid").select("patid", pracid, "obsdate", "medcodeid")

    def drug_issues(self, codes: DataFrame | None = None) -> DataFrame:
        """Prescriptions; with ``codes``, lines are filtered before they meet their order."""
        lines = self.raw("lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"),
            F.when(F.col("l_orderkey") % 41 != 0, F.col("l_shipdate").cast("date")).alias("issuedate"),
            F.col("l_partkey").cast("string").alias("prodcodeid"),
        )
        if codes is not None:
            lines = coded_events(lines, codes, "prodcodeid")
        orders = self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("patid"))
        return lines.join(orders, "o_orderkey").select("patid", "issuedate", "prodcodeid")

    def medical_dictionary(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("medcodeid"),
            F.col("p_name").alias("term"),
            F.col("p_brand").alias("original_code"),
            F.col("p_type").alias("concept_id"),
        )

    def product_dictionary(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").cast("string").alias("prodcodeid"),
            F.col("p_name").alias("term"),
            F.col("p_type").alias("substance"),
        )

    def exposure_codes(self) -> DataFrame:
        """The exposure's code list: which products count as the drug under study."""
        return self.raw("part").where(F.col("p_partkey") % 200 == 7).select(
            F.col("p_partkey").cast("string").alias("code")
        )

    def med_codes(self, *codes: str) -> DataFrame:
        values = ", ".join(f"('{c}')" for c in codes)
        return self.spark.sql(f"SELECT code FROM VALUES {values} AS codes(code)")

    def condition_events(self) -> DataFrame:
        return coded_events(self.observations(), self.med_codes(CONDITION), "medcodeid")

    def outcome_events(self, code: str = OUTCOME) -> DataFrame:
        return coded_events(self.observations(), self.med_codes(code), "medcodeid")

    def exposure_events(self) -> DataFrame:
        return self.drug_issues(self.exposure_codes())
