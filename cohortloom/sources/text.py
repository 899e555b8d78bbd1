"""Delimited dictionaries and code lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cohortloom.functions.text import BYTE_ORDER_MARK, clean_code
from cohortloom.sources.tables import LONG, TEXT, table

# The two published dictionary layouts.
MEDICAL_DICTIONARY = table(
    medcodeid=TEXT, observations=LONG, original_code=TEXT, cleansed_code=TEXT, term=TEXT,
    concept_id=TEXT, description_id=TEXT, release=TEXT, category_id=TEXT,
)
PRODUCT_DICTIONARY = table(
    prodcodeid=TEXT, dmdid=TEXT, term=TEXT, product_name=TEXT, formulation=TEXT, route=TEXT,
    substance=TEXT, strength=TEXT, bnf_chapter=TEXT, drug_issues=LONG,
)
_DICTIONARIES = {"med": MEDICAL_DICTIONARY, "prod": PRODUCT_DICTIONARY}

# Header names of dictionary files, spelled without punctuation or case.
_HEADER = {
    "medcodeid": "medcodeid",
    "observations": "observations",
    "originalreadcode": "original_code",
    "cleansedreadcode": "cleansed_code",
    "term": "term",
    "snomedctconceptid": "concept_id",
    "snomedctdescriptionid": "description_id",
    "release": "release",
    "emiscodecategoryid": "category_id",
    "prodcodeid": "prodcodeid",
    "dmdid": "dmdid",
    "termfromemis": "term",
    "productname": "product_name",
    "formulation": "formulation",
    "routeofadministration": "route",
    "drugsubstancename": "substance",
    "substancestrength": "strength",
    "bnfchapter": "bnf_chapter",
    "drugissues": "drug_issues",
}


# What stands for a missing cell in the published files.
NULL_TEXT = "NA"


def _ends_in_quotes(sep: str) -> tuple[str, str]:
    """Expressions for lines that end inside a quoted cell: begun outside of one, begun inside one.

    A quote opens a cell only as its first character; after the closing quote the cell goes
    on to the separator. Nothing is tried twice, so long lines take time with their length.
    """
    s = "\\x{%x}" % ord(sep)
    quoted = '[^"]*+(?:""[^"]*+)*+'
    rest = f'(?:(?:"{quoted}"[^{s}]*+|[^"{s}][^{s}]*+)?+{s})*+"{quoted}\\z'
    return f"^{rest}", f'^{quoted}(?:\\z|"[^{s}]*+{s}{rest})'


def _running(w, start: Column | None = None) -> Column:
    """Whether the lines or blocks up to each row end inside a cell, from ``flip`` and ``fixed``.

    ``fixed`` is how a row ends whatever came before, or NULL; ``flip`` tells that it turns
    inside to outside and back. NULL where no row is fixed, unless ``start`` is given.
    """
    turns = F.sum("flip").over(w)
    since = F.last(F.col("fixed") + F.col("_turns"), ignorenulls=True).over(w)
    known = since if start is None else F.coalesce(since, start)
    return F.pmod(known + turns, F.lit(2))


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """The records of delimited text, without each file's header, as ``record``, from any splits.

    A line break inside a quoted cell belongs to its record. Each line either leaves things
    as they are, ends outside or inside a cell by itself, or swaps the two; such steps compose,
    so a block's lines become one row, a file's blocks are followed in order over one row a
    block, and each block then knows how it begins. Only records of several lines are put
    together by a grouping. Lines end in a line feed, or carriage return and line feed.
    Empty lines outside of cells are no records. Rows come in no order.
    """
    outside, inside = _ends_in_quotes(sep)
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.regexp_replace("value", f"^{BYTE_ORDER_MARK}", "").alias("value"),
    )
    from_out, from_in = F.col("value").rlike(outside), F.col("value").rlike(inside)
    lines = lines.select(
        "*",
        (from_out & ~from_in).cast("int").alias("flip"),
        F.when(from_out == from_in, from_out.cast("int")).alias("fixed"),
    )
    in_block = Window.partitionBy("file", "block").orderBy("at")
    upto = in_block.rowsBetween(Window.unboundedPreceding, 0)
    stepped = lines.withColumn("_turns", F.sum("flip").over(upto))

    # One row per block: as a step of its own.
    last = F.max_by(F.struct("fixed", "_turns"), F.when(F.col("fixed").isNotNull(), F.col("at")))
    blocks = stepped.groupBy("file", "block").agg(
        F.sum("flip").alias("all_turns"), last.alias("last"), F.max("at").alias("_at")
    ).select(
        "file",
        "block",
        F.pmod(F.col("last.fixed") + F.col("last._turns") + F.col("all_turns"), F.lit(2)).alias("fixed"),
        F.pmod("all_turns", F.lit(2)).alias("flip"),
    )
    in_file = Window.partitionBy("file").orderBy("block")
    blocks_upto = in_file.rowsBetween(Window.unboundedPreceding, 0)
    begun = (
        blocks.withColumn("_turns", F.sum("flip").over(blocks_upto))
        .withColumn("ends", _running(blocks_upto, F.lit(0)))
        .select("file", "block", F.coalesce(F.lag("ends").over(in_file), F.lit(0)).alias("begins"))
    )
    known = (
        stepped.join(begun, ["file", "block"])
        .withColumn("ends", _running(upto, F.col("begins")))
        .withColumn("held", F.coalesce(F.lag("ends").over(in_block), F.col("begins")) == 1)
        .withColumn("opens", ~F.col("held") & (F.col("ends") == 1))
    )

    # A line inside a cell belongs to the last line that opened one, here or in an earlier block.
    opened = F.when(F.col("opens"), F.struct("block", "at"))
    latest = known.groupBy("file", "block").agg(F.max(opened).alias("opened"))
    earlier = latest.select(
        "file",
        "block",
        F.last("opened", ignorenulls=True).over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
    )
    text = F.regexp_replace("value", "\r\\z", "")
    blank = ~F.col("held") & (text == "")
    placed = (
        known.withColumn("first", F.min(F.when(~blank, F.col("at"))).over(Window.partitionBy("file", "block")))
        .withColumn("key", F.last(opened, ignorenulls=True).over(upto))
        .where(~blank)
    )
    header = (F.col("key.block") == 0) & (F.col("key.at") == F.col("first"))
    whole = placed.where(~F.col("held") & ~F.col("opens") & ~((F.col("block") == 0) & (F.col("at") == F.col("first"))))
    parts = (
        placed.where(F.col("held") | F.col("opens"))
        .join(earlier, ["file", "block"])
        .withColumn("key", F.coalesce("key", "earlier"))
        .groupBy("file", "key")
        .agg(
            F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("lines"),
            F.bool_or(F.coalesce(header & (F.col("block") == 0), F.lit(False))).alias("header"),
        )
        .where(~F.col("header"))
    )
    joined = F.regexp_replace(F.array_join("lines.value", "\n"), "\r\\z", "")
    return whole.select(text.alias("record")).unionByName(parts.select(joined.alias("record")))


def _read_text(spark: SparkSession, path: str, sep: str, null_text: str) -> DataFrame:
    """All columns as text. The header is read by the CSV reader, the records from any splits."""
    options = {"sep": sep, "quote": '"', "escape": '"', "nullValue": null_text, "multiLine": True}
    header = spark.read.options(header=True, **options).csv(path).columns
    cells = [f"_{k}" for k in range(len(header))]
    schema = ", ".join(f"{c} string" for c in cells)
    parsed = F.from_csv("record", schema, {k: str(v).lower() if v is True else v for k, v in options.items()})
    df = read_records(spark, path, sep).select(parsed.alias("cells")).select(*[f"cells.{c}" for c in cells])
    return df.toDF(*[c.strip(BYTE_ORDER_MARK + "\r ") for c in header])


def read_dictionary(
    spark: SparkSession, path: str, kind: str, sep: str = "\t", null_text: str = NULL_TEXT
) -> DataFrame:
    """Medical (``med``) or product (``prod``) dictionary, matched by header name.

    Ids stay text. A column the file lacks is NULL; other columns are left out.
    """
    schema = _DICTIONARIES[kind]
    raw = _read_text(spark, path, sep, null_text)
    found = {}
    for column in raw.columns:
        plain = "".join(ch for ch in column.lower() if ch.isalnum())
        target = column if column in schema.names else _HEADER.get(plain)
        if target:
            found.setdefault(target, column)
    return raw.select(
        *[
            (F.col(f"`{found[f.name]}`") if f.name in found else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema
        ]
    )


def read_code_list(
    spark: SparkSession,
    path: str,
    sep: str = ",",
    column: str | None = None,
    keep: list[str] | None = None,
    null_text: str = NULL_TEXT,
) -> DataFrame:
    """One code per row as ``code``, with the ``keep`` columns.

    Byte-order mark, carriage returns and blank rows go. In a ragged file, where
    unquoted separators shift later cells, keep only columns before the text.
    """
    raw = _read_text(spark, path, sep, null_text)
    source = column or raw.columns[0]
    return raw.select(
        clean_code(F.col(f"`{source}`")).alias("code"), *[F.col(f"`{c}`") for c in keep or []]
    ).where(F.col("code").isNotNull())


def write_code_list(
    df: DataFrame, path: str, sep: str = ",", mode: str = "errorifexists", null_text: str = NULL_TEXT
) -> None:
    """Delimited text with a header; cells holding separators, quotes or line breaks are quoted.

    Blanks at either end of a cell stay. A cell that reads ``null_text`` comes back as
    NULL: where such cells occur, write and read with another one.
    """
    (
        df.write.mode(mode)
        .option("header", True)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", null_text)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
