"""Secret scans over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived that every
matching text fulfils. The index holds, for each trigram any query names, the documents
in which it occurs; postings are intersected by counting, and only candidates meet the
expression itself. A rule without a mandatory trigram scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.matches import matches, none_found, spans, written
from cohortloom.session import stage

#: Strings, and conjunctions of a query, that are followed at most; beyond, a query gets wider.
WIDEST = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret; ``group`` of a match needs at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules. Minimal lengths are part of the expression where no shorter match
# could hide a longer one.
BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
# Published forms of further secrets.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s/:@]{1,64}:[^\s/:@]{1,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def trigram_query(pattern: str) -> frozenset[frozenset[str]]:
    """Conjunctions of lower-case trigrams, one of which every matching text fulfils; empty if none is mandatory."""
    clauses: list[set[str]] = []
    _close(_walk(re._parser.parse(pattern), {""}, clauses), clauses)
    query: set[frozenset[str]] = {frozenset()}
    for clause in clauses:
        parts = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in clause}
        wider = {a | b for a in query for b in parts}
        query = wider if len(wider) <= WIDEST else query
    least = frozenset(a for a in query if not any(b < a for b in query))
    return frozenset() if frozenset() in least else least


def _close(strings: set[str], clauses: list[set[str]]) -> None:
    """A text holds one of ``strings``: mandatory if each has a trigram."""
    if strings and min(map(len, strings)) >= 3:
        clauses.append({s.lower() for s in strings})


def _walk(parsed: Iterable, strings: set[str], clauses: list[set[str]]) -> set[str]:
    """Follow a sequence: one of ``strings`` stands right before the next item, and so on after it."""
    for item in parsed:
        options = _exact([item])
        wider = {a + b for a in strings for b in options} if options is not None else set()
        if options is not None and len(wider) <= WIDEST:
            strings = wider
            continue
        name, value = str(item[0]), item[1]
        if options is None and name in ("SUBPATTERN", "ATOMIC_GROUP"):
            strings = _walk(value[3] if name == "SUBPATTERN" else value, strings, clauses)
            continue
        _close(strings, clauses)
        if options is None and name.endswith("REPEAT") and value[0] >= 1:
            # One turn at least: what it needs is mandatory, but not next to what stands around.
            _close(_walk(value[2], {""}, clauses), clauses)
        # Nothing is known of what stands before the next item, unless this one is one of a few strings.
        strings = options if options is not None else {""}
    return strings


def _exact(parsed: Iterable) -> set[str] | None:
    """All strings a sequence matches, if they are few; none if it may match others."""
    out = {""}
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            options = {chr(value)} if value < 128 else None
        elif name == "IN":
            options = _characters(value)
        elif name == "SUBPATTERN":
            options = _exact(value[3])
        elif name == "ATOMIC_GROUP":
            options = _exact(value)
        elif name == "BRANCH":
            branches = [_exact(b) for b in value[1]]
            options = None if None in branches else set().union(*branches)
        elif name.endswith("REPEAT") and int(value[1]) <= 8 and (body := _exact(value[2])) is not None:
            options, turn = set(), {""}
            for k in range(int(value[1]) + 1):
                options |= turn if k >= value[0] else set()
                turn = {a + b for a in turn for b in body}
                if len(turn) > WIDEST:
                    return None
        elif name == "AT" or name.startswith("ASSERT"):
            options = {""}
        else:
            options = None
        if options is None:
            return None
        out = {a + b for a in out for b in options}
        if len(out) > WIDEST:
            return None
    return out


def _characters(items: list) -> set[str] | None:
    """The characters of a small class."""
    out: set[str] = set()
    for op, value in items:
        if str(op) == "LITERAL":
            out.add(chr(value))
        elif str(op) == "RANGE" and value[1] - value[0] < 8:
            out |= {chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 and max(map(ord, out), default=128) < 128 else None


def document_key() -> Column:
    """Equal for rows of the same id and text only."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.coalesce("text", F.lit("")))


def postings(docs: DataFrame, trigrams: Iterable[str]) -> DataFrame:
    """The inverted index ``(trigram, doc)`` for the given trigrams, from lower-cased texts."""
    lists = F.array(*[F.lit(t) for t in sorted(trigrams)])
    low = F.lower(F.coalesce("text", F.lit("")))
    held = docs.select(document_key().alias("doc"), low.alias("low"))
    return held.select(F.explode(F.filter(lists, lambda t: F.contains(F.col("low"), t))).alias("trigram"), "doc")


def candidates(index: DataFrame, queries: dict[str, frozenset[frozenset[str]]]) -> DataFrame:
    """``(doc, rules)``: for each document the rules one of whose conjunctions its trigrams fulfil."""
    spark = index.sparkSession
    terms = [
        (f"{kind}.{k}", kind, t, len(part))
        for kind, query in queries.items()
        for k, part in enumerate(sorted(map(sorted, query)))
        for t in part
    ]
    wanted = spark.createDataFrame(terms, "part string, rule string, trigram string, need int")
    held = index.join(F.broadcast(wanted), "trigram").groupBy("doc", "part", "rule").agg(
        F.count_distinct("trigram").alias("n"), F.first("need").alias("need")
    )
    return held.where("n = need").groupBy("doc").agg(F.collect_set("rule").alias("rules"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, found)``: the spans ``(start, rank, kind, end)`` of each of ``docs (doc_id, text)``, sorted.

    A null text is empty and has none; repeated rows are scanned each.
    """
    docs = docs.select("doc_id", "text")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    held = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("secret_text"), document_key().alias("doc"))
    if queries:
        index = stage(postings(docs, reduce(frozenset.union, (t for q in queries.values() for t in q))), "trigram-index")
        held = held.join(candidates(index, queries), "doc", "left")
    else:
        held = held.withColumn("rules", F.lit(None).cast("array<string>"))
    found = []
    for k, rule in enumerate(rules):
        hits = matches(F.col("secret_text"), rule.pattern, rule.group)
        if rule.least > 1:
            hits = F.filter(hits, lambda m: F.length(m["found"]) >= rule.least)
        if rule.kind in queries:
            hits = F.when(F.array_contains("rules", rule.kind), hits).otherwise(none_found())
        found.append(spans(hits, k, rule.kind))
    return held.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def report(scanned: DataFrame) -> DataFrame:
    """Counts by base rule, a digest of the base spans, and all spans as text."""
    kinds = [r.kind for r in BASE_RULES]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in kinds]
    return scanned.select("doc_id", *counts, F.sha2(written(base), 256).alias("base_sha256"), written(F.col("found")).alias("spans"))


def _sql(rules: tuple[Rule, ...]) -> str:
    """The scan of ``documents`` in SQL: between the matches lie the pieces of a split by the same expression."""
    parts = []
    for rank, rule in enumerate(rules):
        pattern = "'" + rule.pattern.replace("'", "''") + "'"
        parts.append(f"""
  SELECT r, {rank} AS rank, '{rule.kind}' AS kind, s AS start, s + length(m) AS stop FROM (
    SELECT r, f[i] AS m, g[i] AS g,
      coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: length(x))), 0) AS s
    FROM (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM (
      SELECT r, string_split_regex(t, {pattern}) AS p, regexp_extract_all(t, {pattern}) AS f,
        regexp_extract_all(t, {pattern}, {rule.group}) AS g
      FROM d)))
  WHERE length(g) >= {rule.least}""")
    spans = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank)"
    base = len(BASE_RULES)
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), hit AS ({" UNION ALL ".join(parts)}
)
SELECT any_value(doc_id) AS doc_id, {counts},
  sha256(coalesce({spans} FILTER (rank < {base}), '')) AS base_sha256,
  coalesce({spans} FILTER (rank IS NOT NULL), '') AS spans
FROM d LEFT JOIN hit USING (r) GROUP BY r
"""


OP7_SQL = _sql(RULES)
