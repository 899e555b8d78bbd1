"""Personal data by weak supervision, with DataFrame functions only.

Patterns propose spans. Labelers of three sorts vote on each: regular expressions,
gazetteers and cues in the context. Expectation maximisation estimates how far each
labeler can be trusted from the counts of vote patterns alone, and a logistic span
classifier is trained on the resulting probabilities. Spans of the base rules always
count; the classifier decides on the others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import restored, shielded
from cohortloom.llm.matches import apart_from, masked, matches, none_found, spans, written
from cohortloom.session import stage

KINDS = ("email", "ip", "card", "phone", "number", "name")
BASE = KINDS[:4]
LABELERS = ("form", "gazetteer", "context", "border", "length")
EM_ROUNDS = 25
FIT_ROUNDS = 150
FIT_RATE = 2.0

# The shapes of proposals. Possessive forms and lookbehinds keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?<![0-9.+])[0-9](?:[\x20().-]{0,2}[0-9]){6,18}+(?![0-9])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Señora?)\.?\x20[A-ZÀ-Þ][A-Za-zÀ-ÿ'-]{1,30}+(?:\x20[A-ZÀ-Þ][A-Za-zÀ-ÿ'-]{1,30}+)?",
}
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
# What the labelers look for, by kind.
FORMS = {
    "email": r"^[A-Za-z0-9]",
    "ip": rf"^{BYTE}(?:\.{BYTE}){{3}}$",
    "card": r"^[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}$",
    "phone": r"^\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3}",
    "number": r"^(?:\(?[0-9]{3}\)?[\x20.-])[0-9]{3}[\x20.-][0-9]{4}$",
    "name": r"\x20.+\x20",
}
GAZETTEERS = {
    "email": r"\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu)$",
    "ip": r"^(?!0\.|10\.|127\.|192\.168\.|255\.)",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6[05])",
    "phone": r"^\+(?:1|33|34|44|49)(?![0-9])",
    "number": r"^\(?[2-9][0-9]{2}\)?[\x20.-]",
    "name": r"\x20(?:John|Mary|James|Anna|Peter|Paul|Maria|Hans|Klaus|Jean|Marie|Luis|Carlos|Ana|David|Laura)(?![a-z])",
}
CUES = (
    r"(?:mail|contact|call|phone|tel|fax|mobile|card|account|ssn|name|address|kontakt|telefon|konto|karte"
    r"|téléphone|compte|teléfono|cuenta|tarjeta|signed|dear|server|host)[^.\n]{0,12}$"
)
LENGTHS = {"email": (6, 64), "ip": (4, 12), "card": (13, 19), "phone": (9, 13), "number": (9, 11), "name": (0, 0)}


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of ASCII digits passes the check of card numbers."""
    back = F.split(F.reverse(number), "(?!^)")
    values = F.transform(back, lambda d, i: F.coalesce(d.try_cast("int"), F.lit(0)) * (i % 2 + 1))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v))
    return total % 10 == 0


def base_found(text: Column, kind: str) -> Column:
    """Matches of a base rule that pass its check."""
    found = matches(text, PATTERNS[kind])
    if kind == "email":
        return F.when(F.contains(text, F.lit("@")), found).otherwise(none_found())
    if kind == "ip":
        return F.filter(found, lambda m: m["found"].rlike(FORMS["ip"]))
    if kind == "card":
        n = lambda m: F.length(digits(m["found"]))
        return F.filter(found, lambda m: n(m).between(12, 19) & luhn(digits(m["found"])))
    found = F.filter(found, lambda m: F.length(digits(m["found"])).between(9, 15))
    return F.when(F.contains(text, F.lit("+")), found).otherwise(none_found())


def votes(m: Column, kind: str) -> Column:
    """One 0 or 1 by labeler, in the order of ``LABELERS``."""
    found, left, right = m["found"], m["left"], m["right"]
    size = F.length(found) if kind in ("email", "name") else F.length(digits(found))
    low, high = LENGTHS[kind]
    cast = [
        found.rlike(FORMS[kind]),
        found.rlike(GAZETTEERS[kind]),
        F.lower(left).rlike(CUES),
        ~left.rlike("[A-Za-z0-9]$") & ~right.rlike("^[A-Za-z0-9]"),
        size.between(low, high) if high else F.lit(True),
    ]
    return F.array(*[v.cast("double") for v in cast])


def proposals(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii_base``: spans of base rules, and ``pii_seen``: all proposals with their votes.

    Proposals of the further kinds that overlap a base span are left out.
    """
    held = docs.withColumn("pii_text", F.coalesce("text", F.lit("")))
    text = F.col("pii_text")
    for kind in BASE:
        held = held.withColumn(f"pii_{kind}", base_found(text, kind))
    own = [F.col(f"pii_{kind}") for kind in BASE]
    held = held.withColumn("pii_base", F.concat(*[spans(c, k, kind) for k, (c, kind) in enumerate(zip(own, BASE))]))
    for kind in KINDS[len(BASE):]:
        held = held.withColumn(f"pii_{kind}", apart_from(matches(text, PATTERNS[kind]), F.col("pii_base")))
    seen = [
        F.transform(
            F.col(f"pii_{kind}"),
            lambda m: F.struct(
                m["start"].alias("start"), F.lit(k).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end"), votes(m, kind).alias("votes")
            ),
        )
        for k, kind in enumerate(KINDS)
    ]
    held = held.withColumn("pii_seen", F.concat(*seen))
    return held.drop("pii_text", *[f"pii_{kind}" for kind in KINDS])


@dataclass(frozen=True)
class Classifier:
    """Weights of the span classifier: a bias, the labelers' votes, the kinds."""

    weights: tuple[float, ...]

    def accepts(self, seen: Column) -> Column:
        z = F.lit(self.weights[0])
        for k in range(len(LABELERS)):
            z = z + F.get(seen["votes"], F.lit(k)) * self.weights[1 + k]
        for k in range(len(KINDS)):
            z = z + F.when(seen["rank"] == k, self.weights[1 + len(LABELERS) + k]).otherwise(0.0)
        return z > 0


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def em_step(patterns: Column, state: Column) -> Column:
    """One round on patterns ``(votes, n)``: the chance of each under both classes, then the rates anew."""
    weighed = posteriors(patterns, state)
    real = total(F.transform(weighed, lambda p: p["n"] * p["q"])) + 1.0
    other = total(F.transform(weighed, lambda p: p["n"] * (1 - p["q"]))) + 1.0

    def rates(inside: bool, size: Column) -> Column:
        return F.array(*[
            (total(F.transform(weighed, lambda p: p["n"] * (p["q"] if inside else 1 - p["q"]) * F.get(p["votes"], F.lit(k)))) + 0.5) / size
            for k in range(len(LABELERS))
        ])

    return F.struct((real / (real + other)).alias("share"), rates(True, real).alias("hit"), rates(False, other).alias("miss"))


def posteriors(patterns: Column, state: Column) -> Column:
    """The patterns with ``q``, the chance that a span of theirs is personal data."""

    def likelihood(p: Column, rates: Column) -> Column:
        agree = F.zip_with(p["votes"], rates, lambda v, r: F.ln(F.greatest(F.when(v > 0, r).otherwise(1 - r), F.lit(1e-6))))
        return F.exp(total(agree))

    def one(p: Column) -> Column:
        a = state["share"] * likelihood(p, state["hit"])
        b = (1 - state["share"]) * likelihood(p, state["miss"])
        return F.struct(p["kind_rank"].alias("kind_rank"), p["votes"].alias("votes"), p["n"].alias("n"), (a / (a + b)).alias("q"))

    return F.transform(patterns, one)


def train(seen: DataFrame) -> Classifier:
    """Fit on the counts of vote patterns of all ``pii_seen``: at most 2 ** labelers for each kind.

    Without proposals the weights are zero and nothing is added.
    """
    one = seen.select(F.explode("pii_seen").alias("s")).groupBy(F.col("s.rank").alias("kind_rank"), F.col("s.votes").alias("votes"))
    counts = one.agg(F.count("*").cast("double").alias("n")).agg(
        F.array_sort(F.collect_list(F.struct("kind_rank", "votes", "n"))).alias("patterns")
    )
    first = F.struct(
        F.lit(0.5).alias("share"), F.array(*[F.lit(0.8)] * len(LABELERS)).alias("hit"), F.array(*[F.lit(0.3)] * len(LABELERS)).alias("miss")
    )
    em = counts.select(
        "patterns", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), first, lambda s, _: em_step(F.col("patterns"), s)).alias("state")
    )
    soft = stage(em.select(posteriors(F.col("patterns"), F.col("state")).alias("soft")), "pii-posteriors")
    width = 1 + len(LABELERS) + len(KINDS)
    kinds = lambda p: F.array(*[(p["kind_rank"] == k).cast("double") for k in range(len(KINDS))])
    rows = soft.select(
        F.transform("soft", lambda p: F.struct(F.concat(F.array(F.lit(1.0)), p["votes"], kinds(p)).alias("x"), p["n"].alias("n"), p["q"].alias("q"))).alias("rows")
    ).withColumn("size", total(F.transform("rows", lambda r: r["n"])) + 1.0)
    zeros = F.array(*[F.lit(0.0)] * width)

    def step(w: Column, _: Column) -> Column:
        def add(g: Column, r: Column) -> Column:
            z = total(F.zip_with(w, r["x"], lambda a, b: a * b))
            off = r["n"] * (1 / (1 + F.exp(-z)) - r["q"])
            return F.zip_with(g, r["x"], lambda a, b: a + off * b)

        slope = F.aggregate("rows", zeros, add)
        return F.zip_with(w, slope, lambda a, g: a - FIT_RATE * (g / F.col("size") + 1e-4 * a))

    fitted = rows.select(F.aggregate(F.sequence(F.lit(1), F.lit(FIT_ROUNDS)), zeros, step).alias("w")).first()
    return Classifier(tuple(fitted["w"]) if fitted else (0.0,) * width)


def added(classifier: Classifier) -> Column:
    """Spans of the further kinds that the classifier accepts."""
    good = F.filter("pii_seen", lambda s: (s["rank"] >= len(BASE)) & classifier.accepts(s))
    return F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))


def find(docs: DataFrame) -> DataFrame:
    """``(doc_id, pii_base, pii_spans)`` of each of ``docs (doc_id, text)``: base spans, and those with the added ones.

    A span is ``(start, rank, kind, end)`` in code points. A null text is empty and
    has none; repeated rows are judged each.
    """
    seen = stage(proposals(docs.select("doc_id", "text")).select("doc_id", "pii_base", "pii_seen"), "pii")
    return seen.select("doc_id", "pii_base", F.array_sort(F.concat("pii_base", added(train(seen)))).alias("pii_spans"))


def report(found: DataFrame) -> DataFrame:
    """Counts by base kind, a digest of the base spans, and all spans as text."""
    counts = [F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(written(F.col("pii_base")), 256).alias("base_sha256"), written(F.col("pii_spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind; ``n_chars``, if there, follows the text."""
    bare, names = shielded(docs, "text")
    # Stored, or the proposals would be worked out for the training and again for the texts.
    held = stage(proposals(bare), "pii-proposals")
    held = held.withColumn("pii_all", F.array_sort(F.concat("pii_base", added(train(held)))))
    done = held.withColumn("text", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("pii_all"))))
    if "n_chars" in names:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        old = names["n_chars"]
        done = done.withColumn(old, F.when(F.size("pii_all") > 0, size).otherwise(F.col(old)))
    return restored(done, names)
