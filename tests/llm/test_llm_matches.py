"""Places, overlaps and masks of many matches, and trigram queries of random expressions, against brute force."""

import random
import re

from pyspark.sql import functions as F

from cohortloom.llm import pii as P, trigram_secrets as T
from cohortloom.llm.matches import LEAST_RUN, apart_from, masked, matches

PIECES = {
    "email": "joe{0}@mail.example.com write to ",
    "ip": "10.1.{0}.4 hôst ",
    "card": "4111 1111 1111 1111 x{0}; ",
    "phone": "+1 (415) 555 01{0}, ",
    "number": "(415) 555-01{0} or ",
    "name": "Mr. John Smith and {0}; ",
}


def test_runs_of_matches_equal_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab1é2 中3") for _ in range(n)) for n in (0, 1, 7, 60, 400, 3000, 20_000)]
    # A list goes through in several runs.
    assert len(re.findall("[0-9]+", texts[-1])) > 4 * LEAST_RUN**2 / 4
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found, other = matches(F.col("text"), "[0-9]+"), matches(F.col("text"), "([ab])[ab]+", 1)
    got = df.select("k", found.alias("found"), other.alias("other")).select(
        "*", apart_from(F.col("found"), F.transform("other", lambda m: m.withField("end", m["end"] + 1))).alias("free")
    )
    for r in got.join(df, "k").collect():
        want = [(m.start(), m.end(), m.group()) for m in re.finditer("[0-9]+", r.text)]
        assert [(m.start, m.end, m.found) for m in r.found] == want
        ends = [0, *(e for _, e, _ in want)]
        assert [(m.left, m.right) for m in r.found] == [(r.text[e:s][-30:], r.text[t : (want[i + 1][0] if i + 1 < len(want) else None)][:1]) for i, (e, (s, t, _)) in enumerate(zip(ends, want))]
        pairs = [(m.start(), m.end(), m.group(1)) for m in re.finditer("([ab])[ab]+", r.text)]
        assert [(m.start, m.end, m.found) for m in r.other] == pairs
        free = [w for w in want if not any(s < w[1] and w[0] < e + 1 for s, e, _ in pairs)]
        assert [(m.start, m.end, m.found) for m in r.free] == free


def brute_masked(text, listed):
    at, out = 0, ""
    for start, rank, kind, end in sorted(listed):
        if start >= at:
            out += text[at:start] + f"[{kind.upper()}]"
        at = max(at, end)
    return out + text[at:]


def test_masks_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for n, spread in ((0, 1), (1, 3), (5, 4), (90, 6), (700, 3), (5000, 8)):
        text = "".join(rng.choice("abé中 ") for _ in range(n * spread + 5))
        starts = [rng.randrange(len(text)) for _ in range(n)]
        rows.append((text, [(s, rng.randrange(3), rng.choice(["ip", "name"]), min(len(text), s + rng.randint(1, 9))) for s in starts]))
    df = spark.createDataFrame(rows, "text string, listed array<struct<start:int,rank:int,kind:string,end:int>>")
    for r in df.select("*", masked(F.col("text"), F.col("listed")).alias("got")).collect():
        assert r.got == brute_masked(r.text, [tuple(s) for s in r.listed])


def test_a_text_of_many_matches(spark):
    rng = random.Random(8)
    per_kind = 17_000
    parts = [p.format(rng.randint(10, 99)) for p in PIECES.values() for _ in range(per_kind)]
    rng.shuffle(parts)
    text = "".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    held = P.find(df).collect()[0]
    counts = {k: sum(s.kind == k for s in held.pii_base) for k in P.BASE}
    assert counts == {k: len([1 for p in parts if p.startswith(PIECES[k][:3])]) for k in P.BASE} and sum(counts.values()) == 4 * per_kind
    for s in held.pii_base[::997]:
        assert text[s.start : s.end].strip() and re.fullmatch(r"joe\d+@mail\.example\.com|10\.1\.\d+\.4|4111 1111 1111 1111|\+1 \(415\) 555 01\d+", text[s.start : s.end])
    clean = P.redact(df).collect()[0].text
    assert clean.count("[EMAIL]") == clean.count("[CARD]") == per_kind and "@" not in clean
    secrets = "".join(f"token=abcdef{k} AKIA{k:020d} {k:030d} " for k in range(30_000))
    row = T.report(T.scan(df.withColumn("text", F.lit(secrets)))).collect()[0]
    assert row.n_access == 30_000 and row.n_assign == 30_000 and row.n_hex == 30_000


def expression(rng, depth):
    """A random expression and a way to make strings that match it."""
    def literal():
        text = "".join(rng.choice("abcdE") for _ in range(rng.randint(1, 4)))
        return text, lambda: text

    def char_class():
        chars = rng.choice(["[a-z]", "[0-9]", "[abc]", "[xy]"])
        pool = {"[a-z]": "abcxyzq", "[0-9]": "0123456789", "[abc]": "abc", "[xy]": "xy"}[chars]
        return chars, lambda: rng.choice(pool)

    def repeat():
        body, make = group()
        low, high, sign = rng.choice([(0, 1, "?"), (1, 3, "+"), (0, 3, "*"), (2, 3, "{2,3}"), (2, 2, "{2}"), (1, 3, "+?")])
        return body + sign, lambda: "".join(make() for _ in range(rng.randint(low, high)))

    def group():
        body, make = expression(rng, depth - 1) if depth else char_class()
        return f"(?:{body})" if rng.random() < 0.5 else f"({body})", make

    def branch():
        parts = [expression(rng, depth - 1) if depth else literal() for _ in range(rng.randint(2, 3))]
        return "(?:" + "|".join(p for p, _ in parts) + ")", lambda: rng.choice(parts)[1]()

    parts = [rng.choice([literal, literal, char_class, repeat, branch, group])() for _ in range(rng.randint(1, 4))]
    return "".join(p for p, _ in parts), lambda: "".join(make() for _, make in parts)


def test_queries_of_random_expressions_lose_no_match():
    rng = random.Random(10)
    selective = 0
    for _ in range(1000):
        pattern, make = expression(rng, 2)
        query = T.trigram_query(pattern)
        selective += bool(query)
        for _ in range(12):
            text = make()
            assert re.fullmatch(pattern, text), (pattern, text)
            low = text.lower()
            assert not query or any(all(t in low for t in part) for part in query), (pattern, text, query)
    assert selective > 400


def test_scan_finds_what_stands_between_unknown_parts(spark):
    df = spark.createDataFrame([(1, "abcqqdef"), (2, "abc12def"), (3, "abcxydef abcdef")], "doc_id long, text string")
    rules = (T.Rule("one", "abc(?:xy|[a-z]+)def"), T.Rule("two", "abc(?:[0-9]+)?def"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.found] for r in T.scan(df, rules).collect()}
    assert got == {1: [("one", 0, 8)], 2: [("two", 0, 8)], 3: [("one", 0, 8), ("two", 9, 15)]}
    assert T.trigram_query("abc(?:xy|[a-z]+)def") == frozenset({frozenset({"abc", "def"})})
