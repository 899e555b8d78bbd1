"""Personal data, secrets, benchmark passages and toxicity against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate as D, pii as P, toxicity as X, trigram_secrets as T
from cohortloom.llm.common import giving_back
from cohortloom.llm.tokens import powers


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def only_digits(m):
    return re.sub("[^0-9]", "", m.group())


# The base rules as given: kind, expression, check of a match.
PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.group().split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(only_digits(m)) <= 15),
]
SECRET = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m.group(2)) >= 6),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m.group()) >= 20),
    ("hex", r"[0-9a-f]+", lambda m: len(m.group()) >= 24),
]
BITS = {
    "personal": [
        "a@b.co", "x.y+z@mail-1.example.com", "a@b", "@", "a@b.c@d.e", "a@b.com_x@c.de", "é@ü.com", "1.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4.5.6.7.8",
        "007.08.0255.1", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "1234 5678 90", "0" * 12, "1" * 30, "+1 (555) 123-4567",
        "+49 89 1234567", "+1", "++12", "+123456789012345678", "Mr John Smith", "call 555-123-4567", "phone: (555) 123-4567", "😀", "Dr. Anna Öl",
    ],
    "secret": [
        "password=hunter22", "TOKEN: 'abc'", 'api_key = "AbCdEf123"', "apikey:xyz", "Secret  =  a.b_c-d/e", "passwd", "AKIA" + "A1" * 8, "AKIA123",
        "AKIAAKIA" + "B2" * 8, "deadbeef" * 3, "deadbeef" * 2, "0123456789abcdef" * 3 + "g", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab",
        "https://user:pw@host/x", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "tOkEn=K", "toKen=123456", "AIza" + "x" * 35,
    ],
}


def random_texts(rng, bits, n=150):
    glue = ["", " ", "  ", "\n", ", ", "é", "x", "-", "."]
    texts = ["".join(rng.choice(bits) + rng.choice(glue) for _ in range(rng.randint(0, 8))) for _ in range(n)]
    texts += ["".join(rng.choice("09a.@+- (AK=") for _ in range(rng.randint(1, 60))) for _ in range(n)]
    return [*texts, None, "", " ", "9" * 4000, "1 " * 4000, "1.2.3.4 " * 300, "a." * 5000 + "@", "+1" + " " * 3000]


def brute(text, rules):
    found = sorted((m.start(), k, m.end()) for k, (_, p, good) in enumerate(rules) for m in re.finditer(p, text) if good(m))
    return ",".join(f"{rules[k][0]}:{a}:{b}" for a, k, b in found), [sum(x[1] == k for x in found) for k in range(len(rules))]


@pytest.mark.parametrize("kind", ["personal", "secret"])
def test_base_spans_equal_brute_force(spark, kind):
    rules = PERSONAL if kind == "personal" else SECRET
    texts = dict(enumerate(random_texts(random.Random(5), BITS[kind])))
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id bigint, text string, rules string")
    got = (P.report(P.find(df)) if kind == "personal" else T.report(T.scan(df))).collect()
    assert len(got) == len(texts)
    for r in got:
        line, counts = brute(texts[r.doc_id] or "", rules)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest(), (texts[r.doc_id], r.spans, line)
        assert [r[f"n_{name}"] for name, _, _ in rules] == counts
        own = r.spans.split(",") if r.spans else []
        assert set(line.split(",") if line else []) <= set(own)
        starts = [int(s.split(":")[1]) for s in own]
        assert starts == sorted(starts)


def test_further_secrets_are_found_and_placed(spark):
    text = "é ghp_" + "Z" * 36 + " and -----BEGIN EC PRIVATE KEY-----"
    df = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id bigint, text string")
    got = [r.spans for r in T.report(T.scan(df)).collect()]
    assert got == ["github:2:42,private_key:47:77"] * 3
    assert T.scan(df.limit(0)).count() == 0
    assert T.scan(df, (T.BASE_RULES[2],)).count() == 3


def test_trigram_queries_hold_for_every_match():
    rng = random.Random(9)
    texts = [t.lower() for t in random_texts(rng, BITS["secret"], 600) if t]
    for rule in T.RULES:
        query = T.trigram_query(rule.pattern)
        for text in random_texts(rng, BITS["secret"], 600):
            if text and re.search(rule.pattern, text):
                assert not query or any(all(t in text.lower() for t in part) for part in query)
    assert T.trigram_query("[0-9a-f]{24,}") == frozenset() and T.trigram_query("a?b?c?") == frozenset()
    assert T.trigram_query("abcd|wxyz") == frozenset({frozenset({"abc", "bcd"}), frozenset({"wxy", "xyz"})})
    assert T.trigram_query("(foo|barn)+x") == frozenset({frozenset({"foo"}), frozenset({"bar", "arn"})})
    assert T.trigram_query("ab(?:c|d)?ef") and T.trigram_query("(abc)?") == frozenset()
    assert texts


def test_classifier_learns_from_the_labelers(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        good = f"call 555-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} now. "
        mail = f"mail user{k}@example.com "
        noise = f"ref{rng.randint(1, 9)}{rng.randint(10**6, 10**7)}x "
        rows.append((k, rng.choice([good, mail, noise, good + noise, "plain text "])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.spans for r in P.report(P.find(df)).collect()}
    for k, text in rows:
        assert ("number:5:17" in got[k]) == text.startswith("call"), (text, got[k])


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "x a@b.co y 1.2.3.4", "en", "s", 18, 7), (2, None, "en", "s", 0, 7), (3, "", None, "s", 0, 7), (3, "plain", None, None, None, 7)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, pii_base int"
    df = spark.createDataFrame(rows, schema)
    got = P.redact(df)
    assert got.dtypes == df.dtypes
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "x [EMAIL] y [IP]", "en", "s", 16, 7), *rows[1:]], key=str)
    assert P.redact(df.limit(0)).count() == 0


def brute_hits(text, items, n=13):
    def split(t):
        return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))

    words, hit, named = split(text), set(), set()
    for item, body in items:
        own = split(body)
        size = min(n, len(own))
        if not size:
            continue
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                named.add(item)
    return words, hit, named - {None}


def passages(rng):
    vocabulary = ["Alpha", "béta", "g4mma", "delta", "ÉPSILON", "z", "eta9"]
    items = [(k % 9, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 13, 14, 40])))) for k in range(14)]
    items += [(None, "null id item words here " * 4), (77, None), (78, ""), (79, "!!")]
    docs = []
    for k in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            body = (rng.choice(items)[1] or "").split()
            a = rng.randint(0, 3)
            parts.append(rng.choice([" ", ", ", "\n"]).join(body[a : a + rng.randint(1, 50)]))
            parts.append(" ".join(f"own{rng.randint(0, 99)}" for _ in range(rng.randint(0, 60))))
        docs.append((k, " ".join(parts)))
    return [*docs, (500, None), (501, ""), (501, ""), (None, items[0][1])], items


@pytest.mark.parametrize("slice_bytes", [8 << 20, 60])
def test_benchmark_windows_equal_brute_force(spark, slice_bytes):
    docs, items = passages(random.Random(4))
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("hits", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = sorted(map(tuple, D.report(D.find_hits(df, bench, slice_bytes=slice_bytes)).collect()), key=str)
    want = []
    for doc, text in docs:
        words, hit, named = brute_hits(text, items)
        names = ",".join(sorted(map(str, named)))
        want.append((doc, len(words), len(hit), len(named), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)))
    assert got == sorted(want, key=str)
    left = D.remove(df, bench)
    assert left.columns == df.columns and {r.hits for r in left.collect()} == {"clash"}
    kept = [(d, t) for (d, t), w in zip(docs, want) if not w[-1]]
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((d for d, _ in kept), key=str)
    for r in left.collect():
        assert not brute_hits(r.text, [(1, b) for _, b in items if b and len(b.split()) >= 13])[1] or r.text in dict(kept).values()


def test_slices_of_a_benchmark_are_bounded_however_often_items_repeat(spark):
    items = [(k % 7, f"item number {k % 7} " + "w " * (k % 7)) for k in range(700)] + [(None, "no id " * 3), (8, None), (9, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    distinct = {i for i in items if i[1] is not None}
    for size in (10, 60, 1 << 20):
        slices = [[tuple(r) for r in part.collect()] for part in D.benchmark_slices(bench, size)]
        assert sorted((r for part in slices for r in part), key=str) == sorted(distinct, key=str)
        longest = max(len(t) for _, t in distinct)
        assert all(sum(len(t) for _, t in part) < size + longest for part in slices)
        assert (len(slices) == 1) == (size == 1 << 20)
    assert [part.collect() for part in D.benchmark_slices(bench.limit(0), 10)] == [[]]


def test_hit_words_are_cut_out(spark):
    item = "One two three four five six seven eight nine ten eleven twelve thirteen"
    rest = " ".join(f"w{k}" for k in range(400))
    df = spark.createDataFrame([(1, f"Start. {item}! End {rest}", 5)], "doc_id bigint, text string, n_chars bigint")
    bench = spark.createDataFrame([(1, item.upper())], "item_id bigint, text string")
    row = D.remove(df, bench).first()
    assert row.text == f"Start. End {rest}" and row.n_chars == len(row.text)
    assert D.remove(df, bench, spans=False).first().text == df.first().text
    assert D.remove(df, bench.limit(0)).first().text == df.first().text
    assert D.remove(df.limit(0), bench).count() == 0


def test_hits_of_all_slices_and_the_cut_take_one_worker(spark, monkeypatch):
    docs, items = passages(random.Random(5))
    df = spark.createDataFrame([(d, t, None if t is None else len(t)) for d, t in docs], "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = D.remove(df, bench)
    monkeypatch.setattr(D, "SLICE_BYTES", 300)
    assert len(D.benchmark_slices(bench, 300)) > 1
    sliced = D.remove(df, bench)
    for out in (whole, sliced, D.find_hits(df, bench, slice_bytes=300)):
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = [sorted(map(tuple, out.collect()), key=str) for out in (whole, sliced)]
    assert got[0] == got[1]
    assert all(n == (None if t is None else len(t)) for _, t, n in got[0])


def test_a_worker_keeps_no_powers_after_a_task():
    powers(1 << 16, 3)
    assert list(giving_back(lambda batches: batches)(iter([1, 2]))) == [1, 2]
    assert powers.cache_info().currsize == 0


def insults(rng, n):
    plain, bad = [f"word{k}" for k in range(400)], ["idiot", "scum", "Trottel", "imbécile"]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))] + ["the", "of"]
        toxic = k % 5 == 0
        for _ in range(toxic * rng.randint(1, 3)):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_classifier_on_held_out_rows(spark):
    rows = insults(random.Random(7), 900)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id bigint, text string, toxic_score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (7, None), (5000, 1)], "doc_id bigint, toxic int")
    model = X.train(docs, labels)
    got = {r.doc_id: r.toxic_score for r in X.score(docs, model).collect()}
    out = [(k, y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    flags = {r.doc_id: r.h for r in docs.select("doc_id", X.held_out().alias("h")).collect()}
    assert {k for k, f in flags.items() if f} == {k for k, _ in out}
    right = [(got[k] >= 0.5) == bool(y) for k, y in out]
    assert np.mean(right) > 0.95
    left = X.remove(docs, docs, labels)
    assert left.columns == docs.columns and 650 < left.count() < 780
    # Held-out labels never matter.
    turned = labels.withColumn("toxic", F.when(X.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.toxic_score for r in X.score(docs, X.train(docs, turned)).collect()}
    assert again == pytest.approx(got)


@pytest.mark.parametrize("n,kinds", [(300, 20), (1200, 50), (2000, 40)])
def test_words_of_few_labelled_texts_are_learned(spark, n, kinds):
    # Each insult stands in 3 to 10 training texts.
    rng = random.Random(n)
    bad = ["".join(rng.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(kinds)]
    rows = []
    for k in range(n):
        words = [f"word{rng.randrange(400)}" for _ in range(rng.randint(3, 80))]
        if k % 5 == 0:
            words.insert(rng.randrange(len(words)), bad[k // 5 % kinds])
        rows.append((k, " ".join(words), int(k % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    got = X.score(docs, X.train(docs, docs.select("doc_id", "toxic"))).where(X.held_out())
    said = [(r.toxic, r.toxic_score >= 0.5) for r in got.collect()]
    assert sum(t and s for t, s in said) >= 0.8 * sum(t for t, _ in said)
    assert sum(s and not t for t, s in said) <= 0.05 * len(said)


def test_thresholds_rest_on_all_labelled_rows(spark):
    # Few rows of the second language are in the sample of the fit, 600 in the table; a tenth of the labels is wrong.
    rng = random.Random(11)
    rows = []
    for k in range(4000):
        german = k % 5 == 0
        words = [f"word{rng.randrange(300)}" for _ in range(rng.randint(5, 40))]
        words += ["der", "die", "und", "nicht"] if german else ["the", "of", "and", "to"]
        toxic = rng.random() < (0.1 if german else 0.4)
        words[:0] = ["scum"] * (toxic or rng.random() < 0.2) + ["Trottel"] * (toxic and rng.random() < 0.7)
        rows.append((k, " ".join(words), int(toxic ^ (rng.random() < 0.1))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = X.train(docs, docs.select("doc_id", "toxic"), rows=60)
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    hashes, counts = X.word_hashes([t for _, t, _ in known])
    z, spoken, y = model.logits(hashes, counts), X.languages(hashes, counts), np.array([v for _, _, v in known])
    bins = X.logit_bins(z)

    def f1(said, own):
        return 2 * (y[own] & said[own]).sum() / max(1, said[own].sum() + y[own].sum())

    for k in (0, 1):
        own = spoken == k
        assert own.sum() >= X.LANGUAGE_ROWS
        # Logits may differ in their last bits by batch.
        assert f1(z >= model.thresholds[k], own) >= max(f1(bins >= b, own) for b in np.unique(bins[own])) - 0.005


def test_best_threshold_over_counts_equals_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(50):
        z = rng.normal(0, 1, 300).astype(np.float32)
        y = (z + rng.normal(0, 1, 300) > rng.normal(1, 0.5)).astype(np.int64)
        bins = X.logit_bins(z)
        cells, back_to = np.unique(np.stack([bins, y], axis=1), axis=0, return_inverse=True)
        n = np.bincount(back_to.ravel())
        cut = X.best_threshold(cells[:, 0], n, n * cells[:, 1])

        def f1(said):
            return 2 * (y & said).sum() / max(1, y.sum() + said.sum())

        want = max(f1(bins >= b) for b in np.unique(bins)[1:])
        assert f1(z >= cut) == want or 2 * y.sum() > len(y)


def test_scores_of_odd_rows_and_labels(spark):
    rows = [(1, "idiot " * 200_000), (2, None), (3, ""), (3, ""), (None, "x"), (4, "\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    base = spark.createDataFrame([(k, t) for k, t, _ in insults(random.Random(8), 300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in insults(random.Random(8), 300)], "doc_id bigint, toxic int")
    got = X.score(docs, X.train(base, labels)).collect()
    assert len(got) == 6 and all(0 <= r.toxic_score <= 1 for r in got)
    by = {r.doc_id: r.toxic_score for r in got}
    assert by[1] >= 0.5 > by[2] == by[3] == by[4]
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        assert all(0 <= r.toxic_score <= 1 for r in X.score(docs, X.train(base, some)).collect())
    assert X.score(docs.limit(0), X.train(base, labels)).count() == 0


def test_long_texts_pool_like_short_ones(monkeypatch):
    rows = insults(random.Random(10), 300)
    hashes, counts = X.word_hashes([t for _, t, _ in rows])
    y = np.array([v for _, _, v in rows], np.float32)
    model = X.fit(hashes, counts, y, np.ones(len(y), np.float32))
    whole = model.logits(hashes, counts)
    monkeypatch.setattr(X, "CHUNK_WORDS", 3)
    assert np.allclose(model.logits(hashes, counts), whole, atol=1e-4)
    assert X.languages(*X.word_hashes(["the of and", "der die und", "le la les", "el los y", ""])).tolist() == [0, 1, 2, 3, 0]
