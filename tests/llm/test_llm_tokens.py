"""Encoding, token files and packing against the tokenizer itself."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortloom.llm import packing, separators, wavelet
from cohortloom.llm.common import new_folder
from cohortloom.llm.tokens import WordEncoder, tokenizer_path

PATH = tokenizer_path()
PLAIN = Tokenizer.from_file(PATH)
WORDS = "the quick Brown fox, Äpfel über l'eau été: 12.5% ### <|endoftext|> don't ǅ İ H̱ á   中文 ".split(" ")


def ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=60), st.sampled_from(WORDS)), max_size=6))
def test_batches_encode_like_the_tokenizer(texts):
    encoder = WordEncoder(PATH, cached=20)
    for _ in range(2):
        assert [list(e) for e in encoder.encode_batch([*texts, None])] == [ids(t) for t in texts] + [[]]


def test_joined_words_encode_like_the_tokenizer():
    rng = random.Random(1)
    encoder = WordEncoder(PATH, cached=200)
    texts = ["".join(rng.choice(WORDS) + rng.choice([" ", "\n", "", "\t"]) for _ in range(rng.randint(0, 300))) for _ in range(60)]
    assert [list(e) for e in encoder.encode_batch(texts)] == [ids(t) for t in texts]


def test_special_strings_can_be_ordinary_text():
    plain = Tokenizer.from_file(PATH)
    plain.encode_special_tokens = True
    text = "a <|endoftext|> b<|endoftext|>"
    assert list(WordEncoder(PATH, literal=True).encode(text)) == plain.encode(text, add_special_tokens=False).ids
    assert 49407 not in WordEncoder(PATH, literal=True).encode(text)


@pytest.mark.parametrize("size", [0, 1, 511, 512, 513, 3000])
def test_wavelet_matrix_access_rank_select(size):
    rng = np.random.default_rng(size)
    values = rng.choice([0, 2, 5, 40000, 65535], size)
    built = wavelet.WaveletMatrix.build(values)
    data = b"".join(built.to_bytes())
    held = wavelet.WaveletMatrix.from_bytes(memoryview(data), size, 16)
    assert (held.values() == values).all()
    for i in range(0, size, 37):
        assert held.access(i) == values[i]
    for v in (0, 2, 7, 65535):
        places = np.flatnonzero(values == v)
        assert held.count(v) == len(places)
        for end in (0, size // 3, size):
            assert held.rank(v, end) == (values[:end] == v).sum()
        for k in range(0, len(places), 97):
            assert held.select(v, k) == places[k]
        assert held.select(v, len(places)) == -1


def messy(spark):
    long = "word " * 30_000 + "end."
    rows = [(5, "b text."), (5, "b text."), (None, "no id"), (3, None), (4, ""), (7, " \n "), (9, long), (1, "a # b #")]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("ids", F.lit(1)).withColumn("part", F.lit("x"))


def expected(df):
    rows = sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at, out = 0, []
    for doc, text in rows:
        own = [*ids(text), 2]
        out.append((doc, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        at += len(own)
    return sorted(out, key=str)


def test_token_index_of_messy_rows(spark, monkeypatch):
    df = messy(spark)
    assert sorted(map(tuple, wavelet.token_index(df).collect()), key=str) == expected(df)
    assert wavelet.token_index(df.limit(0)).count() == 0


def test_shard_files_answer_without_decoding(spark):
    folder = new_folder(spark, "test")
    assert wavelet.write_tokens(messy(spark), folder).agg(F.sum("n_docs")).first()[0] == 8
    seen = 0
    for row in spark.read.format("binaryFile").option("pathGlobFilter", "*.wm").load(folder).collect():
        _, _, _, docs, lengths, matrix = wavelet.read_shard(bytes(row.content))
        tokens = matrix.values()
        assert len(docs) == len(lengths) and matrix.size == lengths.sum() == len(tokens)
        assert matrix.count(2) == (tokens == 2).sum() and matrix.access(len(tokens) - 1) == 2
        assert matrix.select(2, 0) == np.flatnonzero(tokens == 2)[0]
        seen += len(docs)
    assert seen == 8


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, data):
        self.data, self.read = data, 0

    def read_at(self, n, offset):
        self.read += n
        return self.data[offset : offset + n]


@pytest.mark.parametrize("size", [0, 1, 511, 32_767, 32_768, 32_769, 200_000])
def test_shard_reader_answers_from_chunks(size):
    rng = np.random.default_rng(size)
    values = np.minimum(rng.zipf(1.3, size), 65_535)
    lengths = [size // 3, 0, size - size // 3]
    data = b"".join(wavelet.shard_bytes(2, 1, 5, [4, None, 9], lengths, values))
    reader = wavelet.ShardReader(Counted(data))
    assert (reader.part, reader.shard, reader.first, reader.doc_ids.to_pylist()) == (2, 1, 5, [4, None, 9])
    for v in (0, 1, 2, 3, 77, 65_535, 65_536, -1):
        places = np.flatnonzero(values == v)
        assert reader.count(v) == len(places)
        assert reader.locate(v).tolist() == places.tolist()
        for end in (-1, 0, size // 2, size, size + 5):
            assert reader.rank(v, end) == (values[: max(end, 0)] == v).sum()
    for i in range(0, size, 9_973):
        assert reader.access(i) == values[i]
    assert (wavelet.read_shard(data)[5].values() == values).all()


def test_lookups_read_a_part_of_a_shard():
    values = np.minimum(np.random.default_rng(0).zipf(1.3, 1 << 20), 65_535)
    data = b"".join(wavelet.shard_bytes(0, 0, 0, [1], [len(values)], values))
    assert len(data) < 2 * len(values)
    file = Counted(data)
    reader = wavelet.ShardReader(file)
    assert reader.count(60_000) == (values == 60_000).sum() and reader.access(12_345) == values[12_345]
    assert file.read < len(data) / 4


def test_counts_and_places_through_spark(spark, monkeypatch):
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 50)
    folder = new_folder(spark, "lookups")
    df = messy(spark).where("text is null or length(text) < 1000")
    wavelet.write_tokens(df, folder)
    texts = [(r.doc_id, [*ids(r.text), 2]) for r in df.collect()]
    wanted = sorted({texts[0][1][0], 2, 40_000, ids("a # b #")[1]})
    got = wavelet.locate_tokens(spark, folder, wanted).select("token_id", "doc_id", "place").collect()
    want = [(t, doc, k) for doc, own in texts for k, t in enumerate(own) if t in wanted]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    counts = {r.token_id: r.n for r in wavelet.count_tokens(spark, folder, wanted).collect()}
    assert counts == {t: sum(x[0] == t for x in want) for t in wanted}


def test_rows_of_one_id_share_no_single_task(spark):
    rows = [(None if k % 2 else 7, f"text number {k} of many") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    folder = new_folder(spark, "one-id")
    parts = wavelet.write_tokens(df, folder).groupBy("part").agg(F.sum("n_docs").alias("n")).collect()
    assert len(parts) == 4 and max(r.n for r in parts) < 250
    assert sorted(map(tuple, wavelet.token_index(df).collect()), key=str) == expected(df)


@pytest.mark.parametrize("block", [3, 64, 1 << 20])
def test_separator_scan_counts_every_document(spark, block):
    df = messy(spark)
    literal = Tokenizer.from_file(PATH)
    literal.encode_special_tokens = True
    got = separators.token_counts(df.where("length(text) < 1000 or text is null"), block_tokens=block)
    want = [(r.doc_id, len(literal.encode(r.text or "", add_special_tokens=False).ids)) for r in df.collect() if r.text is None or len(r.text) < 1000]
    assert sorted(((r.doc_id, r.n_tokens) for r in got.collect()), key=str) == sorted(want, key=str)


def test_separator_scan_of_long_and_no_documents(spark):
    df = messy(spark)
    got = {r.doc_id: r.n_tokens for r in separators.token_counts(df, block_tokens=1000).collect()}
    assert got[9] == len(ids(df.where("doc_id = 9").first().text)) and got[3] == got[4] == 0
    assert separators.token_counts(df.limit(0)).count() == 0


def cheapest(places, penalties, width):
    best = [0.0] + [float("inf")] * (len(places) - 1)
    for j in range(1, len(places)):
        for i in range(j):
            size = places[j] - places[i]
            if size <= width:
                last = j == len(places) - 1
                cost = packing.rest_cost(size, width) if last else width - size + penalties[j]
                best[j] = min(best[j], best[i] + cost)
    return best[-1]


def test_cuts_are_the_cheapest():
    rng = random.Random(4)
    for _ in range(60):
        width = rng.choice([32, 64])
        places = [0]
        while len(places) < rng.randint(2, 40):
            places.append(places[-1] + rng.randint(1, 20))
        penalties = [rng.choice([0.0, 2.0, 8.0]) for _ in places]
        cuts = packing.best_cuts(places, penalties, width)
        assert cuts[0] == 0 and cuts[-1] == len(places) - 1
        cost = 0.0
        for a, b in zip(cuts, cuts[1:]):
            size = places[b] - places[a]
            assert size <= width
            cost += packing.rest_cost(size, width) if b == cuts[-1] else width - size + penalties[b]
        assert cost == pytest.approx(cheapest(places, penalties, width))


@pytest.mark.parametrize("chunk", [300, 1 << 20])
def test_packing_keeps_every_token_once(spark, monkeypatch, chunk):
    df = messy(spark)
    packed = packing.pack(df, width=256, keep_ids=True).collect()
    docs = {}
    for r in packed:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    want = {}
    for r in df.collect():
        own = [*ids(r.text), 2]
        want.setdefault((r.doc_id, len(own)), []).append(own)
    assert set(docs) == set(want)
    for name, pieces in docs.items():
        copies = len(want[name])
        by_start = sorted(pieces, key=lambda r: r.start)
        assert sum(r.length for r in pieces) == copies * name[1]
        for r in by_start:
            own = np.array(want[name][0][r.start : r.start + r.length], "<u4")
            assert r.ids == own.tobytes() and r.ids_crc32 == zlib.crc32(own.tobytes())
    sequences = {}
    for r in packed:
        sequences.setdefault(r.sequence_id, []).append(r)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert packing.pack(df.limit(0)).count() == 0


def test_a_stream_in_chunks_is_packed_like_one(monkeypatch):
    rng = random.Random(8)
    ends = packing.sentence_ends(PATH)
    assert ends[ids("Stop.")[-1]] and ends[ids("why?!")[-1]] and not ends[ids("word,")[-1]]
    packer = packing.Packer(ends, 64, False)
    lengths, pieces = [], []
    for doc in range(200):
        n = rng.randint(1, 90)
        lengths.append(n)
        packer.take(doc, np.array([rng.choice([269, 500, 501]) for _ in range(n)], np.uint16))
        if packer.size > 300:
            pieces += packer.pieces(False, 0).to_pylist()
    pieces += packer.pieces(True, 0).to_pylist()
    assert sum(p["length"] for p in pieces) == sum(lengths)
    at = {}
    for p in pieces:
        assert p["start"] == at.get(p["doc_id"], 0) and p["doc_tokens"] == lengths[p["doc_id"]]
        at[p["doc_id"]] = p["start"] + p["length"]
    sizes = {}
    for p in pieces:
        sizes[p["sequence_id"]] = sizes.get(p["sequence_id"], 0) + p["length"]
    assert max(sizes.values()) <= 64 and sorted(sizes) == list(range(len(sizes)))
