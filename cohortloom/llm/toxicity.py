"""Toxicity scores from a convolutional text classifier trained in numpy.

Words are hashed into two small embedding tables, their beginnings into two more, and
the rows are laid side by side: two words are confused only if both hashes agree, and
a word never seen still shows its stem. Filters of several
widths slide over the words of a whole text; the largest answer of each filter
goes into a logistic output. Thresholds are calibrated for each language, which
is guessed from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.llm.common import bounded_batches, by_size, give_back, giving_back, restored, shielded
from cohortloom.llm.decontaminate import WORD_BYTES
from cohortloom.llm.tokens import piece_hashes

#: Labelled rows of each class that the model is fitted on, at most.
FIT_ROWS = 2000
TABLE_BITS = 17
ROW = 8
#: Bytes of the beginnings of words.
STEMS = (4, 6)
DEPTH = ROW * (2 + len(STEMS))
WIDTHS = (1, 2, 3)
FILTERS = 8
EPOCHS = 6
BATCH = 32
#: Texts of the common share that a row's first log odds take as seen beside its own.
PRIOR_TEXTS = 10.0
#: Labelled rows of a language below which its threshold leans on the common one.
LANGUAGE_ROWS = 200
#: Bins of the logit by unit, and the size from which logits count as equal, when thresholds are chosen.
LOGIT_BINS = 256
LOGIT_LIMIT = 32
CHUNK_WORDS = 1 << 17

# Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is that for it as was with on are this be at by from or",
    "de": "der die und das ist nicht ein eine zu den mit von auf für im dem sich des auch es",
    "fr": "le la les et des est un une que dans pour pas sur au du en qui ce il par",
    "es": "el la los y de que en un una es por con para no se las del al lo como",
}
LANGUAGES = tuple(FUNCTION_WORDS)


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words of all texts in turn and of their beginnings, a row each, and the words of each text."""
    raw = [(t or "").encode().translate(WORD_BYTES) for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    inside = joined != 0x20
    edges = np.diff(inside.view(np.int8), prepend=np.int8(0))
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    limits = np.cumsum([len(r) + 1 for r in raw])
    counts = np.diff(np.searchsorted(first, limits), prepend=0)
    if not len(first):
        return np.empty((1 + len(STEMS), 0), np.uint32), counts
    ends = [last, *(np.minimum(last, first + n) for n in STEMS)]
    return np.stack([(piece_hashes(joined, first, e) >> np.uint64(32)).astype(np.uint32) for e in ends]), counts


def rows_in(table: int, hashes: np.ndarray) -> np.ndarray:
    """Row numbers in one of the tables: the first two are for words, the others for their beginnings."""
    if table == 1:
        return (hashes[0] & np.uint32((1 << TABLE_BITS) - 1)).astype(np.int32)
    return (hashes[max(table - 1, 0)] >> np.uint32(32 - TABLE_BITS)).astype(np.int32)


def language_hashes() -> tuple[np.ndarray, np.ndarray]:
    pairs = [(w, k) for k, name in enumerate(LANGUAGES) for w in FUNCTION_WORDS[name].split()]
    return word_hashes([w for w, _ in pairs])[0][0], np.array([k for _, k in pairs])


def languages(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The language with the most function words in each text; of equal ones the first."""
    hashes = hashes[0]
    known, kind = language_hashes()
    order = np.argsort(known)
    known, kind = known[order], kind[order]
    maybe = np.zeros(1 << 16, bool)
    maybe[known & np.uint32(0xFFFF)] = True
    near = np.flatnonzero(maybe[hashes & np.uint32(0xFFFF)])
    # A word of several languages counts for each.
    low, high = (np.searchsorted(known, hashes[near], side=s) for s in ("left", "right"))
    text = np.searchsorted(np.cumsum(counts), near, side="right")
    seen = np.zeros(len(counts) * len(LANGUAGES), np.int64)
    for k in range(int((high - low).max(initial=0))):
        hit = low + k < high
        seen += np.bincount(text[hit] * len(LANGUAGES) + kind[low[hit] + k], minlength=len(seen))
    return seen.reshape(len(counts), len(LANGUAGES)).argmax(axis=1)


@dataclass
class Model:
    tables: list[np.ndarray]
    filters: list[np.ndarray]  # by width: (width, DEPTH, FILTERS)
    biases: list[np.ndarray]
    output: np.ndarray
    bias: float
    thresholds: np.ndarray  # by language, on the logit

    def logits(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The output for each text; long texts go through in chunks, which the pooling joins."""
        hashes, counts = near_live(hashes, counts, [t.any(axis=1) for t in self.tables])
        pooled = np.full((len(counts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        ends = np.cumsum(counts)
        low = 0
        while low < len(counts):
            base = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, base + CHUNK_WORDS, side="right")))
            if high == low + 1 and counts[low] > CHUNK_WORDS:
                for at in range(0, int(counts[low]), CHUNK_WORDS):
                    part = hashes[:, base + at : min(base + at + CHUNK_WORDS + max(WIDTHS) - 1, ends[low])]
                    # Windows that begin behind the chunk belong to the next one.
                    own = CHUNK_WORDS if at + CHUNK_WORDS < counts[low] else None
                    pooled[low] = np.maximum(pooled[low], self._pool(part, np.array([part.shape[1]]), own)[0])
            else:
                pooled[low:high] = self._pool(hashes[:, base : ends[high - 1]], counts[low:high])
            low = high
        # Not by BLAS, whose last bits depend on the number of rows.
        return (pooled * self.output).sum(axis=1) + self.bias

    def _pool(self, hashes: np.ndarray, counts: np.ndarray, places_used: int | None = None) -> np.ndarray:
        places, starts, size = padded(counts)
        x = np.zeros((size, DEPTH), np.float32)
        x[places] = np.hstack([t[rows_in(k, hashes)] for k, t in enumerate(self.tables)])
        found = responses(x, self.filters, self.biases)
        if places_used is not None:
            return np.hstack([r[:places_used].max(axis=0, keepdims=True) for r in found])
        # The windows that begin at a word, and one of empty places; those behind it reach into the next text.
        edges = np.stack([starts, starts + counts + 1], axis=1).ravel()
        return np.hstack([np.maximum.reduceat(r, edges)[::2] for r in found])


def near_live(hashes: np.ndarray, counts: np.ndarray, live: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The words that share a window with a word of non-zero embedding, and their number by text.

    All other windows hold zeros only, and so do those on the empty places after each text.
    """
    places, _, size = padded(counts)
    held = np.zeros(hashes.shape[1], bool)
    for k, mask in enumerate(live):
        held |= mask[rows_in(k, hashes)]
    keep = np.zeros(size, bool)
    keep[places] = held
    reach = max(WIDTHS) - 1
    around = keep.copy()
    for k in range(1, reach + 1):
        around[k:] |= keep[:-k]
        around[:-k] |= keep[k:]
    text = np.repeat(np.arange(len(counts)), counts)
    kept = around[places]
    return hashes[:, kept], np.bincount(text[kept], minlength=len(counts))


def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of words when each text is followed by empty places, the texts' starts, and the size."""
    gap = max(WIDTHS)
    starts = np.concatenate([[0], np.cumsum(counts + gap)[:-1]])
    places = np.arange(int(counts.sum())) + np.repeat(np.arange(len(counts)) * gap, counts)
    return places, starts, int((counts + gap).sum())


def responses(x: np.ndarray, filters: list[np.ndarray], biases: list[np.ndarray]) -> list[np.ndarray]:
    out = []
    for w, b in zip(filters, biases):
        z = x @ w[0] + b
        for k in range(1, len(w)):
            z[:-k] += x[k:] @ w[k]
        out.append(np.maximum(z, 0))
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(hashes: np.ndarray, counts: np.ndarray, labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS) -> Model:
    """Train on texts given as word hashes. Without both classes every text scores the one label seen."""
    rng = np.random.default_rng(7)
    size = 1 << TABLE_BITS
    tables = [np.zeros((size, ROW), np.float32) for _ in range(DEPTH // ROW)]
    filters = [rng.normal(0, 0.1, (w, DEPTH, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.full(FILTERS, 0.0, np.float32) for _ in WIDTHS]
    output = rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32)
    thresholds = np.zeros(len(LANGUAGES), np.float32)
    if not len(labels) or labels.min() == labels.max():
        seen = 0.0 if not len(labels) else 4.0 * (labels[0] - 0.5) * 2
        return Model(tables, filters, biases, np.zeros_like(output), float(seen) - (0.0 if len(labels) else 2.0), thresholds)
    text = np.repeat(np.arange(len(counts)), counts)
    for k, t in enumerate(tables):
        # Start from the log odds of the texts that hold the row's words, drawn to 0 where these are few.
        pairs = np.unique(text * size + rows_in(k, hashes))
        held = np.bincount(pairs % size, minlength=size)
        toxic = np.bincount(pairs % size, labels[pairs // size], minlength=size)
        share = labels.mean()
        odds = np.log((toxic + PRIOR_TEXTS * share) / (held - toxic + PRIOR_TEXTS * (1 - share)) * (1 - share) / share)
        use = held > 0
        t[use] = rng.normal(0, 0.02, (int(use.sum()), ROW))
        t[use, 0] = odds[use] / 3
    rows, ends = np.stack([rows_in(k, hashes) for k in range(len(tables))]), np.cumsum(counts)
    for f in filters:
        f[:, ::ROW, 0] = 0.5
    output[::FILTERS] = 0.5
    grads = {id(a): np.full_like(a, 1e-6) for a in (*tables, *filters, *biases, output)}
    bias, bias_g = 0.0, 1e-6

    def step(a: np.ndarray, g: np.ndarray, rate: float, at=slice(None)) -> None:
        held = grads[id(a)]
        held[at] += g * g
        a[at] -= rate * g / np.sqrt(held[at])

    for epoch in range(epochs):
        rate = 0.05 / (1 + epoch)
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            chosen = order[low : low + BATCH]
            own = counts[chosen]
            words = np.concatenate([np.arange(ends[k] - counts[k], ends[k]) for k in chosen]).astype(np.int64)
            places, starts, total = padded(own)
            ids = np.zeros((len(tables), total), np.int64)
            real = np.zeros(total, bool)
            ids[:, places], real[places] = rows[:, words], True
            x = np.zeros((total, DEPTH), np.float32)
            x[places] = np.hstack([t[ids[k, places]] for k, t in enumerate(tables)])
            answers = responses(x, filters, biases)
            limits = starts + own + 1
            best = np.stack([np.hstack([a[s:e].argmax(axis=0) + s for a in answers]) for s, e in zip(starts, limits)])
            pooled = np.hstack([a[best[:, i * FILTERS : (i + 1) * FILTERS], np.arange(FILTERS)] for i, a in enumerate(answers)])
            error = ((sigmoid(pooled @ output + bias) - labels[chosen]) * weights[chosen] / len(chosen)).astype(np.float32)
            back = error[:, None] * output * (pooled > 0)
            changes: list[tuple[np.ndarray, np.ndarray]] = []
            for i, f in enumerate(filters):
                part = slice(i * FILTERS, (i + 1) * FILTERS)
                g, p = back[:, part], best[:, part]
                df = np.zeros_like(f)
                for k in range(len(f)):
                    at = np.minimum(p + k, total - 1)
                    df[k] = np.einsum("bf,bfd->df", g, x[at])
                    changes.append((at.ravel(), (g[:, :, None] * f[k].T[None]).reshape(-1, DEPTH)))
                step(f, df + 1e-4 * f, rate)
                step(biases[i], g.sum(axis=0), rate)
            at = np.concatenate([c[0] for c in changes])
            dx = np.concatenate([c[1] for c in changes])
            live = real[at] & (np.abs(dx).sum(axis=1) > 0)
            at, dx = at[live], dx[live]
            for k, t in enumerate(tables):
                touched, back_to = np.unique(ids[k, at], return_inverse=True)
                g = np.zeros((len(touched), ROW), np.float32)
                np.add.at(g, back_to, dx[:, k * ROW : (k + 1) * ROW])
                step(t, g, rate * 0.5, touched)
            step(output, error @ pooled + 1e-4 * output, rate)
            bias_g += float(error.sum()) ** 2
            bias -= rate * float(error.sum()) / bias_g**0.5
    return Model(tables, filters, biases, output, float(bias), thresholds)


def calibrated(model: Model, counts: pa.Table) -> Model:
    """``model`` with thresholds by language from ``counts (language, bin, n, toxic)``: labelled rows by binned logit."""
    language, at, n, toxic = (counts.column(c).to_numpy() for c in ("language", "bin", "n", "toxic"))
    if not 0 < toxic.sum() < n.sum():
        return model
    common = best_threshold(at, n, toxic)
    for k in range(len(LANGUAGES)):
        own = language == k
        share = min(1.0, n[own].sum() / LANGUAGE_ROWS)
        mine = best_threshold(at[own], n[own], toxic[own]) if toxic[own].any() else common
        model.thresholds[k] = share * mine + (1 - share) * common
    return model


def logit_bins(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -LOGIT_LIMIT, LOGIT_LIMIT).astype(np.float64) * LOGIT_BINS).astype(np.int32)


def best_threshold(at: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """Middle of the gap between bins of answers at which the F1 of the toxic class is best.

    A bin is never parted; everything is toxic only if most of the rows are, and
    nothing is if no gap is left.
    """
    bins, back_to = np.unique(at, return_inverse=True)
    n, toxic = np.bincount(back_to, n), np.bincount(back_to, toxic)
    toxic_above, above = toxic[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = 2 * toxic_above / (above + toxic.sum())
    gap = np.concatenate([[toxic.sum() > 0.5 * n.sum()], np.ones(len(bins) - 1, bool)])
    best = int(np.where(gap, f1, -1).argmax())
    if not gap[best]:
        return float(bins[-1] + 1) / LOGIT_BINS + 1
    return float(bins[best] + bins[best - 1] + 1) / (2 * LOGIT_BINS) if best else float(bins[0]) / LOGIT_BINS - 1


def held_out(doc_id="doc_id"):
    """Whether labels of a row are kept from training: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents of each class, chosen by a hash of their id.

    Thresholds come from the scores of all labelled documents, as counts by binned logit.
    ``docs``: ``doc_id, text``; ``labels``: ``doc_id, toxic``. Of several labels of a
    document the largest counts; null labels, ids and held-out documents do not.
    """
    bounded_batches(docs.sparkSession)
    known = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    sizes = {int(t): n for t, n in known.groupBy(F.col("toxic").cast("int")).count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(rows).union(known.where("toxic = 0").orderBy(*order).limit(rows))
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            found, counts = word_hashes(batch.column("text").to_pylist())
            cuts = np.split(found, np.cumsum(counts)[:-1], axis=1)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "toxic": batch.column("toxic").cast(pa.int64()),
                **{name: pa.array([c[k].tobytes() for c in cuts], pa.binary()) for k, name in enumerate(kinds)},
            })

    kinds = [f"hashes_{k}" for k in range(1 + len(STEMS))]
    columns = ", ".join(f"{name} binary" for name in kinds)
    # Arrow keeps the sample in a few large buffers, which the driver gives back after the fit.
    sample = texts.mapInArrow(giving_back(hashed), f"doc_id long, toxic long, {columns}").toArrow()
    sample = sample.sort_by([(c, "ascending") for c in ("doc_id", "toxic", "hashes_0")]).combine_chunks()
    y = sample.column("toxic").to_numpy().astype(np.float32)
    # The classes weigh as many as there are labels of them.
    share = {t: sizes.get(t, 0) / max(1, int((y == t).sum())) for t in (0, 1)}
    weights = np.array([share[int(t)] for t in y], np.float32)
    weights = weights / weights.mean() if len(y) else weights
    counts = pc.binary_length(sample.column("hashes_0")).to_numpy().astype(np.int64) // 4
    hashes = np.stack([np.frombuffer(b"".join(memoryview(v.as_buffer()) for v in sample.column(name)), np.uint32) for name in kinds])
    del sample
    model = fit(hashes, counts, y, weights)
    if not len(y) or y.min() == y.max():
        return model
    del hashes, counts
    give_back()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            found, counts = word_hashes(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").cast(pa.int64()),
                "language": pa.array(languages(found, counts), pa.int32()),
                "bin": pa.array(logit_bins(sent.value.logits(found, counts)), pa.int32()),
            })

    # Texts are scored where they lie; only bins meet the labels.
    own = docs.where(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text")
    scored = own.mapInArrow(giving_back(binned), "doc_id long, language int, bin int").groupBy("doc_id", "language", "bin").count()
    label = F.col("toxic").cast("int")
    cells = (
        scored.join(known.where(label.isin(0, 1)), "doc_id").groupBy("language", "bin")
        .agg(F.sum("count").alias("n"), F.sum(F.col("count") * label).alias("toxic"))
    ).toArrow()
    sent.destroy()
    return calibrated(model, cells)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``toxic_score``: 0 to 1, at least 0.5 where the language's threshold is reached.

    The score reads nothing but ``text``. Null and empty texts score what no word
    says. A column ``toxic_score`` of ``docs`` is replaced.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if c != "toxic_score"])
    schema = docs.withColumn("toxic_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches):
            hashes, counts = word_hashes(batch.column("text").to_pylist())
            logits = sent.value.logits(hashes, counts) - sent.value.thresholds[languages(hashes, counts)]
            yield batch.append_column("toxic_score", pa.array(sigmoid(logits.astype(np.float64)), pa.float64()))

    return docs.mapInArrow(giving_back(run), schema)


def remove(docs: DataFrame, source: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents scored toxic by a model trained on ``source`` and ``labels``."""
    held, names = shielded(docs, "doc_id", "text")
    return restored(score(held, train(source, labels)).where("toxic_score < 0.5"), names)
