"""Document quality by attention-based multiple-instance learning.

A text is a bag of passages of `PASSAGE` = 64 words; only the bag has a label.

1. Every passage is encoded: square roots of the shares of its hashed byte trigrams
   (as they stand, and as classes of characters: capitals, small letters, digits,
   each mark, white space, other), shares of words equal to the one or two words
   before and of distinct words, and word lengths.  A learned layer (tanh) turns
   these numbers into a passage representation h.
2. Gated attention: the weight of a passage is the softmax over the text's passages
   of w . (tanh(V h) * sigmoid(U h)); the text is the weighted sum of its passages'
   representations, and a logistic output gives the score.
3. Layer, gates and output are learned together from the labels of whole texts by
   Adam, on a bounded sample: `sample_rows` = 4,000 labelled ids chosen by hash, of
   texts up to `LEARNED_BYTES` = 1 MiB, and of these, again by hash, no more than
   some `sample_bytes` = 24 MB.  The order of the sample is that of its hashes, so
   the model does not depend on how rows are dealt out.

Every text is encoded and scored whole, in the tasks that read it; there is no
shuffle but that of the sample.  A long text is encoded in pieces of 4 MiB cut
at white space (a passage ends there), of which only the representations are kept.

Defined results: words are cut at ASCII white space.  A null text is an empty
one; a text without words is one empty passage, and scored like any other.  An
id with several labels is learned with their mean, one with several texts with the
largest.  Labels that are null or have no text are left out.  Without labels the
score is 0.5, with labels of one kind that kind.  Repeated rows and rows without an
id are scored one by one; empty tables give empty results; other columns do not
take part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeaudit.llm.common import join_checked, pieces, stored
from codeaudit.llm.wordcodes import SLICE, codes, slices, split_words, text_bytes

PASSAGE = 64
SAMPLE_ROWS, SAMPLE_BYTES, LEARNED_BYTES = 4000, 24_000_000, 1 << 20
BUCKETS = 128
WIDTH = 2 * BUCKETS + 6
HIDDEN, GATES = 32, 16
EPOCHS, BAGS, RATE, DECAY, SEED = 8, 32, 3e-3, 1e-4, 42
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 97, 65, 48, 128
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row of every passage of the texts, and its numbers (passages x WIDTH)."""
    raw, at = text_bytes(texts)
    words, row = split_words(texts)
    code, _ = codes(words)
    space = _SPACE[raw]
    begin = ~space
    begin[1:] &= space[:-1]
    begin[at[:-1][at[:-1] < len(raw)]] = ~space[at[:-1][at[:-1] < len(raw)]]
    word_at = np.flatnonzero(begin)
    first = np.searchsorted(row, np.arange(len(texts)))
    place = np.arange(len(row)) - first[row]
    # Passages tile their row; the first begins where the row does, also when it has no word.
    later = np.flatnonzero((place % PASSAGE == 0) & (place > 0))
    owner = np.concatenate([np.arange(len(texts)), row[later]])
    start = np.concatenate([at[:-1], word_at[later]])
    order = np.lexsort((start, owner))
    owner, start = owner[order], start[order]
    n = len(owner)
    length = np.diff(np.append(start, at[-1]))
    of_byte = np.repeat(np.arange(n, dtype=np.int64), length)
    numbers = np.zeros((n, WIDTH), np.float32)
    if len(raw) > 2:
        whole = owner[of_byte[2:]] == owner[of_byte[:-2]]
        base = of_byte[:-2][whole] * BUCKETS
        for k, kind in enumerate((raw, _CLASS[raw])):
            u = kind.astype(np.uint32)
            mixed = (u[:-2] << np.uint32(16) | u[1:-1] << np.uint32(8) | u[2:]) * np.uint32(2654435761)
            got = np.bincount(base + (mixed >> np.uint32(25))[whole], minlength=n * BUCKETS).reshape(n, BUCKETS)
            numbers[:, k * BUCKETS:(k + 1) * BUCKETS] = np.sqrt(got / np.maximum(got.sum(axis=1, keepdims=True), 1))
    if len(code):
        index = np.searchsorted(start, word_at, "right") - 1
        # Several empty rows may begin where a word does; the word's own passage is the last of them.
        count = np.maximum(np.bincount(index, minlength=n), 1)
        for k, back in enumerate((1, 2)):
            same = np.append(np.zeros(min(back, len(code)), bool), (code[back:] == code[:-back]) & (row[back:] == row[:-back]))
            numbers[:, 2 * BUCKETS + k] = np.bincount(index, weights=same, minlength=n) / count
        pair = np.sort(index * (int(code.max()) + 1) + code)
        distinct = pair[np.append(True, pair[1:] != pair[:-1])] // (int(code.max()) + 1)
        numbers[:, 2 * BUCKETS + 2] = np.bincount(distinct, minlength=n) / count
        numbers[:, 2 * BUCKETS + 3] = np.bincount(index, minlength=n) / PASSAGE
        numbers[:, 2 * BUCKETS + 4] = np.minimum(length / count, 64) / 16
        numbers[:, 2 * BUCKETS + 5] = np.sqrt(np.bincount(of_byte, weights=raw == 10, minlength=n) / count)
    return owner, numbers


def encoded(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, Iterator[tuple[np.ndarray, np.ndarray]]]]:
    """Slices of a batch, each with its passages in parts of bounded size."""
    def parts(some: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if some.num_rows > 1 or len(some.column(text)[0].as_buffer()) <= SLICE:
            yield encode(some.column(text))
        else:
            for piece in pieces(some.column(text)[0].as_buffer().to_pybytes(), SLICE):
                owner, numbers = encode(pa.array([piece], pa.binary()).view(pa.string()))
                yield owner, numbers

    for some in slices(batch, text):
        yield some, parts(some)


class AttentionModel:
    """Encoder layer, gated attention and output, as plain arrays that travel with the tasks."""

    def __init__(self, weights: dict[str, np.ndarray] | None, shift: np.ndarray | None = None, scale: np.ndarray | None = None,
                 constant: float = 0.5):
        self.weights, self.shift, self.scale, self.constant = weights, shift, scale, constant

    def represent(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Representation and attention logit of every passage."""
        p = self.weights
        h = np.tanh((numbers - self.shift) * self.scale @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) / (1 + np.exp(-h @ p["U"]))) @ p["w"]

    def score(self, h: np.ndarray, logit: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The score of every bag, given where its passages begin, and the weight of every passage in its bag."""
        n = np.diff(np.append(first, len(logit)))
        raised = np.exp(logit - np.repeat(np.maximum.reduceat(logit, first), n))
        weight = raised / np.repeat(np.add.reduceat(raised, first), n)
        z = np.add.reduceat(h * weight[:, None], first, axis=0)
        return 1 / (1 + np.exp(-(z @ self.weights["c"] + self.weights["d"]))), weight


def fit(bags: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> AttentionModel:
    """Learn from bags (passages x WIDTH each) with one label of 0 to 1 each."""
    if not len(bags) or labels.min() == labels.max():
        return AttentionModel(None, constant=float(labels.mean()) if len(bags) else 0.5)
    rng = np.random.default_rng(seed)
    total = sum(map(len, bags))
    shift = sum(b.sum(axis=0, dtype=np.float64) for b in bags) / total
    spread = np.sqrt(sum(((b - shift) ** 2).sum(axis=0) for b in bags) / total)
    scale = (1 / np.maximum(spread, 0.02)).astype(np.float32)
    shift = shift.astype(np.float32)
    base = float(np.clip(labels.mean(), 0.01, 0.99))
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    p = {"W": draw(WIDTH, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": draw(HIDDEN, GATES), "U": draw(HIDDEN, GATES),
         "w": draw(GATES), "c": np.zeros(HIDDEN, np.float32), "d": np.float32(np.log(base / (1 - base)))}
    model = AttentionModel(p, shift, scale)
    mean, square = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        rate = RATE * (1 - epoch / epochs) + RATE / 20
        for low in range(0, len(bags), BAGS):
            some = order[low: low + BAGS]
            n = np.array([len(bags[i]) for i in some])
            first = np.cumsum(n) - n
            x = (np.concatenate([bags[i] for i in some]).astype(np.float32) - shift) * scale
            h = np.tanh(x @ p["W"] + p["b"])
            t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
            score, a = model.score(h, (t * s) @ p["w"], first)
            # Gradients of the mean log loss.
            dz = ((score - labels[some]) / len(some)).astype(np.float32)
            z = np.add.reduceat(h * a[:, None], first, axis=0)
            back = np.repeat(dz, n)
            da = back * (h @ p["c"])
            dlogit = a * (da - np.repeat(np.add.reduceat(a * da, first), n))
            dt, ds = dlogit[:, None] * p["w"] * s * (1 - t * t), dlogit[:, None] * p["w"] * t * s * (1 - s)
            dh = (back * a)[:, None] * p["c"] + dt @ p["V"].T + ds @ p["U"].T
            dx = dh * (1 - h * h)
            gradient = {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "w": (t * s).T @ dlogit,
                        "c": z.T @ dz, "d": dz.sum()}
            step += 1
            for k, g in gradient.items():
                if k not in "bd":
                    g = g + DECAY * p[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                move = rate * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
                p[k] = (p[k] - move).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> AttentionModel:
    """Fit on docs(doc_id, text) with labels(doc_id, label), label being 0.0 to 1.0."""
    share = lambda x: int(min(1.0, x) * (1 << 30))
    named = labels.filter("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("label"))
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    named = named.withColumn("drawn", drawn)
    chosen = stored(named.filter(F.col("drawn") < share(sample_rows / max(1, named.count()))))
    short = docs.filter(F.octet_length("text") <= LEARNED_BYTES).select("doc_id", "text")
    texts = stored(join_checked(short, chosen, ["doc_id"]).groupBy("doc_id", "label", "drawn").agg(F.max("text").alias("text")))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    again = F.pmod(F.xxhash64("drawn", "doc_id"), F.lit(1 << 30))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, parts in encoded(batch, 3):
                owner, numbers = next(parts)
                first = np.searchsorted(owner, np.arange(some.num_rows + 1))
                held = [numbers[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(held, pa.binary())], names=["doc_id", "label", "drawn", "held"])

    got = (texts.filter(again < share(sample_bytes / max(1, size))).select("doc_id", "label", "drawn", "text")
           .mapInArrow(bags, "doc_id long, label double, drawn long, held binary").collect())
    got.sort(key=lambda r: (r["drawn"], r["doc_id"]))
    return fit([np.frombuffer(r["held"], np.float16).reshape(-1, WIDTH) for r in got], np.array([r["label"] for r in got], np.float32))


def scored(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """doc_id, score, n_passages, and the number and weight of the passage with most attention, for every row of docs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, parts in encoded(batch, 1):
                owners, hs, logits = [], [], []
                for owner, numbers in parts:
                    owners.append(owner)
                    if model.weights is not None:
                        h, logit = model.represent(numbers)
                        hs.append(h), logits.append(logit)
                owner = np.concatenate(owners)
                first = np.searchsorted(owner, np.arange(some.num_rows))
                n = np.diff(np.append(first, len(owner)))
                if model.weights is None:
                    score, weight = np.full(some.num_rows, model.constant), 1 / np.repeat(n, n)
                else:
                    score, weight = model.score(np.concatenate(hs), np.concatenate(logits), first)
                # The first passage of largest weight.
                order = np.lexsort((np.arange(len(owner)), -weight, owner))[first]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(score.astype(np.float64)), pa.array(n), pa.array(order - first),
                     pa.array(weight[order].astype(np.float64))], names=["doc_id", "score", "n_passages", "top_passage", "top_weight"])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, n_passages long, top_passage long, top_weight double")
