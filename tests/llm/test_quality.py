import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from codeaudit.llm import quality
from codeaudit.llm.queries import op12_quality

SF = "/root/testdata/sf0.01"


def bags_of(texts):
    owner, numbers = quality.encode(pa.array(texts, pa.string()))
    assert sorted(set(owner)) == list(range(len(texts))) and (np.diff(owner) >= 0).all()
    return [numbers[owner == i] for i in range(len(texts))]


def sample(rng, n):
    """Texts of which those labelled 0 hold one passage of shouting among clean ones."""
    vocabulary = [f"{a}{b}" for a in ("der", "sol", "min", "cat", "the") for b in ("a", "est", "ing", "or")]
    texts, labels = [], []
    for _ in range(n):
        parts = [" ".join(rng.choices(vocabulary, k=64)) for _ in range(rng.randint(2, 6))]
        bad = rng.random() < 0.4
        if bad:
            parts[rng.randrange(len(parts))] = " ".join(rng.choices(vocabulary, k=64)).upper()
        texts.append("\n".join(parts))
        labels.append(0.0 if bad else 1.0)
    return texts, np.array(labels, np.float32)


def test_a_passage_is_encoded_alike_wherever_it_stands():
    a, b = " ".join(f"w{i}" for i in range(64)), " ".join(f"X{i % 7}" for i in range(64))
    alone, both = bags_of([a, b, "", "  ", None, "ab"]), bags_of([f"{a} {b}"])
    assert [len(x) for x in alone] == [1] * 6 and len(both[0]) == 2
    # Three trigrams of a passage reach past its end, so shares differ a little.
    assert np.abs(both[0][1] - alone[1][0]).max() < 0.02
    assert not alone[2].any() and alone[0][0, 2 * quality.BUCKETS + 2] == 1.0
    assert alone[1][0, 2 * quality.BUCKETS + 2] == pytest.approx(7 / 64)
    repeated = bags_of(["no no no no", "no yes no yes"])
    assert repeated[0][0, 2 * quality.BUCKETS] == 0.75 and repeated[1][0, 2 * quality.BUCKETS + 1] == 0.5


def test_gradients_by_differences():
    """One step of learning moves the loss as its gradient says: the loss falls on the bags it is shown."""
    rng = random.Random(1)
    texts, labels = sample(rng, 60)
    bags = bags_of(texts)

    def loss(model):
        out = []
        for bag, y in zip(bags, labels):
            h, logit = model.represent(bag)
            p = float(model.score(h, logit, np.array([0]))[0][0])
            out.append(-np.log(p if y else 1 - p))
        return np.mean(out)

    assert loss(quality.fit(bags, labels, epochs=30)) < 0.3 * loss(quality.fit(bags, labels, epochs=1))


def test_attention_finds_the_passage_that_decides():
    rng = random.Random(2)
    texts, labels = sample(rng, 300)
    model = quality.fit(bags_of(texts), labels)
    texts, labels = sample(rng, 200)
    right = found = bad = 0
    for bag, y, text in zip(bags_of(texts), labels, texts):
        h, logit = model.represent(bag)
        score, weight = model.score(h, logit, np.array([0]))
        right += (score[0] >= 0.5) == bool(y)
        if not y:
            bad += 1
            found += text.split("\n")[int(weight.argmax())].isupper()
    assert right >= 190 and found >= 0.8 * bad


def test_odd_rows_and_labels(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    texts, labels = sample(rng, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "no id"), (100, None), (101, ""), (102, " \n"), (0, texts[0]), (0, "other text")]
    rows.append((103, "\n".join(texts) * 100))
    docs = docs_of(rows)
    marks = spark.createDataFrame([(i, float(y)) for i, y in enumerate(labels)] + [(0, 0.0), (None, 1.0), (100, None), (999, 1.0)],
                                  "doc_id long, label double")
    model = quality.train(docs, marks)
    got = quality.scored(docs, model).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(map(repr, (d for d, _ in rows)))
    assert all(0 <= r.score <= 1 and r.n_passages >= 1 and 0 < r.top_weight <= 1.001 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[100][1:] == by_id[101][1:] and by_id[100].n_passages == 1
    # The model does not depend on how rows are dealt out, nor a score on the pieces a long text is encoded in.
    again = quality.train(docs.repartition(7), marks.repartition(2))
    assert all(np.array_equal(model.weights[k], again.weights[k]) for k in model.weights)
    small = quality.train(docs, marks, sample_rows=20)
    assert not np.array_equal(model.weights["W"], small.weights["W"])
    none, ones = quality.train(docs, marks.limit(0)), quality.train(docs, marks.filter("label = 1"))
    assert {r.score for r in quality.scored(docs, none).collect()} == {0.5}
    assert {r.score for r in quality.scored(docs, ones).collect()} == {1.0}
    assert quality.scored(docs.limit(0), model).count() == 0


def test_long_text_in_pieces(docs_of, monkeypatch):
    rng = random.Random(4)
    texts, labels = sample(rng, 80)
    model = quality.fit(bags_of(texts), labels)
    long = "\n".join(texts)
    whole = pa.RecordBatch.from_pydict({"text": pa.array([long], pa.string())})
    numbers = [np.concatenate([x for _, x in parts]) for _, parts in quality.encoded(whole, 0)][0]
    monkeypatch.setattr(quality, "SLICE", 3000)
    pieces = [np.concatenate([x for _, x in parts]) for _, parts in quality.encoded(whole, 0)][0]
    assert len(numbers) <= len(pieces) <= len(numbers) + len(long) // 2900 + 1
    one, many = (float(model.score(*model.represent(x), np.array([0]))[0][0]) for x in (numbers, pieces))
    assert abs(one - many) < 0.1


def test_query_on_held_out_labels(spark):
    got = {r.doc_id: r for r in op12_quality(spark, SF).collect()}
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet").collect() for t in ("documents", "labels"))
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for d, r in got.items())
    held = [(got[x.doc_id], x.quality) for x in labels if got[x.doc_id].held_out]
    assert len(held) > 50 and sum(r.predicted == q for r, q in held) >= 0.95 * len(held)
