"""The classifiers against plain versions, fitted anew from their definitions."""

import math
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import labelled, quality, toxicity
from siltstone.llm.common import table

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DIR, "documents").select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "ŻÓŁW 12, 日本 ¿que?\n\nŻÓŁW")]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in table(spark, DIR, "labels").collect()] + [(10**6, 0, 1), (10**6 + 1, 0, 0), (5 * 10**6, 1, 1)]
    return docs, labels


@pytest.fixture(scope="module")
def frames(spark, rows):
    return spark.createDataFrame(rows[0], "doc_id long, text string"), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")


def training(rows, which):
    """Texts and labels of the labelled documents that aren't held out, by doc_id."""
    texts = dict(rows[0])
    found = sorted((r[0], r[which]) for r in rows[1] if r[0] in texts and zlib.crc32(str(r[0]).encode()) % 5)
    return [texts[i] or "" for i, _ in found], np.array([y for _, y in found])


def descend(slope, size, steps, penalty):
    """Adam, as published, on a mean logistic loss."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = slope(w) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g**2
        w = w - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def shares(text):
    """A document's measures, a character at a time."""
    if not text:
        return [0.0] * 14
    kinds = Counter()
    for c in text:
        kind = unicodedata.category(c) if ord(c) < 0x3000 else unicodedata.category("⿿")
        kinds["upper" if kind == "Lu" else "letter" if kind[0] in "LM" else "digit" if kind[0] == "N" else "mark" if c in ".,;:'\"-" else "space" if c.isspace() and ord(c) < 0x3000 else "sign"] += 1
    solid, words, lines = max(1, len(text) - kinds["space"]), text.split(), [x for x in text.split("\n") if x]
    m, pairs = max(1, len(words)), list(zip(words, words[1:]))
    return [
        kinds["upper"] / solid, (kinds["upper"] + kinds["letter"]) / solid, kinds["digit"] / solid, kinds["mark"] / solid, kinds["sign"] / solid, kinds["space"] / len(text),
        sum(a == b for a, b in pairs) / m, len(set(words)) / m, max(Counter(words).values(), default=0) / m, len(set(pairs)) / max(1, len(words) - 1),
        len(set(lines)) / max(1, len(lines)), solid / m, kinds["sign"] / m, math.log1p(len(words)),
    ]


def test_quality_equals_a_plain_fit(rows, frames):
    texts, y = training(rows, 1)
    x = np.array([shares(t) for t in texts])
    edges = np.quantile(x, quality.QUANTILES, axis=0).T
    code = lambda t: np.array([v > e for v, row in zip(shares(t), edges) for e in row], float)
    phi = np.array([code(t) for t in texts])
    good, bad, pick = np.flatnonzero(y == 1), np.flatnonzero(y == 0), np.random.default_rng(17)
    apart = phi[pick.choice(good, quality.PAIRS)] - phi[pick.choice(bad, quality.PAIRS)]
    w = descend(lambda w: -(apart / (1 + np.exp(apart @ w))[:, None]).mean(axis=0), phi.shape[1], 300, 1e-3)
    ranked = np.sort(phi @ w)
    cut = (ranked[len(bad) - 1] + ranked[len(bad)]) / 2
    want = {i: 1 / (1 + math.exp(-(code(t) @ w - cut + math.log(0.3 / 0.7)))) for i, t in rows[0]}
    got = {r["doc_id"]: r for r in quality.judge(*frames).collect()}
    assert len(got) == len(want)
    for i, s in want.items():
        assert got[i]["score"] == pytest.approx(s, abs=2e-3) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i]["predicted"] == (got[i]["score"] >= 0.3)


def buckets(text):
    """The hashed n-grams of a text, one after the other."""
    chars, out = [ord(c) for c in text.lower()], set()
    for i in range(len(chars)):
        h = chars[i]
        for n in range(2, 7):
            if i + n > len(chars):
                break
            h = (h * 0x01000193 + chars[i + n - 1]) % 2**32
            if n >= 3:
                out.add(((h + n) % 2**32 * 0x9E3779B1 % 2**32) >> 14)
    return out


def test_toxicity_equals_a_plain_fit(rows, frames):
    texts, y = training(rows, 2)
    found = [buckets(t) for t in texts]
    pos, neg = int(y.sum()), int((1 - y).sum())
    p, q = (Counter(b for f, label in zip(found, y) if label == want for b in f) for want in (1, 0))
    ratio, told = {}, {}
    for b in set(p) | set(q):
        a, c = (p[b] + 1) / (pos + 2), (q[b] + 1) / (neg + 2)
        both = (p[b] + q[b] + 2) / (pos + neg + 4)
        ratio[b] = math.log(a / c)
        told[b] = sum(n * (x * math.log(x / both) + (1 - x) * math.log((1 - x) / (1 - both))) for n, x in ((pos, a), (neg, c)))
    kept = sorted(sorted(told, key=lambda b: (-round(told[b], 9), b))[: min(toxicity.KEPT, sum(t > toxicity.LEAST_GAIN for t in told.values()))])
    at = {b: i for i, b in enumerate(kept)}
    x = np.zeros((len(texts), len(kept) + 1))
    x[:, -1] = 1
    for i, f in enumerate(found):
        for b in f & at.keys():
            x[i, at[b]] = ratio[b]
    w = descend(lambda w: x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y), len(kept) + 1, 600, 1e-5)
    want = {i: 1 / (1 + math.exp(-(sum(ratio[b] * w[at[b]] for b in buckets(t or "") & at.keys()) + w[-1]))) for i, t in rows[0]}
    got = {r["doc_id"]: r for r in toxicity.judge(*frames).collect()}
    assert len(got) == len(want) and kept
    for i, s in want.items():
        assert got[i]["score"] == pytest.approx(s, abs=2e-3) and got[i]["predicted"] == (got[i]["score"] >= 0.5)


def test_quality_learns_from_all_labelled_rows(spark):
    """Rows beyond the 10,000 of lowest hashed ids, the whole training sample once, are learnt from too."""
    ids = spark.range(15_700).where(~labelled.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id")
    ids = [r["id"] for r in ids.collect()]
    rows = [(i, "PLAIN WORDS IN A ROW" if n % 5 == 0 else "plain words in a row", int(n % 5 > 0)) for n, i in enumerate(ids[:10_000])]
    rows += [(i, "12345 67890 12 3 456" if n % 2 else "plain words in a row", 1 - n % 2) for n, i in enumerate(ids[10_000:])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = {r["text"]: r["predicted"] for r in quality.judge(frame.select("doc_id", "text"), frame.select("doc_id", "quality")).select("doc_id", "predicted").join(frame, "doc_id").collect()}
    assert len(rows) > 12_000 and got == {"plain words in a row": 1, "PLAIN WORDS IN A ROW": 0, "12345 67890 12 3 456": 0}


def test_quality_steps_over_tables_equal_those_over_arrays(spark, rows, frames):
    texts, y = training(rows, 1)
    train = quality.training(quality.measured(frames[0]), frames[1])
    edges = quality.quantiles(train, len(y))
    np.testing.assert_allclose(edges, np.quantile(np.array([shares(t) for t in texts]), quality.QUANTILES, axis=0).T, atol=1e-12)
    placed = quality.placed(train, edges)
    at = placed.orderBy("label", "rank").collect()
    n_good, n_bad = int(y.sum()), int((1 - y).sum())
    assert [(r["label"], r["rank"]) for r in at] == [(0, i) for i in range(n_bad)] + [(1, i) for i in range(n_good)]
    met = quality.pairs(placed, n_good, n_bad)
    drawn = [(bytes(r["good"]), bytes(r["bad"])) for r in met.collect()]
    assert len(drawn) == quality.MET * len(y)
    for label, side in ((1, 0), (0, 1)):  # each row takes part, with those of the other class
        sides, own = Counter(p[side] for p in drawn), Counter(bytes(r["digit"]) for r in at if r["label"] == label)
        assert sides.keys() == own.keys() and all(sides[d] >= quality.MET * n for d, n in own.items())
    w = np.random.default_rng(1).normal(size=edges.size)
    good, bad = (np.frombuffer(b"".join(p[side] for p in drawn), np.uint16).reshape(len(drawn), -1).T for side in (0, 1))
    assert (quality.descended(quality.blocks(met, len(drawn)), w) == quality.slopes(good, bad, w)).all()


def test_toxicity_learns_from_all_labelled_rows(spark, frames, monkeypatch):
    """Rows beyond 10,000 are learnt from too, and steps over a table equal those of the driver."""
    many = spark.range(15_700).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.lit(1).alias("toxic"))
    assert labelled.training(many, many, "toxic").count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(15_700)) > 12_000
    monkeypatch.setattr(toxicity, "logistic", lambda slope, size, steps, penalty: labelled.logistic(slope, size, 15, penalty=penalty))
    held = toxicity.fit(*frames)
    monkeypatch.setattr(toxicity, "HELD", 0)
    by_jobs = toxicity.fit(*frames)
    assert held[0].any() and (held[0] == by_jobs[0]).all() and held[1] == by_jobs[1]


def test_toxicity_of_many_texts_takes_few_passes(rows, frames, monkeypatch):
    """The least loss, no higher than that of 600 steps, in a fraction of their passes over the table."""
    texts, y = training(rows, 2)
    at = [np.unique(toxicity.grams(t)) for t in texts]
    kept = {}

    def loss(w, bias):
        """The fitted loss of weights of hashed n-grams, with its penalty on what multiplies the log ratios."""
        margins = np.array([w[a].sum() for a in at]) + bias
        v = kept["w"]
        return np.mean(np.logaddexp(0, margins) - y * margins) + 5e-6 * v @ v

    passes = []
    seen = toxicity.descended
    monkeypatch.setattr(toxicity, "descended", lambda table, w: passes.append(1) or seen(table, w))
    for name in ("logistic", "minimised"):
        own = getattr(labelled, name)
        monkeypatch.setattr(toxicity, name, lambda *a, own=own, **b: kept.update(w=own(*a, **b)) or kept["w"])
    stepped = loss(*toxicity.fit(*frames))
    monkeypatch.setattr(toxicity, "FEW", 0)
    by_driver = toxicity.fit(*frames)
    assert loss(*by_driver) <= stepped
    monkeypatch.setattr(toxicity, "HELD", 0)
    by_jobs = toxicity.fit(*frames)
    assert (by_driver[0] == by_jobs[0]).all() and by_driver[1] == by_jobs[1] and 1 < len(passes) < 120


def test_minimised_equals_newton():
    draw = np.random.default_rng(5)
    x, truth = draw.normal(size=(300, 6)) * [1, 2, 5, 0.1, 1, 1], np.array([1, -1, 0.5, 2, 0, 3.0])
    y = draw.random(300) < labelled.sigmoid(x @ truth)
    w = np.zeros(6)
    for _ in range(30):
        p = labelled.sigmoid(x @ w)
        w = w - np.linalg.solve(x.T * (p * (1 - p)) @ x / 300 + 1e-4 * np.eye(6), x.T @ (p - y) / 300 + 1e-4 * w)
    calls = []
    got = labelled.minimised(lambda v: calls.append(1) or x.T @ (labelled.sigmoid(x @ v) - y) / 300, 6)
    np.testing.assert_allclose(got, w, atol=1e-4)
    assert len(calls) < 60
    assert not labelled.minimised(lambda v: np.zeros(3), 3).any()
    assert len(labelled.minimised(lambda v: v - 1e9, 1, penalty=0, most=3)) == 1
