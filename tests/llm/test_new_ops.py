"""Packing, panes with revisions, and importance draws against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import fair_mix, fair_packing, importance_draw, pane_revisions, vector_search
from siltstone.llm.common import new_path

from .test_ops import ROWS, SCHEMA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 3, 4) for r in ROWS], SCHEMA)


def library(text):
    t = Tokenizer.from_file(PATH)
    return [*t.encode(text or "", add_special_tokens=False).ids, 1]


def packed_by_force(tokens: dict, length: int) -> list[list]:
    """Windows of (queue, place): tokens in order of (place + 1/2) / tokens of the queue, exactly."""
    order = sorted((Fraction(2 * i + 1, 2 * n), q, i) for q, n in tokens.items() for i in range(n))
    out, at = [], 0
    while len(order) - at >= length:
        out.append(order[at : at + length])
        at += length
    rest = len(order) - at
    for bit in reversed(range(length.bit_length())):
        if rest >> bit & 1:
            out.append(order[at : at + (1 << bit)])
            at += 1 << bit
    return [sorted((q, i) for _, q, i in w) for w in out]


@pytest.mark.parametrize("seed", range(6))
def test_round_equals_brute_force(seed):
    rng = random.Random(seed)
    tokens = [rng.choice([1, 3, 40, 700, 1500]) for _ in range(rng.randint(1, 7))]
    order = fair_packing.Round(tokens, tokens, 64)
    windows = packed_by_force(dict(enumerate(tokens)), 64)
    # Each queue as documents of random sizes.
    docs = []
    for q, n in enumerate(tokens):
        at = 0
        while at < n:
            size = min(n - at, rng.choice([1, 2, 50, 400]))
            docs.append((q, at, size))
            at += size
    rng.shuffle(docs)
    got = defaultdict(list)
    for d, w, begin, end, offset in zip(*order.cuts(*(np.array(x) for x in zip(*docs)))):
        got[int(w)] += [(int(offset) + i, docs[d][0], int(begin) + i) for i in range(int(end - begin))]
    assert len(got) == len(windows)
    for w, want in enumerate(windows):
        assert [(q, i) for _, q, i in sorted(got[w])] == want
        assert [o for o, _, _ in sorted(got[w])] == list(range(len(want)))
    had = np.zeros(len(tokens))
    for w, want in enumerate(windows):
        had += np.bincount([q for q, _ in want], minlength=len(tokens))
        assert np.abs(had - had.sum() * np.array(tokens) / sum(tokens)).max() <= 2  # the deficit that a window leaves: a token or a little more


def test_round_with_targets():
    order = fair_packing.Round([600, 600, 100], [3, 1, 1], 50)
    served = order.served(np.arange(0, 1301, 50))
    assert (np.diff(served, axis=0) >= 0).all() and served[-1].tolist() == [600, 600, 100] and (served.sum(axis=1) == np.arange(0, 1301, 50)).all()
    assert served[4].tolist() == [120, 40, 40]  # all have some: 3 to 1 to 1
    assert served[12].tolist()[2] == 100 and served[-2].tolist() == [600, 550, 100]  # those that ran out leave their turns


def check_pieces(rows, texts, length):
    """Every id once, gapless windows, padding nowhere."""
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    assert sorted(windows) == list(range(len(windows)))
    for w in windows.values():
        at = 0
        for offset, n in sorted(w):
            assert offset == at and n > 0
            at += n
        assert at == length or at & (at - 1) == 0
    for doc_id, ids in texts.items():
        want = Counter((a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()), len(x)) for x in ids for a, n, _, total in pieces[doc_id] if total == len(x))
        assert set(pieces[doc_id]) <= set(want)
        assert sum(n for _, n, _, _ in pieces[doc_id]) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for start, n, _, _ in sorted(pieces[doc_id]):
                assert start == at
                at += n


def test_packing(spark, docs):
    texts = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        texts[doc_id].append(library(text))
    rows = fair_packing.pack(docs, PATH).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    check_pieces(rows, texts, 2048)
    # Small windows: the sources with less than one token in a window share the last queue.
    rows = fair_packing.pack(docs.repartition(3), PATH, length=8, ids=True).collect()
    check_pieces(rows, texts, 8)
    sources = {r[0]: r[3] for r in ROWS if r[0] is not None}
    queues = {sources[r["doc_id"]]: r["queue"] for r in rows if r["doc_id"] is not None}
    assert queues["b"] == 0 and len(set(queues.values())) == 2
    wide = fair_packing.sequences(fair_packing.pack(docs, PATH, length=64, ids=True)).collect()
    assert sorted(i for r in wide for i in r["ids"]) == sorted(i for x in texts.values() for ids in x for i in ids)
    assert all(len(r["ids"]) == 64 == sum(p["length"] for p in r["pieces"]) for r in wide if r["sequence_id"] < len(wide) - 8)
    assert fair_packing.pack(docs.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        fair_packing.pack(docs, PATH, length=100)


def panes_by_force(rows):
    once = {}
    for click_id, ts, arrived, kind, value in sorted(rows, key=lambda r: tuple((x is not None, x) for x in (r[1], r[2] or r[1], r[3], r[4]))):
        if ts is not None:
            once.setdefault(click_id, (ts, arrived or ts, kind or "none", value))
    zero, hour = datetime(1970, 1, 1), timedelta(hours=1)
    batches = defaultdict(list)
    for click_id, (ts, arrived, kind, value) in once.items():
        day = (arrived.date() - zero.date()).days
        turn = day % 10
        late = max(0, zlib.crc32(str(click_id).encode()) % 30 - 23)
        at = ts - timedelta(days=day - turn)
        cents = math.floor(100 * value + 0.5) if value is not None and math.isfinite(value) else 0
        batches[min(9, turn + late)].append((at, (at - zero) // hour, kind, click_id, cents))
    out, panes, emitted, top = [], {}, set(), None
    for b in range(10):
        end = lambda p: zero + (p[0] + 1) * hour
        closed = lambda p: top is not None and top >= end(p) + timedelta(days=2)
        old = dict(panes)
        for _, h, kind, click_id, cents in batches[b]:
            if closed((h, kind)):
                out.append((b, h, click_id, 1, cents, "late", kind))
            else:
                n, c = panes.get((h, kind), (0, 0))
                panes[h, kind] = (n + 1, c + cents)
        for p in sorted(panes):
            if p in emitted and panes[p] != old[p]:
                out += [(b, p[0], -1, *old[p], "retract", p[1]), (b, p[0], -1, *panes[p], "replace", p[1])]
        for p in sorted(panes):
            if p not in emitted and top is not None and top >= end(p) + timedelta(hours=12):
                out.append((b, p[0], -1, *panes[p], "emit", p[1]))
                emitted.add(p)
        panes = {p: v for p, v in panes.items() if not closed(p)}
        top = max([x[0] for x in batches[b]] + ([top] if top else []), default=None)
    return out + [(9, p[0], -1, *v, "final", p[1]) for p, v in panes.items() if p not in emitted]


def test_panes_equal_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(600):
        arrived = datetime(2024, 1, 1) + timedelta(days=rng.choice([0, 1, 2, 5, 7, 8, 9]), seconds=rng.randrange(86400))  # no rows of days 3, 4 and 6
        ts = arrived - timedelta(seconds=rng.choice([5, 4000, 90000, 400000, 2_000_000]) * rng.random())
        rows.append((i, ts, arrived, rng.choice(["a", "b", None, "none"]), rng.choice([None, 1.005, -2.5, float("nan"), float("inf"), 3.0])))
    rows += [*rows[:40], (0, rows[0][1], rows[0][2], "z", 9.0), (700, None, rows[5][2], "a", 1.0), (701, rows[6][1], None, "a", 1.0)]
    schema = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double, batch string, hour string, at int"
    clicks = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], schema)
    got = sorted((r["batch"], r["hour"], r["click_id"], r["n_rows"], r["cents"], r["record"], r["kind"]) for r in pane_revisions.revisions(clicks).collect())
    want = sorted(panes_by_force(rows))
    assert got == want
    assert {r[5] for r in want} == {"emit", "late", "retract", "replace", "final"} and min(r[1] for r in want) < 0
    assert pane_revisions.revisions(clicks.limit(0)).count() == 0


def test_panes_open_their_stores_once_more_whatever_the_batches(spark, monkeypatch):
    """Each opening of a store leaves memory behind: beside the stream's own, one read brings the changes of all batches, or of those since the last one."""
    start, reads = datetime(2024, 1, 1), []
    rows = [(i, start + timedelta(hours=i * 7 % 200 - 30 * (i % 3)), start + timedelta(hours=i * 7 % 200), "ab"[i % 2], 1.0) for i in range(300)]
    clicks = spark.createDataFrame(rows, "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, kind string, value double")
    own = DataFrameReader.format
    monkeypatch.setattr(DataFrameReader, "format", lambda self, source: reads.append(source) or own(self, source))
    at_once = sorted(map(tuple, pane_revisions.revisions(clicks).collect()))
    assert reads == ["statestore"]
    stream, arrived = pane_revisions.PaneStream(spark, new_path(spark, "panes")), pane_revisions.batches(clicks).cache()
    for turn in range(10):
        stream.advance(arrived.where(F.col("batch") == turn))
        if turn % 4 == 2:
            stream.settle()
            assert {r["batch"] for r in stream.records().select("batch").distinct().collect()} <= set(range(turn + 1))
    stream.settle(last=True)
    assert sorted(map(tuple, stream.records().collect())) == at_once and {"emit", "late", "retract", "replace", "final"} == {r[5] for r in at_once}
    assert len(reads) == 4


def words(text):
    out, word = [], ""
    for c in text or "":
        c = c.lower() if c.isascii() else c
        if not c.isascii() or c.isdigit() or "a" <= c <= "z":
            word += c
        else:
            out += [word] * bool(word)
            word = ""
    return out + [word] * bool(word)


def runs(text, n):
    w = words(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_ring_emits_the_crc_of_every_run(n):
    for text in ["", "one", "Two WORDS", "a b-c'd 12 É日本  \x7f tail", "x " * 50, " nbsp É"]:
        crcs, count = importance_draw.ring(text.encode(), n)
        assert sorted(crcs) == sorted(zlib.crc32(r.encode()) for r in runs(text, n)) and count == len(words(text))


@pytest.mark.parametrize("n,buckets", [(2, 10_000), (3, 70_000)])
def test_draw_equals_brute_force(spark, docs, n, buckets):
    target = spark.createDataFrame([(1, "equal text of a target"), (2, None), (3, "word1 word2 word3")], "item_id long, text string")
    s, t = (Counter(zlib.crc32(r.encode()) % buckets for text in texts for r in runs(text, n)) for texts in ([r[1] for r in ROWS], ["equal text of a target", None, "word1 word2 word3"]))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets))))
    want = []
    for doc_id, text, *_ in ROWS:
        g = [gain(zlib.crc32(r.encode()) % buckets) for r in runs(text, n)]
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(g) // len(g) if g else 0
        want.append((doc_id, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(text))))
    fit = sorted((x for x in want if x[4] >= 2), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    rank = {x[:4]: i + 1 for i, x in enumerate(fit) if i < len(fit) * 50 // 100}
    rows = importance_draw.draw(docs, target, percent=50, least_words=2, n=n, buckets=buckets).collect()
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in rows) == Counter(x[:4] for x in want)
    ranked = sorted((r["rank"], r["doc_id"]) for r in rows if r["rank"] is not None)
    assert [x for x, _ in ranked] == list(range(1, len(fit) // 2 + 1)) and {x[0] for x in rank} == {d for _, d in ranked}
    kept = importance_draw.drawn(docs, target, percent=50, least_words=2, n=n, buckets=buckets)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for _, d in ranked}


def test_draw_of_nothing(spark, docs):
    none = docs.limit(0)
    assert importance_draw.draw(none, docs).count() == 0
    assert all(r["rank"] is None for r in importance_draw.draw(docs, none.select("text"), least_words=10**6).collect())


def test_rows_of_one_id_queue_alone(spark):
    """300 rows of 20 words that share a doc_id, or have none: their source still comes within a document of its target."""
    for shared in (5, None):
        rows = [(i, "word " * 20, "a") for i in range(1000, 1300)] + [(shared, f"w{i} " * 20, "b") for i in range(300)] + [(i, "word " * 20, "c") for i in range(2000, 2200)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
        for r in fair_mix.plan(docs).groupBy("source", "target").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect():
            assert abs(r["taken"] - r["target"]) <= 40, r
        mixed = Counter(r["source"] for r in fair_mix.mix(docs).collect())
        assert abs(20 * mixed["b"] - 20 * sum(r["copies"] for r in fair_mix.plan(docs).where("source = 'b'").collect())) <= 40


@pytest.mark.parametrize("sizes", [[1e20], [1e-30], [1e20, 1.0, 1e-30], [3e38, 1e-38]])
def test_search_of_any_finite_size(spark, sizes):
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((120, 8)) / 4 * np.array(sizes)[rng.integers(0, len(sizes), 120)][:, None]).astype(np.float32).astype(float)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    index = vector_search.fit(vectors)
    got = defaultdict(list)
    for r in vector_search.search(vectors, every=10, k=5, index=index | {"probes": len(index["centres"])}).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    for q in range(0, 120, 10):
        score = (x[q] * x).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(120), -score)) if i != q][:5]
        assert [v for v, _ in got[q]] == want and [s for _, s in got[q]] == pytest.approx([score[v] for v in want])


def test_ranks_give_the_ids_of_the_library():
    from siltstone.llm.token_store import encoder

    rng, own, library_ = random.Random(8), encoder(PATH), Tokenizer.from_file(PATH)
    assert own.ranked
    letters = [chr(c) for c in range(0x250)] + [" "] * 60 + ["'s", "'ll", "\n", "\r\n", "<|endoftext|>", "İ", "日", "é"] + list("the quick brown") * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + ["a" * 5000, " " * 5000, "é" * 5000, "", " ", "x" * 999 + " y"]
    for text in texts:
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library_.encode(text, add_special_tokens=False).ids, text
    assert own.encode(None) == b""
