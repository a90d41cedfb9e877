"""The training-data operators on small tables with nulls, empties, ties, repeats and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from siltstone.llm import bpe_automaton, exact_dedup, fair_mix, hilbert_shards, near_dedup, quality, queries, token_store, toxicity, url_graph, vector_search
from tests.compare import compare, connect

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, label int, rank int, shard int"
LONG = " ".join(f"word{i % 997}" for i in range(20_000))
ROWS = [
    (1, "Equal text", "en", "a"), (2, "equal TEXT", "en", "a"), (2, "equal TEXT", "en", "a"), (3, "École", "fr", None), (4, "école", "fr", "b"),
    (5, None, None, None), (6, "", "en", "b"), (None, "no id", "en", "a"), (None, None, None, "c"), (7, LONG, "en", "b"), (8, "  spaces\n\ttabs  ", "en", "c"),
    (9, "<|endoftext|> a<|startoftext|>b", "en", "c"), (10, "日本語 İstanbul ΣΑΣ naïve café", "x", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, 1, "k", 2, 3, 4) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 1), (None, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, name):
    assert compare(spark, connect(DIR), queries.QUERIES[name], queries.ORACLES[name], DIR) == ""


def test_mix(docs, none):
    rows = fair_mix.plan(docs).collect()
    assert len(rows) == len(ROWS) and fair_mix.plan(none).count() == 0
    assert all(0 <= r["copies"] <= 2 for r in rows)
    again = {(r["doc_id"], r["source"]): r["copies"] for r in fair_mix.plan(docs).collect()}
    assert again == {(r["doc_id"], r["source"]): r["copies"] for r in rows}
    taken = Counter()
    for r in rows:
        if r["size"]:
            taken[r["doc_id"]] += r["copies"]
    mixed = fair_mix.mix(docs)
    assert mixed.columns == docs.columns
    assert Counter(r["doc_id"] for r in mixed.collect()) == +taken


def test_mix_targets(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 10), (None, 50)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in fair_mix.targets(sizes).collect()}
    # 1740 to share by 3, 1, 2, 3: a, c and the null source stop at 200, 20 and 100; the rest goes to b
    assert got == {"a": 200.0, "b": 1420.0, "c": 20.0, None: 100.0}


def test_mix_nears_its_targets(spark):
    rows = queries.op1_fair_mix(spark, "/root/testdata/sf0.01").groupBy().agg(F.sum("taken").alias("t"), F.sum("size").alias("s")).first()
    assert abs(rows["t"] / rows["s"] - 1.5) < 0.02


def test_exact(docs, none):
    got = exact_dedup.classes(docs).collect()
    assert len(got) == len(ROWS) and exact_dedup.classes(none).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r["text_sha256"]].append(r)
    equal = by[hashlib.sha256(b"equal text").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in equal} == {(2, 3)} and sum(r["kept"] for r in equal) == 1
    assert all(len(by[hashlib.sha256(x.encode()).hexdigest()]) == 1 for x in ("École", "école"))  # only A-Z are lower-cased
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert {(r["keep_id"], r["group_size"]) for r in empty} == {(6, 3)} and sum(r["kept"] for r in empty) == 1
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(by)


def test_exact_without_broadcast(docs, monkeypatch):
    from siltstone.llm import common

    want = sorted(map(str, exact_dedup.classes(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_ROWS", -1)
    assert sorted(map(str, exact_dedup.classes(docs).collect())) == want


def test_hilbert_curve():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        places = hilbert_shards.places(dims, bits)
        assert sorted(places) == list(range(1 << dims * bits))
        cells = sorted(range(len(places)), key=places.__getitem__)
        low = (1 << bits) - 1
        points = [[c >> bits * (dims - 1 - d) & low for d in range(dims)] for c in cells]
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(points, points[1:]))


def test_shards(spark, docs, none):
    assert hilbert_shards.shards(none).count() == 0
    for table in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = hilbert_shards.shards(table).collect()
        texts = sorted((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table.collect())
        assert sorted((r["size"], r["text_crc32"]) for r in rows) == texts
        counts = Counter(r["shard"] for r in rows)
        assert set(counts) <= set(range(16)) and max(counts[k] for k in range(16)) - min(counts[k] for k in range(16)) <= 1
        for k in counts:
            mine = sorted((r for r in rows if r["shard"] == k), key=lambda r: r["slot"])
            assert [r["slot"] for r in mine] == list(range(len(mine)))
        order = [r["curve"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
        assert order == sorted(order)


def test_bpe(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    assert bpe_automaton.digests(none, path).count() == 0
    want = Counter()
    for doc_id, text, *_ in ROWS:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in bpe_automaton.digests(docs, path).collect()) == want
    back = bpe_automaton.decode(bpe_automaton.encode(docs.where("doc_id = 10"), path), path).first()["text"]
    assert back == library.decode(library.encode(ROWS[-1][1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_fuzz():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library, pick = bpe_automaton.Codec(path), Tokenizer.from_file(path), random.Random(3)
    for i in range(4000):
        letters = "aehtnd" if i % 2 else "abc'tsİΣß日 \n\x1c.,!1é́<|endoftext|>"
        text = "".join(pick.choice(letters) for _ in range(pick.randint(0, 40)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_automaton_by_merging():
    """Against plain merging, and against gadgets applied to explicit sets of arcs."""
    pick = random.Random(5)
    for _ in range(30):
        labels, merges = list("abc"), []
        while len(merges) < 12:
            a, b = pick.randrange(len(labels)), pick.randrange(len(labels))
            if labels[a] + labels[b] not in labels:
                merges.append((a, b, len(labels)))
                labels.append(labels[a] + labels[b])
        own = bpe_automaton.Automaton(labels, merges)
        arcs = {(u, v) for u in range(3) for v in range(3)}
        alive = set(range(3))
        for a, b, ab in merges:
            if (a, b) not in arcs:
                continue
            alive.add(ab)
            arcs |= {(ab, v) for u, v in arcs if u == b}
            arcs.discard((a, b))
            arcs |= {(u, ab) for u, v in arcs if v == a}
        assert all(own.arc(u, v) == ((u, v) in arcs) for u in alive for v in alive)
        for _ in range(50):
            word = "".join(pick.choice("abc") for _ in range(pick.randint(1, 14)))
            ids = [labels.index(c) for c in word]
            for a, b, ab in merges:
                i, out = 0, []
                while i < len(ids):
                    hit = ids[i : i + 2] == [a, b]
                    out.append(ab if hit else ids[i])
                    i += 1 + hit
                ids = out
            assert own.encode(word) == ids


def test_token_store(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    assert token_store.digests(none, path).count() == 0
    rows = sorted(token_store.digests(docs, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: -1 if i is None else i)
    at, want = 0, Counter()
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
    for doc_id, text, *_ in ROWS:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    store = token_store.write(docs, path)
    found = token_store.lookup(store, spark.createDataFrame([(3,), (123456,)], "doc_id long"))
    got = token_store.read(store, found).collect()
    assert [(r["doc_id"], list(r["ids"])) for r in got] == [(3, library.encode("École").ids + [0])]


def test_store_over_many_buckets(spark, monkeypatch):
    """More keys than a bucket holds, and tasks that hold several buckets."""
    monkeypatch.setattr(token_store, "KEYS_A_BUCKET", 50)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.col("id").cast("string")).alias("text"))
    rows = token_store.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert rows.agg(F.count_distinct("doc_id")).first()[0] == 3000 == rows.count()


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000).astype(np.uint64))
    slots = token_store.PerfectHash(token_store.perfect_hash(keys)).slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys)))


@pytest.mark.parametrize("module", (toxicity, quality))
def test_classifiers_on_odd_rows(module, docs, labels, none):
    for known in (labels, labels.limit(0)):
        rows = module.judge(docs, known).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert module.judge(none, labels).count() == 0
    out = {r["doc_id"]: r["held_out"] for r in rows}
    assert all(out[i] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out if i is not None)
    assert toxicity.clean(docs, labels).columns == docs.columns


@pytest.mark.parametrize(("query", "label", "least"), ((queries.op5_toxicity, "toxic", 0.96), (queries.op9_quality, "quality", 0.98)))
def test_held_out_accuracy(spark, query, label, least):
    folder = "/root/testdata/sf0.1"
    known = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", label)
    rows = query(spark, folder).join(known, "doc_id").where("held_out")
    assert rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("double"))).first()[0] >= least


def test_vector_search(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = vector_search.search(vectors).cache()
    assert vector_search.recall(vectors, found) >= 0.9
    ranks = defaultdict(list)
    for r in found.collect():
        ranks[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert len(ranks) == 25 and all(len(x) == 20 and [y[1:] for y in sorted(x)] == sorted(y[1:] for y in x) for x in ranks.values())


def test_vector_search_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in vector_search.search(vectors).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.5), (0, 4, 8, -1.0), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 2, 0.5), (20, 4, 8, -0.5)]
    assert vector_search.search(vectors.limit(0)).count() == 0


def test_vector_search_repeated_ids_and_other_columns(spark):
    rows = [(0, [1.0, 0.0], 1, 2), (0, [1.0, 0.0], 1, 2), (1, [0.5, 0.1], 1, 2), (2, [0.2, 0.0], 1, 2)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, row int, list int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in vector_search.search(vectors).collect())
    one = [(0, 1, 0, 1.0), (0, 2, 1, 0.5), (0, 3, 2, 0.2)]
    assert got == sorted(one * 2)


def classes_by_force(table) -> dict:
    idf = near_dedup.read(table)[1]
    rows = [{"doc_id": r["doc_id"], "w": near_dedup.words(r["text"])} for r in table.collect()]
    sets = []
    for r in rows:
        h, n = near_dedup.shingles(r["w"])
        sets.append((h, near_dedup.weigh(h, n, idf)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i]["w"] == rows[j]["w"] or near_dedup.similarity(sets[i], sets[j]) >= near_dedup.AT_LEAST:
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, r in enumerate(rows):
        ids[find(i)].append(r["doc_id"])
    return Counter((r["doc_id"], min((x for x in ids[find(i)] if x is not None), default=None), len(ids[find(i)])) for i, r in enumerate(rows))


def test_near(spark, docs, none):
    base = [f"w{i}" for i in range(120)]
    copies = [(100 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :]), "en", "a") for k in range(0, 60, 6)]
    chain = [(200 + k, " ".join(f"c{i}" for i in range(k * 8, k * 8 + 110)), "en", "a") for k in range(6)]
    table = docs.unionByName(spark.createDataFrame([(*r, 0, 1, "k", 2, 3, 4) for r in copies + chain], SCHEMA))
    got = near_dedup.classes(table).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == classes_by_force(table)
    assert Counter(r["class_id"] for r in got if r["kept"]) == Counter({r["class_id"]: 1 for r in got if r["class_id"] is not None} | {None: sum(r["kept"] for r in got if r["class_id"] is None)})
    kept = near_dedup.keep_one(table)
    assert kept.columns == table.columns and kept.count() == sum(r["kept"] for r in got)
    assert near_dedup.classes(none).count() == 0


def test_word_hashes():
    for text in ("", "a", "Naïve café_1 İstanbul, ΣΑΣ\n日本 x-y", "x" * 200_000 + " " + " ".join(f"w{i % 997}é" for i in range(50_000)), LONG):
        found = near_dedup.words(text)
        assert near_dedup.word_hashes(text).tolist() == [int(near_dedup.word_hashes(w)[0]) for w in found]
        assert len({int(near_dedup.word_hashes(w)[0]) for w in set(found)}) == len(set(found))


@pytest.mark.parametrize("sf_dir", (DIR, "/root/testdata/sf0.01"))
def test_near_by_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = near_dedup.classes(table).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == classes_by_force(table)


def near_rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_near_in_a_bucket_that_a_passage_fills(spark):
    passage = [f"p{i}" for i in range(150)]
    texts = []
    for i in range(500):
        own = [f"x{i}-{k}" for k in range(10)]
        texts.append(" ".join(passage + own))
        if i % 5 == 4:
            texts.append(" ".join(passage + own[:4] + [f"y{i}"] + own[5:]))
    random.Random(3).shuffle(texts)
    table = near_rows(spark, texts)
    got = near_dedup.classes(table).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == classes_by_force(table)


def test_near_components_that_one_pair_joins(spark):
    texts, last = [], []
    for f in range(16):
        for start in (0, 8):
            base = [f"f{f}w{i}" for i in range(start, start + 110)]
            texts += [" ".join(base[: 30 + 6 * k] + [f"e{f}-{start}-{k}"] + base[31 + 6 * k :]) for k in range(8)]
            last.append(" ".join(base))
    table = near_rows(spark, texts + last)
    want = classes_by_force(table)
    assert {size for _, _, size in want} == {18}
    got = near_dedup.classes(table).collect()
    assert Counter((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == want


def test_samples_estimate_similarity():
    pick = np.random.default_rng(2)
    h = np.unique(pick.integers(0, 1 << 62, 400).astype(np.uint64))
    w = pick.uniform(0.5, 3, len(h))
    a, b = (h[:300], w[:300]), (h[60:], w[60:] * np.where(np.arange(len(h) - 60) % 3, 1, 1.5))
    x, y = near_dedup.samples(*a, 4000), near_dedup.samples(*b, 4000)
    assert abs((x == y).mean() - near_dedup.similarity(a, b)) < 0.03


def test_urls(spark):
    link = '<a href="https://{}/x">x</a>'
    rows = [
        (1, "http://www.Example.com/en/1", ""), (2, "https://a.example.com/en/2?q", ""), (3, "x://b.com#f", ""), (4, None, None), (5, "no scheme", None),
        (6, "https://s.net/es/1", ""), (7, "https://friend.org/a", link.format("s.net") * 3), (8, "https://good.org/a", None), (9, "https://t.com/", link.format("good.org")), (9, "https://t.com/", link.format("good.org")),
    ]
    got = {r["page_id"]: tuple(r)[1:5] for r in url_graph.judge(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[1] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/2", "example.com/en/", "block")
    assert got[3] == ("b.com", "", None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("net/es/", "block")
    assert got[7][2:] == (None, "block") and got[8][2:] == (None, "allow")
    assert url_graph.judge(spark.createDataFrame([], "page_id int, url string, html string")).count() == 0


def test_propagation_by_force(spark):
    pick = random.Random(7)
    edges = {(f"h{pick.randrange(12)}", f"h{pick.randrange(12)}"): pick.randint(1, 5) for _ in range(40)}
    edges = {k: n for k, n in edges.items() if k[0] != k[1]}
    seeds = [("h0", 1.0, 0.0), ("h1", 0.5, 0.5), ("h2", 0.0, 1.0)]
    found = url_graph.propagate(spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "src string, dst string, n int"), spark.createDataFrame(seeds, "host string, trust double, distrust double"))
    got = {r["host"]: tuple(r)[1:] for r in found.collect()}
    for kind in (0, 1):
        arcs = {(b, a) if kind else (a, b): n for (a, b), n in edges.items()}
        out = Counter()
        for (a, _), n in arcs.items():
            out[a] += n
        total = sum(s[1 + kind] for s in seeds)
        start = {s[0]: s[1 + kind] / total for s in seeds}
        now = dict(start)
        for _ in range(300):
            new = Counter()
            for (a, b), n in arcs.items():
                new[b] += now.get(a, 0) * n / out[a] * url_graph.DAMPING
            rest = 1 - sum(new.values())
            received = dict(new)
            for h, v in start.items():
                new[h] += rest * v
            now = new
        assert abs(sum(now.values()) - 1) < 1e-9
        assert all(abs(got[h][kind] - v) < 1e-6 for h, v in now.items() if v > 1e-9)
        assert all(abs(got[h][2 + kind] - v) < 1e-6 for h, v in received.items() if h not in start)


def test_flow_returns_from_hosts_without_links(spark):
    found = url_graph.propagate(spark.createDataFrame([("a", "b", 1)], "src string, dst string, n int"), spark.createDataFrame([("a", 1.0, 0.0)], "host string, trust double, distrust double"))
    got = {r["host"]: r["trust"] for r in found.collect()}
    assert abs(got["a"] + got["b"] - 1) < 1e-9 and abs(got["b"] / got["a"] - 0.85) < 1e-9
