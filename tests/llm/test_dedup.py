"""Line dedup, SimHash near-dedup, fingerprints and embeddings against brute force."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash

from spindrift.llm import embedding_dedup as emb
from spindrift.llm import fingerprints as fing
from spindrift.llm import simhash_dedup as sim
from spindrift.llm.components import connected_components
from spindrift.llm.line_dedup import line_dedup

DOCS = "doc_id bigint, text string, extra string, n_lines string"


def brute_lines(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= min_chars:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if i is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == i]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup(spark):
    rng = random.Random(1)
    shared = [f"Ünïcode Shared Line Number {i} That Is Long Enough To Count" for i in range(4)] + ["short line"]
    rows = []
    for i in range(60):
        own = [f"line {rng.random()} of document {i} that no other document has at all" for _ in range(rng.randint(0, 4))]
        own += [rng.choice(["", "  ", "\t"]) + rng.choice([str.upper, str])(s).replace("Ü", "Ü") + rng.choice(["", " \x0b"]) for s in rng.choices(shared, k=rng.randint(0, 5))]
        rng.shuffle(own)
        rows.append((i, "\n".join(own)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (None, "\n".join(shared)), (7, rows[7][1]), (103, "x" * 200_000 + "\n" + shared[0])]
    df = spark.createDataFrame([(i, t, "e", "clash") for i, t in rows], DOCS)
    got = line_dedup(df)
    assert got.columns == ["doc_id", "text", "extra", "n_lines", "n_dropped"]
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()), key=str) == brute_lines(rows)
    assert line_dedup(df.limit(0)).count() == 0


def brute_fp(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(grams))


def components(n, links):
    lab = list(range(n))

    def root(x):
        while lab[x] != x:
            x = lab[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        lab[b] = a
    return [root(i) for i in range(n)]


def test_simhash_dedup(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(40):
        base = rng.choices(vocab, k=rng.randint(1, 120))
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 3)):
            w = list(base)
            w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(" \t".join(w).upper())
    rows += [None, "", " \n ", "one", "One", "two words", "É é É é"]
    data = [(i * 3, t, "x", "y") for i, t in enumerate(rows)] + [(0, rows[0], "x", "y")]
    got = {(r.doc_id): r for r in sim.simhash_dedup(spark.createDataFrame(data, "doc_id bigint, text string, fp string, component_id string")).collect()}
    fps = [brute_fp(t) for t in rows]
    assert [got[i * 3].fp % (1 << 64) for i in range(len(rows))] == fps
    lab = components(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if bin(fps[a] ^ fps[b]).count("1") <= 3])
    assert [got[i * 3].component_id for i in range(len(rows))] == [3 * x for x in lab]
    assert sim.simhash_dedup(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    none = [(None, "some words of one text"), (None, "some words of one text"), (None, "quite another text here"), (5, "quite another text here"), (5, "and a third, not like these")]
    told = sim.simhash_dedup(spark.createDataFrame(none, "doc_id bigint, text string")).collect()
    assert sorted((r.component_id or 0) for r in told) == [0, 0, 5, 5, 5] and len({r.group for r in told}) == 3


@pytest.mark.parametrize("n", [50, 700])
def test_links_of_dense_buckets(n):
    """Fingerprints around one centre: what the buckets link must join what direct links join."""
    rng = np.random.default_rng(n)
    fp = np.unique(np.bitwise_xor.reduce(np.where(rng.random((n, 64)) < 0.05, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0)), axis=1))
    rows = []
    for k in range(4):
        hidden = 0xFFFF << (16 * k)
        for f in fp.tolist():
            rows += [(k, f & ~hidden & (2**64 - 1) ^ b, f) for b in [0, *(1 << i for i in range(64) if not hidden >> i & 1)]]
    rows.sort()
    m, key, f = (np.array(c, dtype=t) for c, t in zip(zip(*rows, strict=True), (np.uint8, np.uint64, np.uint64), strict=True))
    at = {x: i for i, x in enumerate(fp.tolist())}
    got = components(len(fp), [(at[a], at[b]) for a, b in sim._links(m, key, f).tolist()])
    d = np.bitwise_count(fp[:, None] ^ fp[None, :])
    want = components(len(fp), [(a, b) for a, b in np.argwhere(d <= 3).tolist() if a < b])
    assert got == want


def test_large_bucket_rule():
    """The rule for buckets over the size that is compared in full joins no less and no more, with the other masks."""
    rng = np.random.default_rng(5)
    fp = np.unique(rng.integers(0, 1 << 10, 600).astype(np.uint64))
    flips = np.unique(np.concatenate([fp, fp ^ np.uint64(1 << 40), fp ^ np.uint64(1 << 50)]))
    assert len(flips) > sim.SMALL
    lab = sim._in_bucket(0, 0, flips)
    d = np.bitwise_count(flips[:, None] ^ flips[None, :])
    want = components(len(flips), [(a, b) for a, b in np.argwhere(d <= 3).tolist() if a < b])
    assert [int(x) for x in lab] == want


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    lab = components(400, real)
    assert got == {x: lab[x] for x in {y for e in real for y in e}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def brute_simhash(text):
    """128 bits by plain counting: distinct terms of three words, weighted by length, vote with two hashes."""
    words = [w for w in re.split("[ \t-\r]+", text) if w]

    def term(w):
        h = 42
        for g in w:
            h = xxhash.xxh64_intdigest(g.encode(), h)
        return h & ~7 | min(7, sum(len(g.encode()) for g in w) // 4)

    terms = {term(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()
    out = ""
    for seed in (1, 2):
        votes = [0] * 64
        for t in terms:
            h = xxhash.xxh64_intdigest(t.to_bytes(8, "little"), xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42))
            for b in range(64):
                votes[b] += (h >> b & 1) * ((t & 7) + 1)
        out += f"{sum(1 << b for b in range(64) if 2 * votes[b] > sum((t & 7) + 1 for t in terms)):016x}"
    return out


def brute_documents(rows):
    """``id: [(n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), ...]``."""
    key = lambda r: (-(2**63) if r[0] is None else r[0], (lambda x: x - 2**64 if x >> 63 else x)(xxhash.xxh64_intdigest(r[1].encode(), 42)))
    order, out = sorted({(i, t or "") for i, t in rows}, key=key), {}
    like = lambda a, b: max(0.0, math.cos(bin(int(a, 16) ^ int(b, 16)).count("1") * math.pi / 128))
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1], strict=True):
        k = len(t) // 4
        edited = t[: len(t) - k] + nxt[:k]
        f, e, n = map(brute_simhash, (t, edited, nxt))
        out.setdefault(i, []).append((len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, pytest.approx(like(f, e)), pytest.approx(like(f, n))))
    return out


def told(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    return out


@pytest.mark.parametrize("per_range", [2_000, 7])
def test_document_fingerprints(spark, monkeypatch, per_range):
    monkeypatch.setattr(fing.with_next, "__defaults__", (per_range,))
    rng = random.Random(4)
    rows = [(i * 7 % 101, " ".join(f"w{rng.randint(0, 500)}" for _ in range(rng.randint(30, 400)))) for i in range(60)] + [(500, None), (501, ""), (502, "ab"), (503, "é" * 9), (504, "a b " * 30_000)]
    rows += [(1, "a b c"), (1, "a b c"), (1, "another text of one id"), *((None, f"no id {k}") for k in range(20)), (None, "no id 3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, fingerprint string")
    got, want = told(fing.document_fingerprints(df).collect()), brute_documents(rows)
    assert got.keys() == want.keys()
    for i in want:
        by = lambda x: x[:4]
        assert sorted(got[i], key=by) == sorted(want[i], key=by)
    assert got[500][0][2] == got[501][0][2] == "0" * 32
    one = fing.document_fingerprints(spark.createDataFrame([(1, "only one here")], "doc_id bigint, text string")).first()
    assert one.near_next == 1.0 and fing.document_fingerprints(df.limit(0)).count() == 0


def test_near_fingerprints(spark):
    rng = random.Random(6)
    base = [[rng.getrandbits(63), rng.getrandbits(63)] for _ in range(30)]
    table = [list(b) for b in base]
    for b in base:
        for n in (1, 2, 3, 4, 5):
            c = list(b)
            for bit in rng.sample(range(126), n):
                c[bit // 63] ^= 1 << bit % 63
            table.append(c)
    q = spark.createDataFrame([(i, b) for i, b in enumerate(base)], "query bigint, fp array<bigint>")
    got = {(r["query"], tuple(r.fp)) for r in fing.near_fingerprints(q, spark.createDataFrame([(t,) for t in table], "fp array<bigint>")).collect()}
    far = lambda a, b: sum(bin(x ^ y).count("1") for x, y in zip(a, b, strict=True))
    assert got == {(i, tuple(t)) for i, b in enumerate(base) for t in table if far(b, t) <= 3}


def test_embedding_dedup(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 32))
    rows = [v for b in base for v in (b, *(b + 0.2 * rng.standard_normal(32) for _ in range(rng.integers(0, 4))), *([b * 2] if rng.random() < 0.3 else []), *([b] if rng.random() < 0.3 else []))]
    hot = base[0] + 0.05 * rng.standard_normal((1300, 32))
    e = np.concatenate([np.array(rows), hot])
    data = [(i, [float(x) for x in v], "l") for i, v in enumerate(e)]
    odd = [(9001, None, "l"), (9002, [0.0] * 32, "l"), (9003, [math.nan] * 32, "l"), (9004, [math.inf] * 32, "l"), (9005, [], "l"), (9006, [1.0, 1.0], "l"), (9007, [2.0, 2.0], "l"), (9008, [1.0, None], "l")]
    got = {r.vec_id: r for r in emb.embedding_dedup(spark.createDataFrame(data + odd, "vec_id bigint, embedding array<double>, n_links string")).collect()}
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    n = np.array([got[i].n_links for i in range(len(e))])
    assert (n <= near.sum(1)).all() and n.sum() >= 0.99 * near.sum()
    lab = components(len(e), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    assert [got[i].component_id for i in range(len(e))] == lab
    assert [(got[i].n_links, got[i].component_id) for i in (9001, 9002, 9003, 9004, 9005, 9008)] == [(0, i) for i in (9001, 9002, 9003, 9004, 9005, 9008)]
    assert got[9007].component_id == 9006 and got[9006].n_links == 1 and got[9006].kept and not got[9007].kept
    assert emb.embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).count() == 0
    none = spark.createDataFrame([(None, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.001]), (None, [0.0, 1.0]), (None, [0.0, 2.0]), (None, [-1.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in emb.embedding_dedup(none).collect()), key=str)
    assert got == sorted([(None, 2, 3, False), (None, 2, 3, False), (3, 2, 3, True), (None, 1, None, False), (None, 1, None, False), (None, 0, None, False)], key=str)


def test_recall_at_the_threshold(spark):
    """Pairs at a cosine just over the threshold, the hardest to find: nine in ten at least are asked for."""
    rng = np.random.default_rng(8)
    a = rng.standard_normal((400, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    x = rng.standard_normal((400, 64))
    x -= (x * a).sum(1, keepdims=True) * a
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    e = np.concatenate([a, 0.9505 * a + math.sqrt(1 - 0.9505**2) * x])
    got = emb.embedding_dedup(spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(e)], "vec_id bigint, embedding array<double>"))
    assert got.where("n_links = 1").count() >= 0.98 * len(e)


def _plans(spark, run) -> str:
    """The plans, as they were carried out, of all that ``run`` executes."""
    store = spark._jsparkSession.sharedState().statusStore()
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    last = max((store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())), default=-1)
    run()
    bus.waitUntilEmpty(30_000)
    runs = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    return "\n".join(r.physicalPlanDescription() for r in runs if r.executionId() > last)


def test_links_of_many_vectors_are_not_broadcast(spark, monkeypatch):
    """Broadcasts pass through the driver, and what Spark allows goes by compressed bytes."""
    from spindrift.llm import common as shared

    monkeypatch.setattr(shared, "BROADCAST_ROWS", 20, raising=False)
    rng = np.random.default_rng(5)
    a = rng.standard_normal((60, 16))
    e = np.concatenate([a, a + 0.01 * rng.standard_normal(a.shape)])
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(e)], "vec_id bigint, embedding array<double>")
    got = []
    plans = _plans(spark, lambda: got.extend(emb.embedding_dedup(df).collect()))
    assert "SortMergeJoin" in plans and "BroadcastExchange" not in plans
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted((i, 1, i % 60) for i in range(120))


def test_near_fingerprints_are_not_broadcast(spark, tmp_path):
    texts = [" ".join(f"w{(i // 2) * 31 + j}" for j in range(40)) for i in range(100)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = []
    plans = _plans(spark, lambda: got.extend(fing.op8_fingerprints(spark, str(tmp_path)).collect()))
    assert "SortMergeJoin" in plans and "BroadcastExchange" not in plans
    assert {r.doc_id: r.n_near for r in got if r.n_near is not None} == {0: 1, 50: 1}
