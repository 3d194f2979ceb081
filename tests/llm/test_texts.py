"""Language ID, pieces, token output, scoring, mixing and HTML extraction."""

import collections
import hashlib
import math
import random
import re
import unicodedata
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spindrift.llm import ctw, html_extract, langid, mixing, pieces, token_output

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_id_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op6_language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").toPandas()
    assert (out.held_out == out.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = out[out.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_id_edges(spark, docs):
    profiles = langid.learn_profiles(docs)
    rows = [(1, None, "a"), (2, "", "b"), (3, " 12 !?\n", "c"), (4, "the and of that with " * 5000, "d"), (5, "الكتاب", "e")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in langid.identify(df, profiles).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].lang_pred == "en" and 0 <= got[5].score <= 1
    assert langid.identify(df, {}).where("lang_pred = 'und'").count() == 5
    assert langid.identify(df.limit(0), profiles).count() == 0
    none = spark.createDataFrame([(1, "x", None)], "doc_id bigint, text string, lang string")
    assert langid.learn_profiles(none) == {}
    many = spark.createDataFrame([(i, f"word{i % 7} of it", f"l{i % 5}" if i < 90 else f"m{i}") for i in range(100)], "doc_id bigint, text string, lang string")
    assert set(langid.learn_profiles(many, labels=4)) == {"l0", "l1", "l2", "l3"}


def brute_nearness(text, profiles, size):
    """Out-of-place distance with dicts: n-grams of a word with a space at each end, ranked, equals at their mean rank."""
    low = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    grams = collections.Counter()
    for w in low.split(" "):
        if w:
            padded = f" {w} "
            for n in (1, 2, 3):
                grams.update(g for g in (padded[i : i + n] for i in range(len(padded) - n + 1)) if g != " ")
    code = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    order = sorted(grams.items(), key=lambda x: (-x[1], code(x[0])))[:size]
    places = collections.defaultdict(list)
    for i, (_, n) in enumerate(order):
        places[n].append(i)
    out = {}
    for lang, known in profiles.items():
        rank = {g: i for i, g in enumerate(known.tolist())}
        far = sum(abs(sum(places[n]) / len(places[n]) - rank[code(g)]) if code(g) in rank else size for g, n in order)
        out[lang] = 1 - far / (size * len(order))
    return out


def test_language_id_equals_brute_force(spark, docs):
    profiles = langid.learn_profiles(docs)
    some = [r.text for r in docs.limit(40).collect()] + ["É", "a-b c'd", "ß ﬁ x"]
    df = spark.createDataFrame(list(enumerate(some)), "doc_id bigint, text string")
    for r in langid.identify(df, profiles).collect():
        if any(unicodedata.category(c)[0] == "L" for c in r.text):
            want = brute_nearness(r.text, profiles, 400)
            assert r.score == pytest.approx(max(want.values())) and want[r.lang_pred] == pytest.approx(r.score)


def test_out_of_place_by_hand():
    grams, counts = langid.ngrams("Aa b")
    assert dict(zip(grams.tolist(), counts.tolist(), strict=True))[ord("a")] == 2
    g, rank = langid.ranked(np.array([5, 7, 9]), np.array([1, 3, 1]), 10)
    assert g.tolist() == [7, 5, 9] and rank.tolist() == [0, 1.5, 1.5]


def test_pieces_equal_the_library():
    sp = pieces.load(pieces.MODEL).library
    enc = pieces.Encoder(pieces.MODEL)
    rng = random.Random(1)
    texts = ["", "a", " a", "a  b   c", "line\nline \n\n x", "ünï 日本語 \U0001f600", "x" * 900, "\t\r", "."] + ["".join(rng.choice("abe the ning\n.é") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    assert [x.tolist() for x in enc.encode_many(texts)] == [sp.encode(t) for t in texts]


def test_dropout_is_seeded_varied_and_lossless():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b", "tion", "the ", "\n", " ", "é", "▁", "日", "\0"]) for _ in range(rng.randint(0, 400))) for _ in range(100)]
    a, b, c = (pieces.Encoder(pieces.MODEL, 0.2, s).encode_many(texts, list(range(100))) for s in (1, 1, 2))
    p = pieces.load(pieces.MODEL)
    assert [x.tolist() for x in a] == [x.tolist() for x in b] != [x.tolist() for x in c]
    for got in (a, c):
        assert [p.decode(x.tolist()) for x in got] == texts
    whole = pieces.Encoder(pieces.MODEL, 1.0, 1).encode("word word")
    assert len(whole) >= len("word word")


def test_merging_side_by_side_equals_one_by_one():
    p, rng = pieces.load(pieces.MODEL), random.Random(3)
    words = [pieces.SPACE + "".join(rng.choice("etaoinshrdlé日") for _ in range(rng.randint(0, 90))) for _ in range(400)]
    for rate in (0.0, 0.3):
        masks = [sum(1 << i for i in range(64) if rng.random() < rate) for _ in words]
        one = []
        for w, m in zip(words, masks, strict=True):
            given = pieces.Given(m)
            one.append((p._merge(w, given), given.n))
        assert [(ids.tolist(), n) for n, ids in p.merge_masked(words, masks)] == one
        heap = [[p.ids.get(q, -1) for q in p._merge_heap(list(w), pieces.Given(m))] for w, m in zip(words[:50], masks, strict=False) if "日" not in w]
        assert heap == [ids for w, (ids, _) in zip(words[:50], one, strict=False) if "日" not in w]


def brute_agenda(p, word: str, key: int, rate: float) -> list[int]:
    """Merges of one word by a list of candidates that is searched anew each time; skips by gaps drawn from the key."""
    mix = lambda x: (lambda x: (lambda x: x ^ x >> 31)((x ^ x >> 27) * 0x94D049BB133111EB % 2**64))((x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64)

    def gap(k):
        u, j = (k >> 11) / 2**53, 0  # P(gap >= j) = (1 - rate)^j
        while u <= (1 - rate) ** (j + 1) and j < 400:
            j += 1
        return j

    parts, banned, seen, skip = list(word), set(), 0, gap(key)
    while True:
        found = [(p.rank[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in p.rank and (sum(map(len, parts[:i])), parts[i], parts[i + 1]) not in banned]
        if not found:
            break
        _, i = min(found)
        if seen == skip:
            banned.add((sum(map(len, parts[:i])), parts[i], parts[i + 1]))
            key = mix((key + 0x9E3779B97F4A7C15) % 2**64)
            skip = seen + 1 + gap(key)
        else:
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        seen += 1
    return [x for q in parts for x in ([p.ids[q]] if q in p.ids else [p.byte_id[b] for b in q.encode()])]


def test_dropout_equals_brute_force():
    """Every word's skips follow from document, pass and place; an agenda of its own gives the same pieces."""
    p, rng = pieces.load(pieces.MODEL), random.Random(9)
    words = ["information", "understanding", "the", "日本", "internationalisation", "é", "a", "x" * 70]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    mix = lambda x: int(pieces._mixed(np.array([x], dtype=np.uint64))[0])
    for rate in (0.1, 0.5):
        got = pieces.Encoder(pieces.MODEL, rate, 5).encode_many(texts, list(range(40)), [3] * 40)
        for doc, (text, ids) in enumerate(zip(texts, got, strict=True)):
            start, want = xxhash.xxh64_intdigest(f"5,{doc},3"), []
            for place, w in enumerate(text.split(" "), 1):
                want += brute_agenda(p, pieces.SPACE + w, mix((start + place * 0x9E3779B97F4A7C15) % 2**64), rate)
            assert ids.tolist() == want


def test_words_in_a_full_table():
    """Every word finds its number, and no other does, however crowded the table."""
    rng = random.Random(8)
    every = list(dict.fromkeys("".join(rng.choice("abcé") for _ in range(rng.randint(0, 15))) for _ in range(3000)))
    raw = [w.encode() for w in every]
    start, size = np.cumsum([0, *map(len, raw[:-1])]), np.array(list(map(len, raw)))
    table = pieces.Words(100)  # 256 slots, to begin with
    one, two = table.hashes(b"".join(raw) + b" " * pieces.SHORT, start, size)
    half = len(every) // 2
    table.add(one[:half], two[:half], np.arange(half))
    assert table.find(one, two).tolist() == [*range(half), *[-1] * (len(every) - half)]
    assert len(set(zip(one.tolist(), two.tolist(), strict=True))) == len(every)


def test_what_is_kept_changes_nothing(monkeypatch):
    """An encoder that forgets all the time gives the same."""
    rng = random.Random(10)
    texts = [" ".join("".join(rng.choice("abcdé\n") for _ in range(rng.randint(0, 40))) or "x" for _ in range(rng.randint(0, 80))) for _ in range(60)]
    for rate in (0.0, 0.3):
        whole = pieces.Encoder(pieces.MODEL, rate, 1).encode_many(texts, list(range(60)))
        monkeypatch.setattr(pieces, "CACHE", 50)
        short = pieces.Encoder(pieces.MODEL, rate, 1)
        assert [x.tolist() for i, t in enumerate(texts) for x in short.encode_many([t], [i])] == [x.tolist() for x in whole]
        monkeypatch.undo()
        if not rate:
            assert [x.tolist() for x in whole] == [pieces.load(pieces.MODEL).library.encode(t) for t in texts]


def test_decoding_many_equals_one():
    p = pieces.load(pieces.MODEL)
    texts = ["", "a b", "▁ x\n日 \0", " two  spaces ", ""]
    flat, ends = pieces.Encoder(pieces.MODEL, 0.3, 1).encode_flat(texts, [1, 2, 3, 4, 5])
    assert [bytes(x).decode() for x in p.decode_bytes(flat, ends)] == texts
    assert pieces.Encoder(pieces.MODEL).encode_many([]) == []


def test_piece_encode(spark, docs):
    out = pieces.piece_encode(docs)
    got = out.join(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h")), "doc_id")
    assert got.where("h <> decoded_sha256 OR n_tokens <> size(ids)").count() == 0 and got.count() == 200
    back = pieces.piece_decode(out).join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    assert back.where("t <> text").count() == 0
    odd = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "x y", 0), (None, "x y", 0)], "doc_id bigint, text string, ids int")
    assert sorted(len(r.ids) for r in pieces.piece_encode(odd).collect()) == [0, 0, 2, 2]
    assert pieces.piece_encode(odd.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(n):
    got = token_output.feistel(np.arange(n), n, 9)
    assert sorted(got.tolist()) == list(range(n))
    if n > 100:
        assert got.tolist() != token_output.feistel(np.arange(n), n, 10).tolist() and (got == np.arange(n)).mean() < 0.05


def test_shards_round_trip(spark, docs, tmp_path):
    uri = f"file://{tmp_path}/shards"
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(9000, None), (9001, "")], "doc_id bigint, text string"))
    told = token_output.write_shards(token_output.training_shards(extra, length=64, per_shard=100), uri).toPandas().sort_values("shard")
    assert (told.first_slot == told.shard * 100).all() and (told.n_sequences[:-1] == 100).all()
    n = int(told.n_sequences.sum())
    everything = token_output.read_slots(uri, 0, n + 5, 64, 100)
    assert everything.shape == (n, 64)
    assert (token_output.read_slots(uri, 95, 20, 64, 100) == everything[95:115]).all()
    again = token_output.training_shards(extra, length=64, per_shard=100).toPandas().sort_values("shard")
    assert again.sha256.tolist() == told.sha256.tolist()
    p, cur, out = pieces.load(pieces.MODEL), [], []
    for x in everything[token_output.feistel(np.arange(n), n, 4)].ravel().tolist():
        if x == token_output.END:
            out.append(p.decode(cur))
            cur = []
        elif x != token_output.PAD:
            cur.append(x)
    assert sorted(out) == sorted([r.text or "" for r in extra.collect()])
    assert token_output.training_shards(docs.limit(0)).count() == 0


def test_shards_do_not_depend_on_files(spark, docs, monkeypatch):
    monkeypatch.setattr(token_output, "BUCKET", 60)
    odd = spark.createDataFrame([(None, "no id"), (None, "no id"), (7, "twice"), (7, "twice"), (8, None)], "doc_id bigint, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    told = [[tuple(r) for r in token_output.training_shards(every.repartition(n), length=64, per_shard=50).select("shard", "n_sequences", "n_tokens", "sha256").orderBy("shard").collect()] for n in (1, 8)]
    assert told[0] == told[1] and len(told[0]) > 3
    made = token_output.token_sequences(every, length=64)
    assert made.where("n_tokens > 64 OR n_tokens < 1").count() == 0 and made.select("bucket").distinct().count() == 4


def brute_ctw(train: list[bytes], text: bytes, least: int = 2) -> float:
    """The code length of training text and bit, less that of the training text: by recursion over plain counts, no mixing.

    The children of a node are the contexts one byte longer that training has seen ``least`` times and at that node's
    bits; all others share one more child.
    """
    D, count, held = ctw.DEPTH, collections.Counter(), collections.Counter()
    for t in train:
        x = ctw.END * D + t + ctw.END
        for i in range(D, len(x)):
            for d in range(D + 1):
                held[x[i - d : i]] += 1
                for k in range(8):
                    count[x[i - d : i], k, x[i] >> (8 - k), x[i] >> (7 - k) & 1] += 1
    keep = {c for c, n in held.items() if len(c) < 2 or n >= least}
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    pair = lambda c, k, p: np.array([count[c, k, p, 0], count[c, k, p, 1]])
    kids = lambda c, k, p: [x for x in (bytes([y]) + c for y in range(256)) if len(c) < D and x in keep and sum(pair(x, k, p))]
    memo = {}

    def weighted(c, k, p, path=None, bit=0):
        """log weighted probability of a node's counts, with one more ``bit`` on the way of ``path``."""
        if path is None and (c, k, p) in memo:
            return memo[c, k, p]
        more = np.eye(2, dtype=int)[bit] * (path is not None)
        own, below = pair(c, k, p), kids(c, k, p)
        out = kt(*(own + more))
        if below:
            step = path[len(path) - len(c) - 1 :] if path is not None else None
            rest = own - sum(pair(x, k, p) for x in below) + more * (step not in below)
            split = sum(weighted(x, k, p, path if x == step else None, bit) for x in below) + kt(*rest)
            out = np.logaddexp(out, split) - math.log(2)
        if path is None:
            memo[c, k, p] = out
        return out

    total, x = 0.0, ctw.END * D + text + ctw.END
    for i in range(D, len(x)):
        for k in range(8):
            p, bit = x[i] >> (8 - k), x[i] >> (7 - k) & 1
            total += (weighted(b"", k, p, x[i - D : i], bit) - weighted(b"", k, p)) / math.log(10)
    return total


def test_scores_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ctw, "TASK_GRAMS", 100)  # several files
    rng = random.Random(4)
    train = ["".join(rng.choice("abé \n") for _ in range(rng.randint(0, 60))) for _ in range(12)]
    new = [*train[:3], "abba", "", "zzz ÿ", "ab" * 40]
    df = lambda ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in ctw.lm_scores(df([*new, None]), df(train)).collect()}
    for i, t in enumerate(new):
        assert got[i].score == pytest.approx(brute_ctw([x.encode() for x in train], t.encode()), rel=1e-5)
    assert got[len(new)].score == pytest.approx(got[4].score) and got[len(new)].n_tokens == 1
    every = {r.doc_id: r.score for r in ctw.lm_scores(df(new), df(train), least=1).collect()}
    for i, t in enumerate(new[:5]):
        assert every[i] == pytest.approx(brute_ctw([x.encode() for x in train], t.encode(), 1), rel=1e-5)
    assert [r.score for r in ctw.lm_scores(df(["ab"]), df([])).collect()] == [pytest.approx(24 * math.log10(0.5))]
    odd = spark.createDataFrame([(None, "ab"), (None, "ab"), (3, "ab")], "doc_id bigint, text string")
    assert len({(r.score, r.base_score) for r in ctw.lm_scores(odd, df(train)).collect()}) == 1 and ctw.lm_scores(odd.limit(0), df(train)).count() == 0
    words = collections.Counter(w for t in train for w in t.encode().lower().split())
    words[b"\n"] = len(train)
    n, v = sum(words.values()), len(words)
    for i, t in enumerate(new):
        tokens = [*t.encode().lower().split(), b"\n"]
        assert got[i].base_score == pytest.approx(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in words for w in tokens), n)


def brute_repeats(logs: list[float], words: list[bytes]) -> float:
    """log10 of the mean over weights, word by word, of what the trees give the words."""
    means = []
    more = lambda n, log: np.logaddexp(math.log(n) if n else -math.inf, log * math.log(10)) / math.log(10)
    for a, b in ctw.PAIRS:
        total, seen, pairs, prev = 0.0, collections.Counter(), collections.defaultdict(collections.Counter), b""
        for i, (w, log) in enumerate(zip(words, logs, strict=True)):
            q = log if a == math.inf else more(seen[w], math.log10(a) + log) - math.log10(i + a)
            total += q if b == math.inf else more(pairs[prev][w], math.log10(b) + q) - math.log10(pairs[prev].total() + b)
            seen[w] += 1
            pairs[prev][w] += 1
            prev = w
        means.append(total)
    return max(means) + math.log10(sum(10 ** (x - max(means)) for x in means) / len(means))


def test_scores_learn_from_repeats(spark, monkeypatch):
    rng = random.Random(6)
    train = [" ".join("".join(rng.choices("abcdef", k=rng.randint(1, 4))) for _ in range(30)) for _ in range(20)]
    new = [train[0], "", "xyz uvw " * 60, "zzz\tABC abc ab \n" * 5, "é" * 20, "x" * 500, "abcd " * 4, "one two " * 30 + "y" * 500 + " one two"]
    df = lambda ts: spark.createDataFrame([(i, t) for i, t in enumerate(ts)], "doc_id bigint, text string")
    plain, got = ({r.doc_id: r for r in ctw.lm_scores(df(new), df(train), repeats=x).collect()} for x in (False, True))
    assert got[2].score > got[2].base_score > plain[2].score  # new words, sixty times
    g, n = ctw.grams([x for some in ctw.pieces([t.encode() for t in train]) for x in some])
    codes, counts = np.unique(g, return_counts=True)
    parts, told = ctw.subtrees(codes, counts, ctw.LEAST)
    trees = ctw.Trees(ctw.crown([told]), [0], [parts])
    for i, t in enumerate(new):
        g, _ = ctw.grams([x for some in ctw.pieces([t.encode()]) for x in some])
        order = np.argsort(g)
        logs = np.empty(len(g))
        logs[order] = trees.log10(g[order])
        words = re.findall(rb"[^ \t-\r\xff]*[ \t-\r\xff]", t.encode() + ctw.END)
        ends = np.cumsum([len(w) for w in words])
        sums = [logs[e - len(w) : e].sum() for w, e in zip(words, ends, strict=True)]
        assert plain[i].score == pytest.approx(sum(sums)) and got[i].score >= plain[i].score - math.log10(len(ctw.PAIRS))
        assert got[i].score == pytest.approx(brute_repeats(sums, words))
    many = [t.encode() for t in ["abc " * 50, "ab", "abc def " * 40, "x" * 63]]  # cut between words, pieces over several lists
    model = ctw.Scorer.__new__(ctw.Scorer)
    model.log10 = lambda g: -2.0 - (g & np.uint64(3)).astype(float)
    want = model.scores(many, True)
    for chunk in (64, 32, 4):
        monkeypatch.setattr(ctw, "CHUNK", chunk)
        assert model.scores(many[:3], True) == pytest.approx(want[:3])


def test_what_was_never_seen_stays_possible():
    """However often the contrary was: no estimate or weight is rounded to one."""
    gram = lambda x: int.from_bytes(x, "big")
    code = np.sort(np.array([gram(b"dcba" + bytes([x, y])) for x in b"ef" for y in (0xFF,)] + [gram(b"zzzzzz")], dtype=np.uint64))
    parts, told = ctw.subtrees(code, np.full(len(code), 1 << 40), 2)
    trees = ctw.Trees(ctw.crown([told]), [0], [parts])
    every = np.array([gram(b"dcbae" + bytes([x])) for x in range(256)], dtype=np.uint64)
    logs = trees.log10(every)
    assert np.isfinite(logs).all() and (10**logs).sum() == pytest.approx(1)
    assert logs[0xFE] == pytest.approx(math.log10(0.5) - 40 * math.log10(2), abs=1)


def test_probabilities_sum_to_one(spark):
    """Over all bytes, after any context."""
    some = [(i, ctw.END * ctw.DEPTH, t.encode() + ctw.END) for i, t in enumerate(["abcabc", "abd", "xyz"])]
    g, _ = ctw.grams(some)
    codes, n = np.unique(g, return_counts=True)
    parts, told = ctw.subtrees(codes, n, 2)
    trees = ctw.Trees(ctw.crown([told]), [0], [parts])
    for before in (b"abcab", b"qqqqq", b"\xff\xff\xffab"):
        ctx = sum(b << (8 * (5 - i)) for i, b in enumerate(reversed(before)))
        every = np.array([ctx | b for b in range(256)], dtype=np.uint64)
        assert (10 ** trees.log10(every)).sum() == pytest.approx(1, abs=1e-5)


def test_files_of_arrays(tmp_path):
    arrays = {"a": np.arange(5, dtype=np.uint64), "b": np.array([], dtype=np.float32), "c": np.array([1.5, 2], dtype=np.float32)}
    raw = ctw.pack_arrays(arrays)
    assert ctw.put(raw, f"file://{tmp_path}/x/y") and not ctw.put(raw, "nowhere://x/y")
    for source in (f"file://{tmp_path}/x/y", raw):
        got = ctw.unpack_arrays(ctw.mapped(source))
        assert all((got[k] == v).all() and got[k].dtype == v.dtype for k, v in arrays.items())


def test_a_folder_that_workers_cannot_open(spark, docs, monkeypatch):
    some = docs.limit(20)
    want = sorted(r.score for r in ctw.lm_scores(some, docs).collect())
    monkeypatch.setattr(ctw, "scratch_path", lambda *_: "nowhere://x/y")
    assert sorted(r.score for r in ctw.lm_scores(some, docs).collect()) == pytest.approx(want)
    monkeypatch.setattr(ctw, "BROADCAST_BYTES", 10)
    with pytest.raises(ValueError, match="too large"):
        ctw.lm_scores(some, docs)


def test_long_texts_in_pieces():
    text = bytes(random.Random(5).choices(b"abc d", k=3 * ctw.CHUNK + 17))
    whole = [(0, ctw.END * ctw.DEPTH, text + ctw.END)]
    cut = [x for some in ctw.pieces([text]) for x in some]
    assert len(cut) == 4 and (np.concatenate([ctw.grams([x])[0] for x in cut]) == ctw.grams(whole)[0]).all()
    plain = [b"a b", b"", b" \t", b"\x0bUpper \xc3\x89 " + b"long" * 20, text]
    assert [x for rows, some in ctw.texts_by_word(plain) for r, t in zip(rows, some, strict=True) for x in [r] * len(t.split())] == [r for r, t in enumerate(plain) for _ in t.split()]
    want = {w: ctw.word_hashes([w])[0][0] for w in {w for t in plain for w in t.lower().split()}}
    got = [h for _, some in ctw.texts_by_word(plain) for h in ctw.word_hashes(some)[0].tolist()]
    assert got == [want[w] for t in plain for w in t.lower().split()] and len(set(got)) == len(want)


def water(sizes, weights=(3, 1, 2)):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, target, free = 1.5 * sum(sizes.values()), {}, set(names)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= 2 * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    return target


def test_mix(spark):
    rng = random.Random(6)
    source = lambda i: None if i % 23 == 0 else "big" if i % 3 else f"s{i % 11}é"
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 300, 2000]))), source(i), "p") for i in range(300)] + [(900, None, "empty", "p"), (901, "", "s1é", "p")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, pass string")
    mix = mixing.mix_sources(df)
    taken = {r["__id"]: r.taken for r in mixing.words_taken(mix).collect()}
    sizes = collections.Counter()
    for _, t, s, _ in rows:
        sizes[s] += len((t or "").split())
    want = water(sizes)
    got = {r.source: r for r in mix.sources.collect()}
    assert set(got) == set(want)
    for s, t in want.items():
        assert got[s].target == pytest.approx(t) and got[s].source_size == sizes[s]
        have = sum(taken.get(i, 0) for i, _, x, _ in rows if x == s)
        assert abs(have - t) <= 2 * 64, (s, have, t)
    assert all(taken.get(i, 0) <= 2 * len((t or "").split()) for i, t, _, _ in rows)
    again = {r["__id"]: r.taken for r in mixing.words_taken(mixing.mix_sources(df.repartition(7))).collect()}
    assert again == taken
    out = mixing.mixed_documents(df, mix)
    assert out.columns == df.columns
    words = collections.Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == taken
    blocks = mixing.mixed_blocks(df, mix).collect()
    assert sum(len(b.text.split()) for b in blocks) == sum(taken.values()) and sorted(b.slot for b in blocks) == list(range(len(blocks)))
    assert mixing.words_taken(mixing.mix_sources(df.limit(0))).count() == 0


def test_swap_or_not(spark):
    for n in (1, 2, 3, 50, 257):
        df = spark.range(n).select(F.col("id").alias("x"), F.lit(n).cast("bigint").alias("n"), F.lit(5).cast("bigint").alias("key"))
        assert sorted(r.x for r in mixing.swap_or_not(df, "x", "n", "key").collect()) == list(range(n))


PAGE = """<html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Popular {0}</p></div>{1}<div class="ad">Buy {0}</div>
<form><input value="x">Search</form><section class="comments"><p>Reader {0} says hi</p></section><footer>&copy; Site</footer><script>var a = "</p>";</script></body></html>"""


def test_html_extract(spark):
    body = lambda i: f"<h1>Title {i}</h1><p><b>First   &amp; {i}<br><p>Second&nbsp;line {i}<ul><li>one {i}<li>two</ul><p>Fish &lt; {i}"
    want = lambda i: f"Title {i}\nFirst & {i}\nSecond line {i}\none {i}\ntwo\nFish < {i}"
    named = [PAGE.format(i, f"<article>{body(i)}</article>") for i in range(12)]
    # a line that all pages share is template, inside an article, too
    assert html_extract.extract_group(named) == [want(i).replace("\ntwo", "") for i in range(12)]
    assert html_extract.extract_group(named[:3]) == [want(i) for i in range(3)]  # too few to tell
    for other in ("<div class='c'>{}</div>", "<div><div>{}</div></div>", "{}"):  # whatever the markup calls the article
        assert html_extract.extract_group([PAGE.format(i, other.format(body(i))) for i in range(12)]) == html_extract.extract_group(named)
    assert html_extract.extract_group([named[0]] * 5) == [want(0)] * 5 and html_extract.extract_group([None, ""]) == ["", ""]
    host = [f"<div class='top'><p>Our firm since 1901, all rights</p></div><div class='x'><p>Story {i} about {'abc ' * i}</p><p>More of {i}</p></div><div><p>Call us today, toll free</p></div>" for i in range(1, 9)]
    assert html_extract.extract_group(host) == [f"Story {i} about {'abc ' * i}".strip() + f"\nMore of {i}" for i in range(1, 9)]
    rows = [(i, f"https://h{i % 3}.org/{i}", h, "x") for i, h in enumerate(named)] + [(50, None, named[0], "x"), (51, "nohost", None, "x"), (52, "https://h0.org", "<p>" + "long " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r.page_id: r for r in html_extract.html_extract(df).collect()}
    # three hosts of four pages, one of which has a fifth, another layout
    assert [got[i].text for i in range(12)] == [want(i).replace("\ntwo", "") for i in range(12)] and got[50].text == want(0) and got[51].text == "" and got[52].n_chars == 999_999
    assert html_extract.html_extract(df.limit(0)).count() == 0


def test_tree_matching_counts_shared_nodes():
    a = html_extract.parse("<body><div><p>x</p><p>y</p></div><div><p>z</p></div></body>")
    b = html_extract.parse("<body><div><p>x</p><p>q</p><p>y</p></div></body>")
    # roots, bodies, one div, two p, two texts that are equal
    assert html_extract.match(a, b) == 3 + 2 + 2 * 2
    pairs = list(html_extract.aligned(a, b))
    assert [x.text for x, y in pairs if x.text is not None] == [y.text for x, y in pairs if x.text is not None]


def test_extraction_hash_is_stable(spark):
    out = html_extract.op5_html_extract(spark, SF)
    one = sorted((r.page_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.collect())
    assert one == sorted((r.page_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in out.repartition(3).collect()) and len(one) == 50
