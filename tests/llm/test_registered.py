"""Every opN_ query as it is registered, over whole tables, against brute force: columns, types and rows."""

import collections
import hashlib
import math
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pytest
import xxhash
from test_dedup import brute_documents, brute_fp, components
from test_texts import brute_agenda, brute_nearness, water

from spindrift.llm import langid, pieces, queries, token_output

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").df().astype(object).to_dict("records")


@pytest.fixture(scope="module")
def run(spark):
    def one(name):
        df = queries.queries()[name](spark, SF)
        return dict(df.dtypes), df.collect()

    return one


def kinds(got, want):
    """The columns that the contract names come first and have its types."""
    assert list(got.items())[: len(want.split(", "))] == [tuple(c.split(" ", 1)) for c in want.split(", ")]


def test_every_query_is_here():
    here = {n for n in globals() if n.startswith("test_op")}
    assert {f"test_{n}" for n in queries.queries()} == here | {"test_op1_line_dedup"}  # held against SQL in test_pipeline


def test_op2_sentencepiece(run, docs):
    types, rows = run("op2_sentencepiece")
    assert types == {"doc_id": "bigint", "ids": "array<int>", "n_tokens": "bigint", "decoded_sha256": "string"}
    text, p = {d["doc_id"]: d["text"] or "" for d in docs}, pieces.load(pieces.MODEL)
    assert sorted(r.doc_id for r in rows) == sorted(text)
    mix = lambda x: int(pieces._mixed(np.array([x], dtype=np.uint64))[0])
    for r in rows:
        t = text[r.doc_id]
        assert r.n_tokens == len(r.ids) and p.decode(r.ids) == t and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        if len(t) < 400 and "\n" not in t and "  " not in t and t[:1] != " " and t:
            start = xxhash.xxh64_intdigest(f"2,{r.doc_id},0")
            want = [x for i, w in enumerate(t.split(" "), 1) for x in brute_agenda(p, pieces.SPACE + w, mix((start + i * 0x9E3779B97F4A7C15) % 2**64), 0.1)]
            assert r.ids == want


def test_op3_embedding_dedup(run):
    types, rows = run("op3_embedding_dedup")
    kinds(types, "vec_id bigint, n_links bigint, component_id bigint, kept boolean")
    e = duckdb.sql(f"SELECT vec_id, embedding FROM '{SF}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, v = [i for i, _ in e], np.array([x for _, x in e], dtype=np.float64)
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    lab = components(len(ids), [(a, b) for a, b in np.argwhere(near).tolist() if a < b])
    assert sorted(map(tuple, rows)) == [(i, int(near[k].sum()), ids[lab[k]], lab[k] == k) for k, i in enumerate(ids)]


def test_op4_token_shards(run, docs):
    types, rows = run("op4_token_shards")
    assert types == {"shard": "bigint", "first_slot": "bigint", "n_sequences": "bigint", "stride": "bigint", "n_tokens": "bigint", "sha256": "string", "payload": "binary"}
    rows = sorted(rows)
    assert all(hashlib.sha256(r.payload).hexdigest() == r.sha256 and len(r.payload) == r.n_sequences * r.stride and r.first_slot == r.shard * 2048 for r in rows)
    slots = np.frombuffer(b"".join(r.payload for r in rows), dtype="<u2").reshape(-1, 1024)
    order = slots[token_output.feistel(np.arange(len(slots)), len(slots), 4)].ravel()
    lib, out, cur = pieces.load(pieces.MODEL).library, [], []
    for x in order.tolist():
        if x == token_output.END:
            out.append(tuple(cur))
            cur = []
        elif x != token_output.PAD:
            cur.append(x)
    assert sorted(out) == sorted(tuple(lib.encode(d["text"] or "")) for d in docs)
    assert sum(r.n_tokens for r in rows) == sum(len(x) + 1 for x in out)


class Article(HTMLParser):
    """The blocks of the article element, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside = self.inside or tag == "article"
        if tag in ("p", "h1", "li", "ul"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside = self.inside and tag != "article"
        if tag in ("p", "h1", "li", "ul"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_op5_html_extract(run):
    types, rows = run("op5_html_extract")
    kinds(types, "page_id bigint, url string, text string, n_chars bigint")
    got = {r.page_id: r for r in rows}
    pages = duckdb.sql(f"SELECT page_id, url, html FROM '{SF}/pages.parquet'").fetchall()
    assert len(rows) == len(pages)
    for i, url, html in pages:
        a = Article()
        a.feed(html)
        want = "\n".join(t for t in (" ".join(b.split()) for b in a.blocks) if t)
        assert (got[i].url, got[i].text, got[i].n_chars) == (url, want, len(want))


def test_op6_language_id(run, docs):
    types, rows = run("op6_language_id")
    kinds(types, "doc_id bigint, held_out boolean, lang_pred string, score double")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    seen = collections.defaultdict(collections.Counter)
    for d in docs:
        if not held(d["doc_id"]) and d["text"] is not None and d["lang"] is not None:
            for g, n in zip(*(x.tolist() for x in langid.ngrams(d["text"])), strict=True):
                seen[d["lang"]][g] += n
    profiles = {k: np.array([g for g, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:400]]) for k, c in seen.items()}
    text = {d["doc_id"]: d["text"] for d in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        assert r.held_out == held(r.doc_id)
        near = brute_nearness(text[r.doc_id], profiles, 400)
        assert r.score == pytest.approx(max(near.values())) == pytest.approx(near[r.lang_pred])


def test_op7_lm_scores(run, docs):
    types, rows = run("op7_lm_scores")
    kinds(types, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    count = collections.Counter(w for d in docs if not held(d["doc_id"]) for w in tokens(d["text"]))
    n, text = sum(count.values()), {d["doc_id"]: d["text"] for d in docs}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    for r in rows:
        w = tokens(text[r.doc_id])
        base = sum(math.log10((count[x] + 1) / (n + len(count) + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(w), sum(x in count for x in w), n)
        assert r.base_score == pytest.approx(base) and -8 * math.log10(2) * 2 * (len((text[r.doc_id] or "").encode()) + 1) < r.score < 0


def test_op8_fingerprints(run, docs):
    types, rows = run("op8_fingerprints")
    kinds(types, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    want = brute_documents([(d["doc_id"], d["text"]) for d in docs])
    assert sorted(r.doc_id for r in rows) == sorted(want)
    for r in rows:
        assert want[r.doc_id] == [(r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)]
    fp = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    for r in rows:
        assert r.n_near == (sum((fp[r.doc_id] ^ x).bit_count() <= 3 for x in fp.values()) - 1 if r.doc_id % 50 == 0 else None)


def test_op9_mix_sources(run, docs):
    types, rows = run("op9_mix_sources")
    kinds(types, "doc_id bigint, size bigint, source_size bigint, target double, taken bigint")
    told = duckdb.sql(f"""SELECT doc_id, size, sum(size) OVER (PARTITION BY source) AS source_size FROM
        (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{SF}/documents.parquet')""").fetchall()
    want = {i: (s, int(t)) for i, s, t in told}
    source, sizes, taken = {d["doc_id"]: d["source"] for d in docs}, collections.Counter(), collections.Counter()
    assert {r.doc_id: (r["size"], r.source_size) for r in rows} == want and len(rows) == len(docs)
    for r in rows:
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        assert 0 <= r.taken <= 2 * r["size"]
    target = water(sizes)
    for r in rows:
        assert r.target == pytest.approx(target[source[r.doc_id]])
    assert all(abs(taken[s] - target[s]) <= 128 for s in sizes)


def test_op10_simhash_dedup(run, docs):
    types, rows = run("op10_simhash_dedup")
    kinds(types, "doc_id bigint, fingerprint string, component_id bigint")
    fps = [brute_fp(d["text"]) for d in docs]
    lab = components(len(docs), [(a, b) for a in range(len(docs)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3])
    assert sorted(map(tuple, rows)) == [(d["doc_id"], f"{fps[k]:016x}", docs[lab[k]]["doc_id"]) for k, d in enumerate(docs)]
