"""LM scoring by context-tree weighting over bytes.

A text is its UTF-8 bytes and an end mark; before it come end marks. Each byte is eight binary decisions, the first bit
first, and each decision has a tree of its own over the bytes before: node (context of d bytes, bits so far) counts zeros
and ones and gives the Krichevsky-Trofimov estimate. A node's weighted probability is half its own estimate and half the
product of its children's, for every depth up to ``DEPTH``; so the weight of stopping at a node follows from the counts,
and a bit's probability mixes the estimates along the context's path, the deepest first. Training gathers the counts of
all (DEPTH + 1)-grams of all training texts; the trees are then fixed, so each text is scored by itself.

A context of two bytes or more is a node if it has been seen ``least`` times, however large the corpus, so the model grows
with its input; what rarer contexts have seen is one more child of those above them, with an estimate of its own. With
``least`` 1 every context seen is a node.

A text that repeats itself (its lines, its names, its made-up words) tells more about what follows than the training texts
do. With ``repeats`` the trees' probability of a word is the prior of two Dirichlet estimates over the text's own words so
far, of all words and on that of words after the one before. How much such a prior weighs against what has been counted is
not known beforehand: a text's probability is the mean over all weights of ``PAIRS``, infinity (the trees alone) among them.

Trees are built in tasks: what follows two nearest bytes is one subtree, ranges of such pairs are tasks, and each writes
its nodes as a file of sorted arrays. The driver gets the nodes of depth two, 65,536 contexts at most, for the two levels
above. Workers map the files.
"""

from __future__ import annotations

import json
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release, scratch_path
from .langid import held_out
from .pieces import SHORT, Words

DEPTH = 5
#: How often a context of two bytes or more must have been seen.
LEAST = 2
#: Contexts of so many bytes and their nodes are built by themselves; those above on the driver.
SPLIT = 2
#: Distinct grams a task that builds trees, on average, and such tasks at most.
TASK_GRAMS, TASKS = 1_000_000, 4_096
#: Where workers can't open the shared folder, a model up to this size is broadcast.
BROADCAST_BYTES = 256 << 20
END = b"\xff"  # no byte of UTF-8
#: The end of a text as a token: no word holds white space.
END_TOKEN = b"\n"
#: Words of more than one part in this of the training tokens go to every worker; at most so many there are.
FREQUENT = 1 << 18
#: Words that the prior counts as, for words and for words after another; infinity: nothing is learned from the text.
PAIRS = [(a, b) for a in (math.inf, 4096.0, 512.0, 64.0) for b in (math.inf, 64.0, 8.0, 1.0)]
#: Bytes that are looked at side by side, and slots of the table of probabilities: they bound a worker's memory.
CHUNK = 1 << 20
SLOTS = 21

U = np.uint64
#: The white space between words.
WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
HASHES = Words(1)


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, bytes, bytes]]]:
    """Lists of about ``CHUNK`` bytes: the text's number, the ``DEPTH`` bytes before, the bytes. Long texts are cut."""
    some, size = [], 0
    for row, t in enumerate(texts):
        data = t + END
        for at in range(0, len(data), CHUNK):
            before = data[max(0, at - DEPTH) : at]
            some.append((row, END * (DEPTH - len(before)) + before, data[at : at + CHUNK]))
            size += len(some[-1][2])
            if size >= CHUNK:
                yield some
                some, size = [], 0
    if some:
        yield some


def grams(some: list[tuple[int, bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One number a byte: the bytes before it, the nearest first, then the byte; and how many bytes each piece has."""
    a = np.frombuffer(b"".join(x for _, before, data in some for x in (before, data)), dtype=np.uint8)
    n = np.array([len(data) for _, _, data in some])
    g = np.zeros(len(a) - DEPTH, dtype=U)
    for j in range(1, DEPTH + 1):
        g = (g << U(8)) | a[DEPTH - j : len(a) - j]
    g = (g << U(8)) | a[DEPTH:]
    keep = np.ones(len(g), dtype=bool)
    ends = np.cumsum(n[:-1] + DEPTH)
    keep[(ends[:, None] - DEPTH + np.arange(DEPTH)[None, :]).ravel()] = False
    return g[keep], n


def texts_by_word(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """The texts' numbers and bytes, about ``CHUNK`` bytes at a time; long texts are cut between words."""
    rows: list[int] = []
    some: list[bytes] = []
    size = 0
    for row, data in enumerate(texts):
        rest = b""
        for at in range(0, len(data), CHUNK):
            part = rest + data[at : at + CHUNK]
            if at + CHUNK < len(data):
                cut = re.search(rb"[^ \t-\r]*\Z", part).start()
                part, rest = part[:cut], part[cut:]
            rows.append(row)
            some.append(part)
            size += len(part)
            if size >= CHUNK:
                yield rows, some
                rows, some, size = [], [], 0
    if some:
        yield rows, some


def word_hash(w: bytes) -> int:
    return xxhash.xxh64_intdigest(w)


def slice_hashes(raw: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each slice."""
    out = np.zeros(len(start), dtype=U)
    short = np.nonzero(size <= SHORT)[0]
    out[short] = HASHES.hashes(raw + b" " * SHORT, start[short], size[short])[0]
    for i in np.nonzero(size > SHORT)[0].tolist():
        out[i] = word_hash(raw[start[i] : start[i] + size[i]])
    return out


def word_hashes(some: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of texts, in lower case; and how many words each text has."""
    raw = b"".join([b" ", b" ".join(some).lower(), b" " * SHORT])
    space = WHITE[np.frombuffer(raw, dtype=np.uint8)[: len(raw) - SHORT + 1]]
    edges = np.nonzero(space[1:] != space[:-1])[0] + 1
    start, size = edges[0::2], edges[1::2] - edges[0::2]
    first = np.cumsum([1, *(len(x) + 1 for x in some)])
    counts = np.diff(np.searchsorted(start, first))
    return slice_hashes(raw, start, size), counts


def _totals(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(codes):
        return codes, n
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    start = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
    return codes[start], np.add.reduceat(n, start)


def count_corpus(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, code, n``: how often each (DEPTH + 1)-gram of bytes (kind 0) and each token (1, by hash) occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]  # by kind

        def out(kind: int) -> Iterator[pa.RecordBatch]:
            c, n = _totals(*(np.concatenate([x[i] for x in fresh[kind]]) for i in (0, 1))) if fresh[kind] else (np.empty(0, dtype=U), np.empty(0, dtype=np.int64))
            fresh[kind] = []
            for i in range(0, len(c), 100_000):
                x, y = c[i : i + 100_000], n[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, dtype=np.int8)), pa.array(x.view(np.int64)), pa.array(y)], ["kind", "code", "n"])

        def add(kind: int, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Counts codes; passes counts on when many have come together."""
            codes = np.sort(codes)
            start = np.nonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))[0]
            mine = fresh[kind]
            mine.append((codes[start], np.diff(np.append(start, len(codes)))))
            if sum(len(x) for x, _ in mine) > 1_000_000:
                mine[:] = [_totals(*(np.concatenate([x[i] for x in mine]) for i in (0, 1)))]
                if len(mine[0][0]) > 700_000:
                    yield from out(kind)

        for b in batches:
            for at in range(0, b.num_rows, 500):
                texts = [t or b"" for t in b.column(0).slice(at, 500).to_pylist()]
                yield from add(1, np.full(len(texts), word_hash(END_TOKEN), dtype=U))
                for _, some in texts_by_word(texts):
                    if len(h := word_hashes(some)[0]):
                        yield from add(1, h)
                for some in pieces(texts):
                    yield from add(0, grams(some)[0])
            release()
        yield from out(0)
        yield from out(1)

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(run, "kind byte, code bigint, n bigint")
    return parts.groupBy("kind", "code").agg(F.sum("n").alias("n"))


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 1/2, by Stirling's series six further on."""
    shift = sum(np.log(x + i) for i in range(6))
    z = x + 6
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log probability that the Krichevsky-Trofimov estimator gives to so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - math.log(math.pi)


def _sharp(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Probabilities p = 1 - q: p, or -q if that is less, as near one a number of 32 bits would be one."""
    return np.where(p <= q, p, -q).astype(np.float32)


def _one_of(v: np.ndarray, first: np.ndarray | bool) -> np.ndarray:
    """Of what ``_sharp`` has packed p where ``first``, else q."""
    less = np.abs(v).astype(np.float64)
    return np.where(np.signbit(v) != first, less, 1 - less)  # -0.0 has a sign too


def _ids(code: np.ndarray, k: int) -> np.ndarray:
    """Node ids of grams (context, byte) before bit k: the context, a one, and the byte's first k bits."""
    return (code >> U(8)) << U(8) | (code & U(255)) >> U(8 - k) | U(1 << k)


def _depths(code: np.ndarray, n: np.ndarray, top: int, low: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By depth from ``low`` up to ``top``: the (context, byte) seen, sorted, and how often, from those of depth ``low``."""
    out = {low: _totals(code, n)}
    for d in range(low - 1, top - 1, -1):
        code, n = out[d + 1]
        out[d] = _totals((code >> U(16)) << U(8) | code & U(255), n)
    return out


def _held(code: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted (context, byte) those of contexts seen ``least`` times."""
    if not len(code):
        return code, n
    start = np.nonzero(np.concatenate([[True], code[1:] >> U(8) != code[:-1] >> U(8)]))[0]
    keep = np.repeat(np.add.reduceat(n, start) >= least, np.diff(np.append(start, len(code))))
    return code[keep], n[keep]


#: Of the nodes of one depth and bit: ids, how often they are met, with a one, and their log weighted probabilities.
Level = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Parts = dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def weigh(by_depth: dict[int, tuple[np.ndarray, np.ndarray]], below: dict[int, Level] | None = None) -> tuple[Parts, dict[int, Level]]:
    """The nodes by depth and bit: ids, the estimate of a one, the weight of stopping, and the estimate of what contexts
    that are no nodes have seen, as ``_sharp`` packs them; and by bit the least deep ones. ``below``: the nodes under the
    deepest."""
    parts: Parts = {}
    tops: dict[int, Level] = {}
    for k in range(8):
        kids = below[k] if below else None
        for d in sorted(by_depth, reverse=True):
            code, n = by_depth[d]
            if not len(code):
                none = np.empty(0)
                parts[d, k] = (np.empty(0, dtype=U), *[none.astype(np.float32)] * 3)
                kids = np.empty(0, dtype=U), none, none, none
                continue
            n = n.astype(np.float64)
            ids = _ids(code, k)
            start = np.nonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))[0]
            ids = ids[start]
            both = np.add.reduceat(n, start)
            ones = np.add.reduceat(n * ((code >> U(7 - k)) & U(1)), start)
            own = _kt(both - ones, ones)
            weighted, stop, other = own, _sharp(np.ones(len(ids)), np.zeros(len(ids))), np.full(len(ids), 0.5, dtype=np.float32)
            if kids is not None:
                kid, kid_both, kid_ones, kid_weighted = kids
                at = np.searchsorted(ids, (kid >> U(16)) << U(8) | kid & U(255))
                total = lambda v: np.bincount(at, weights=v, minlength=len(ids))  # noqa: E731, B023
                rest, rest_ones = np.maximum(both - total(kid_both), 0), np.maximum(ones - total(kid_ones), 0)
                split = total(kid_weighted) + _kt(np.maximum(rest - rest_ones, 0), rest_ones)
                inner = total(np.ones(len(kid))) > 0
                weighted = np.where(inner, np.logaddexp(own, split) - math.log(2), own)
                stop = _sharp(*(np.where(inner, np.exp(x - math.log(2) - weighted), y) for x, y in ((own, 1.0), (split, 0.0))))
                other = _sharp((rest_ones + 0.5) / (rest + 1), (np.maximum(rest - rest_ones, 0) + 0.5) / (rest + 1))
            parts[d, k] = ids, _sharp((ones + 0.5) / (both + 1), (both - ones + 0.5) / (both + 1)), stop, other
            kids = ids, both, ones, weighted
        tops[k] = kids
    return parts, tops


def subtrees(code: np.ndarray, n: np.ndarray, least: int) -> tuple[Parts, dict[str, np.ndarray]]:
    """The nodes of depth ``SPLIT`` and more of whole subtrees, from their grams; and what the levels above need."""
    seen = _depths(code, n, SPLIT, DEPTH)
    parts, tops = weigh({d: _held(*x, least) for d, x in seen.items()})
    return parts, {"code": seen[SPLIT][0], "n": seen[SPLIT][1]} | {f"{k}.{i}": x for k, t in tops.items() for i, x in enumerate(t)}


def crown(told: list[dict[str, np.ndarray]]) -> Parts:
    """The nodes above ``SPLIT``, from what ``subtrees`` has told of all subtrees, in order of their contexts."""
    if not told:
        return weigh({d: (np.empty(0, dtype=U), np.empty(0)) for d in range(SPLIT)})[0]
    every = {name: np.concatenate([t[name] for t in told]) for name in told[0]}
    seen = _depths(every["code"], every["n"], 0, SPLIT)
    return weigh({d: seen[d] for d in range(SPLIT)}, {k: tuple(every[f"{k}.{i}"] for i in range(4)) for k in range(8)})[0]


class Trees:
    """All trees: the nodes above ``SPLIT``, and those below by ranges of the ``SPLIT`` nearest bytes."""

    def __init__(self, top: Parts, lows: list[int], files: list[Parts]) -> None:
        self.top, self.lows, self.files = top, np.array(lows, dtype=U), files

    def log10(self, g: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others; ``g`` ascending."""
        cuts = [*np.searchsorted(g >> U(8 * (DEPTH + 1 - SPLIT)), self.lows).tolist(), len(g)]
        ranges = [(parts, slice(s, e)) for parts, s, e in zip(self.files, cuts, cuts[1:], strict=False) if e > s]
        out = np.zeros(len(g))
        for k in range(8):
            one = (g >> U(7 - k)) & U(1) == 1
            mix, seen = np.full(len(g), 0.5), np.zeros(len(g), dtype=bool)

            def up(parts: Parts, some: slice, d: int) -> None:
                ids, p, stop, other = parts[d, k]  # noqa: B023
                if not len(ids):
                    return
                x = g[some]
                want = _ids((x >> U(8 * (DEPTH + 1 - d))) << U(8) | x & U(255), k)  # noqa: B023
                at = np.minimum(np.searchsorted(ids, want), len(ids) - 1)
                here = np.nonzero(ids[at] == want)[0]
                at, y = at[here], one[some][here]  # noqa: B023
                own, rest, ends, goes = _one_of(p[at], y), _one_of(other[at], y), _one_of(stop[at], True), _one_of(stop[at], False)
                m, s = mix[some], seen[some]  # noqa: B023
                # of the deepest node on the path the other child is that of all contexts that are no nodes
                m[here] = ends * own + goes * np.where(s[here], m[here], rest)
                s[here] = True

            for parts, some in ranges:
                for d in range(DEPTH, SPLIT - 1, -1):
                    up(parts, some, d)
            for d in range(SPLIT - 1, -1, -1):
                up(self.top, slice(None), d)
            out += np.log10(mix)
        return out


def arrays_of(parts: Parts) -> dict[str, np.ndarray]:
    return {f"{d}.{k}.{i}": x for (d, k), t in parts.items() for i, x in enumerate(t)}


def parts_of(arrays: dict[str, np.ndarray]) -> Parts:
    return {(d, k): tuple(arrays[f"{d}.{k}.{i}"] for i in range(4)) for d, k in {tuple(map(int, name.split(".")[:2])) for name in arrays if name.count(".") == 2}}


def pack_arrays(arrays: dict[str, np.ndarray]) -> bytes:
    """The length of a table of contents, the table, and the arrays from offsets of eight bytes on."""
    toc, at = {}, 0
    for name, x in arrays.items():
        toc[name] = (x.dtype.str, at, len(x))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(toc).encode()
    head += b" " * (-len(head) % 8)
    return b"".join([len(head).to_bytes(8, "little"), head, *(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays.values())])


def unpack_arrays(raw: np.ndarray) -> dict[str, np.ndarray]:
    n = int.from_bytes(raw[:8].tobytes(), "little")
    toc = json.loads(raw[8 : 8 + n].tobytes())
    return {k: raw[8 + n + at : 8 + n + at + size * np.dtype(kind).itemsize].view(kind) for k, (kind, at, size) in toc.items()}


def put(raw: bytes, uri: str) -> bool:
    """Writes a file where workers find it; False if Arrow has no file system for that folder."""
    from pyarrow import fs

    try:
        store, where = fs.FileSystem.from_uri(uri)
        store.create_dir(where.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(where) as f:
            f.write(raw)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, NotImplementedError):
        return False
    return True


def mapped(source: str | bytes) -> np.ndarray:
    """What ``put`` has written: mapped, not read, where the file can be, so that workers of a machine share its pages."""
    from pyarrow import fs

    if not isinstance(source, str):
        return np.frombuffer(source, dtype=np.uint8)
    store, where = fs.FileSystem.from_uri(source)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(where, dtype=np.uint8, mode="r")
    with store.open_input_file(where) as f:
        return np.frombuffer(f.read(), dtype=np.uint8)


class Model:
    """Where the trees and the frequent words are: files, or what a broadcast holds of them."""

    def __init__(self, top: str | bytes, lows: list[int], files: list[str | bytes]) -> None:
        self.top, self.lows, self.files = top, lows, files

    def trees(self) -> Trees:
        return Trees(parts_of(unpack_arrays(mapped(self.top))), self.lows, [parts_of(unpack_arrays(mapped(f))) for f in self.files])


def fit(counts: DataFrame, words: dict[str, np.ndarray], least: int = LEAST):
    """The ``Model`` of what ``count_corpus`` has counted, in the shared folder; as a broadcast if workers can't open that."""
    spark = counts.sparkSession
    grams = counts.where("kind = 0").select("code", "n")
    tasks = max(1, min(TASKS, math.ceil(grams.count() / TASK_GRAMS)))
    dealt = grams.repartitionByRange(tasks, F.shiftright("code", 8 * (DEPTH + 1 - SPLIT))).sortWithinPartitions("code")
    folder = scratch_path(spark, "lm-model")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            code, n = (np.concatenate([b.column(i).to_numpy() for b in got]) for i in (0, 1))
            parts, told = subtrees(code.view(U), n, least)
            raw = pack_arrays(arrays_of(parts))
            # an attempt's file has its own name, and only that of the attempt which Spark commits is read
            name = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"
            stored = put(raw, name)
            yield pa.RecordBatch.from_pylist([{"low": int(code[0]) >> 8 * (DEPTH + 1 - SPLIT), "name": name if stored else None, "told": pack_arrays(told), "data": None if stored else raw}], pa.schema([("low", pa.int64()), ("name", pa.string()), ("told", pa.binary()), ("data", pa.binary())]))
            release()

    made = materialize(dealt.mapInArrow(build, "low bigint, name string, told binary, data binary"), "lm-trees")
    held = made.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    if held > BROADCAST_BYTES:
        raise ValueError(f"Arrow can't open {folder}, and a model of {held} bytes is too large for a broadcast")
    rows = made.orderBy("low").collect()  # a row a task
    top = pack_arrays(arrays_of(crown([unpack_arrays(np.frombuffer(r["told"], dtype=np.uint8)) for r in rows])) | words)
    lows = [r["low"] for r in rows]
    if not held and put(top, f"{folder}/top"):
        return Model(f"{folder}/top", lows, [r["name"] for r in rows])
    return spark.sparkContext.broadcast(Model(top, lows, [r["data"] if r["name"] is None else r["name"] for r in rows]))


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def _earlier(keys: np.ndarray) -> np.ndarray:
    """How often each key stands before."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], k[1:] != k[:-1]]), np.arange(len(k)), 0))
    out = np.empty(len(k), dtype=np.int64)
    out[order] = np.arange(len(k)) - start
    return out


class Repeats:
    """The texts' probabilities where their own words are learned from; texts come in order, long ones in pieces."""

    def __init__(self, size: int) -> None:
        self.sums = np.zeros((len(PAIRS), size))
        self._start(-1)

    def _start(self, row: int) -> None:
        self.row, self.n, self.last = row, 0, (U(0), 0)  # the last word, and how often it stood before
        self.seen = [(np.empty(0, dtype=U), np.empty(0, dtype=np.int64))] * 2

    def add(self, row: np.ndarray, h: np.ndarray, logs: np.ndarray) -> None:
        """Words by their text's number, ascending, their hash and what log10 the trees give them."""
        new = np.concatenate([[True], row[1:] != row[:-1]])
        start, at = np.nonzero(new)[0], np.arange(len(row))
        more = int(np.searchsorted(row, self.row, "right")) if row[0] == self.row else 0  # of the last text of the call before
        before = at - np.maximum.accumulate(np.where(new, at, 0))
        before[:more] += self.n
        prev = np.where(new, U(0), np.concatenate([h[:1], h[:-1]]))
        if more:
            prev[0] = self.last[0]
        text = _spread(row.astype(U) + U(1))
        keys = _spread(text ^ h), _spread(_spread(text + prev * U(3)) ^ h * U(0x9E3779B97F4A7C15))
        counts = [_earlier(k) for k in keys]
        for (known, n), k, c in zip(self.seen, keys, counts, strict=True):
            if more and len(known):
                i = np.minimum(np.searchsorted(known, k[:more]), len(known) - 1)
                c[:more] += np.where(known[i] == k[:more], n[i], 0)
        word, pair = counts
        others = np.where(new, 0, np.concatenate([[0], word[:-1]]))  # how often a word stood after the word before
        if more:
            others[0] = self.last[1]
        low = np.minimum(logs + 290, 0)  # what a number can't hold is added to the logarithm, but where counts outweigh it
        p = 10 ** (logs - low)
        for i, (a, b) in enumerate(PAIRS):
            q = p if a == math.inf else (word + a * p) / (before + a)
            x = np.log10(q if b == math.inf else (pair + b * q) / (others + b)) + np.where((pair if a == math.inf else word) == 0, low, 0)
            self.sums[i, row[start]] += np.add.reduceat(logs if a == b == math.inf else x, start)
        if row[-1] != self.row:
            self._start(int(row[-1]))
        tail = int(start[-1])
        self.n, self.last = self.n + len(row) - tail, (h[-1], int(word[-1]))
        self.seen = [_totals(np.concatenate([known, k[tail:]]), np.concatenate([n, np.ones(len(k) - tail, dtype=np.int64)])) for (known, n), k in zip(self.seen, keys, strict=True)]

    def log10(self) -> np.ndarray:
        most = self.sums.max(axis=0)
        return most + np.log10((10 ** (self.sums - most)).mean(axis=0))


class Scorer:
    """Scores texts in a worker; the probabilities of grams it has met wait in a table of fixed size."""

    def __init__(self, model: Model) -> None:
        got = unpack_arrays(mapped(model.top))
        words = got["words"].view(U)
        self.words, self.logs = Words(len(words)), np.log10(got["counts"] + 1.0)
        self.words.add(words, words, np.arange(len(words)))
        self.trees = model.trees()
        self.keys = np.full(1 << SLOTS, U((1 << 64) - 1))
        self.values = np.zeros(1 << SLOTS)

    def log10(self, g: np.ndarray) -> np.ndarray:
        at = (g * U(0x9E3779B97F4A7C15)) >> U(64 - SLOTS)
        out = self.values[at]
        miss = np.nonzero(self.keys[at] != g)[0]
        if len(miss):
            new, inverse = np.unique(g[miss], return_inverse=True)
            told = self.trees.log10(new)
            out[miss] = told[inverse]
            at = (new * U(0x9E3779B97F4A7C15)) >> U(64 - SLOTS)
            self.keys[at], self.values[at] = new, told
            # of two grams for one slot the last one written stays, key and value alike
        return out

    def scores(self, texts: list[bytes], repeats: bool = False) -> np.ndarray:
        out, own = np.zeros(len(texts)), Repeats(len(texts))
        for some in pieces(texts):
            g, n = grams(some)
            logs, rows = self.log10(g), np.array([row for row, _, _ in some])
            if repeats:  # a word and the white space or end after it; the last byte of a piece ends one too
                raw = (g & U(255)).astype(np.uint8)
                ends = (WHITE | (np.arange(256) == END[0]))[raw]
                ends[np.cumsum(n) - 1] = True
                stop = np.nonzero(ends)[0] + 1
                start = np.concatenate([[0], stop[:-1]])
                h = slice_hashes(raw.tobytes(), start, stop - start)
                own.add(rows[np.searchsorted(np.cumsum(n), start, "right")], h, np.add.reduceat(logs, start))
            else:
                np.add.at(out, rows, np.add.reduceat(logs, np.concatenate([[0], np.cumsum(n)[:-1]])))
        return own.log10() if repeats else out

    def frequent(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether words are frequent, by their hashes, and log10(count + 1) of those that are."""
        at = self.words.find(h, h)
        return at >= 0, np.where(at >= 0, self.logs[at] if len(self.logs) else 0.0, 0.0)

    def tokens(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text how many tokens it has, how many of them are frequent and the sum of log10(count + 1) of these;
        and the others: the text's number, their hash, how often they occur in it."""
        end, log = self.frequent(np.array([word_hash(END_TOKEN)], dtype=U))
        size = len(texts)
        n, known, logs = np.ones(size, dtype=np.int64), np.full(size, int(end[0])), np.full(size, log[0])
        rest = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=U))]
        for rows, some in texts_by_word(texts):
            h, counts = word_hashes(some)
            row = np.repeat(rows, counts)
            often, log = self.frequent(h)
            n += np.bincount(row, minlength=size)
            known += np.bincount(row[often], minlength=size)
            logs += np.bincount(row, weights=log, minlength=size)
            rest.append((row[~often], h[~often]))
        row, h = (np.concatenate([x[i] for x in rest]) for i in (0, 1))
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        start = np.nonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))[0] if len(row) else np.empty(0, dtype=np.int64)
        return n, known, logs, (row[start], h[start].view(np.int64), np.diff(np.append(start, len(row))))


_SCORERS: dict[object, Scorer] = {}


def scorer(model, key: str) -> Scorer:
    """One in a worker, so that what it has met serves all its tasks."""
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(model if isinstance(model, Model) else model.value)
    return _SCORERS[key]


def lm_scores(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, repeats: bool = False) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` of each whole text of ``docs``.

    ``score`` is the log10 probability that the trees fitted on the texts of ``train`` give the text and its end, with
    ``repeats`` one that learns from the text's own words as well (texts over ``CHUNK`` bytes: a word may be cut there);
    ``base_score`` that of a unigram model of its words in lower case and one end, add-one smoothed over the V words of
    ``train`` and one more. Null texts: as empty ones, an end alone. Null ids stay null. Rows that repeat: each scored.
    No training text: every bit is even, every word new. Empty table: no rows. Words are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    counts = materialize(count_corpus(train, text_col), "lm-counts")
    words = counts.where("kind = 1").select(F.col("code").alias("h"), F.col("n").alias("c"))
    n_train, vocab = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    often = words.where(F.col("c") > n_train / FREQUENT).toArrow()
    words_often, counts_often = (often.column(c).combine_chunks().to_numpy() for c in ("h", "c"))
    order = np.argsort(words_often)
    model = fit(counts, {"words": words_often[order], "counts": counts_often[order]}, least)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = scorer(model, key)
        row = TaskContext.get().partitionId() << 36
        names = ["row", "doc_id", "n", "known", "logs", "score", "n_bytes", "h"]
        for b in batches:
            for at in range(0, b.num_rows, 500):
                some = [t or b"" for t in b.column(1).slice(at, 500).to_pylist()]
                rows = np.arange(row, row + len(some))
                n, known, logs, (of, h, times) = lm.tokens(some)
                sizes = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + 1
                yield pa.RecordBatch.from_arrays([pa.array(rows), b.column(0).slice(at, 500), *map(pa.array, (n, known, logs, lm.scores(some, repeats), sizes)), pa.nulls(len(some), pa.int64())], names)
                none, nan = pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(rows[of]), none, pa.array(times), none, nan, nan, none, pa.array(h)], names)
                row += len(some)
            release()

    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary"))
    schema = "row bigint, doc_id bigint, n bigint, known bigint, logs double, score double, n_bytes bigint, h bigint"
    made = materialize(cols.mapInArrow(run, schema), "lm-scores")
    rare = made.where("h is not null").select("row", "h", "n").join(words, "h")  # words that training lacks add log10(1)
    rare = rare.groupBy("row").agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more_logs"))
    own = made.where("h is null").join(rare, "row", "left")
    return own.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(n_train)).cast("bigint").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n") * F.lit(math.log10(n_train + vocab + 1))).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_lm_scores(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = lm_scores(docs, docs.where(~held_out(of=7)), repeats=True)
    return out.select("doc_id", held_out(of=7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
