"""SentencePiece encoding and decoding with seeded merge-dropout.

The model file gives pieces and scores; merging is done here, as an agenda of candidate merges, the best score first
and the leftmost of equals. With dropout each candidate that comes up is skipped with the given rate; a skipped one stays
skipped. Every occurrence of a word draws for itself, from a hash of document, pass and place: the gaps between skipped
candidates, counted as they come up, are geometric. So a segmentation follows from the word and the set of skips, and is
kept by these. Whatever is skipped, the pieces spell the same text, so every segmentation decodes to it: white space and
all, and characters without a piece as bytes.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Stands for a literal U+2581 of the text, which must not turn into a space; no valid text holds it.
LITERAL = "\udc81"
NEVER = 1 << 60
MASK = (1 << 64) - 1
GOLDEN = 0x9E3779B97F4A7C15
#: Segmentations that a worker keeps, over all sets of skips.
CACHE = 400_000
#: Segmentations of more candidates than this are made anew each time they have skips.
KEPT = 63


def _mix(x: int) -> int:
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


@lru_cache(maxsize=8)
def _chances(limit: int) -> tuple[list[int], np.ndarray]:
    """2^53 times the chance that the next j candidates are kept, for j from 1 on, in ascending order."""
    keep, table = 1 - limit / 2**53, []
    p = keep * 2**53
    while p >= 1 and len(table) < 1 << 16:
        table.append(int(p))
        p *= keep
    return table[::-1], np.array(table[::-1], dtype=np.uint64)


def _gap(key: int, limit: int) -> int:
    """How many candidates are kept before the next that is skipped."""
    table = _chances(limit)[0]
    return len(table) - bisect_right(table, key >> 11)


def _gaps(key: np.ndarray, limit: int) -> np.ndarray:
    table = _chances(limit)[1]
    return len(table) - np.searchsorted(table, key >> np.uint64(11), side="right")


class Draw:
    """The skips that follow from a key: the candidates up to ``next`` are kept, that one is skipped, and so on."""

    def __init__(self, key: int, limit: int) -> None:
        self.key, self.limit, self.n = key, limit, 0
        self.next = _gap(key, limit) if limit else NEVER

    def skips(self) -> bool:
        """Whether the candidate that has come up is skipped."""
        n = self.n
        self.n += 1
        if n != self.next:
            return False
        self.key = _mix(self.key + GOLDEN & MASK)
        self.next = n + 1 + _gap(self.key, self.limit)
        return True


class Given:
    """The skips that the bits of a number name, the first candidate the lowest."""

    def __init__(self, mask: int) -> None:
        self.mask, self.n = mask, 0

    def skips(self) -> bool:
        n = self.n
        self.n += 1
        return bool(self.mask >> n & 1)


class Pieces:
    """A merge-type model with byte fallback, as its file tells it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.path = path
        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("a merge-type model with byte fallback and no character map is needed")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        normal = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == 1]
        self.size = len(model.pieces)
        self.ids = {p: i for p, _, i in normal}
        best = {s: n for n, s in enumerate(sorted({s for _, s, _ in normal}, reverse=True))}
        self.rank = {p: best[s] for p, s, _ in normal if len(p) > 1}
        self.bytes = [b""] * self.size
        self.byte_id = {}
        for i, p in enumerate(model.pieces):
            if p.type == 6:
                self.byte_id[int(p.piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == 1:
                self.bytes[i] = p.piece.replace(SPACE, " ").encode()
        self.is_byte = np.zeros(self.size, dtype=bool)
        self.is_byte[list(self.byte_id.values())] = True
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.ids):
            raise ValueError("pieces must not span words or lines")
        # symbols are piece ids, or for characters without a piece their code points after all ids
        self.symbol = np.arange(0x110000, dtype=np.int32) + self.size
        for q, i in self.ids.items():
            if len(q) == 1:
                self.symbol[ord(q)] = i
        joins = {}
        for q in self.rank:
            for cut in range(1, len(q)):
                a, b = (self.ids.get(x, self.size + ord(x) if len(x) == 1 else None) for x in (q[:cut], q[cut:]))
                if a is not None and b is not None:
                    joins[a << 22 | b] = q
        # the joins in an open table: a join is at its slot or one of the next few
        bits = max(8, (len(joins) * 4).bit_length())
        self.shift, self.reach = np.uint64(64 - bits), 0
        self.join_key = np.full((1 << bits) + 64, -1, dtype=np.int64)
        self.join_to = np.zeros(len(self.join_key), dtype=np.int32)
        self.join_rank = np.zeros(len(self.join_key), dtype=np.int32)
        for k, slot in zip(joins, self._slot(np.array(list(joins), dtype=np.int64)).tolist(), strict=True):
            away = next(i for i in range(64) if self.join_key[slot + i] < 0)
            self.reach = max(self.reach, away)
            self.join_key[slot + away], self.join_to[slot + away], self.join_rank[slot + away] = k, self.ids[joins[k]], self.rank[joins[k]]

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    @cached_property
    def library(self):
        from sentencepiece import SentencePieceProcessor

        return SentencePieceProcessor(model_file=self.path)

    #: No piece goes past these, so each segment can be merged by itself.
    SEGMENT = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+")

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if SPACE in text:
            text = text.replace(SPACE, LITERAL)
        return self.SEGMENT.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def merge(self, segment: str, rate: float = 0.0, key: int = 0) -> list[int]:
        """The ids of one segment. ``rate``: the share of candidate merges that the draws from ``key`` skip."""
        return self._merge(segment, Draw(key, int(rate * 2**53)))

    def _merge(self, segment: str, draw: Draw | Given) -> list[int]:
        parts = list(segment)
        if len(parts) > 200:
            parts = self._merge_heap(parts, draw)
        elif len(parts) > 1:
            rank = self.rank
            cand = [rank.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            while cand:
                c = min(cand)
                if c == NEVER:
                    break
                i = cand.index(c)
                if draw.skips():
                    cand[i] = NEVER
                    continue
                parts[i] += parts.pop(i + 1)
                del cand[i]
                if i:
                    cand[i - 1] = rank.get(parts[i - 1] + parts[i], NEVER)
                if i < len(cand):
                    cand[i] = rank.get(parts[i] + parts[i + 1], NEVER)
        out: list[int] = []
        for p in parts:
            got = self.ids.get(p)
            if got is not None:
                out.append(got)
            else:
                out += [self.byte_id[b] for b in (SPACE if p == LITERAL else p).encode("utf-8", "surrogatepass")]
        return out

    def merge_masked(self, segments: list[str], masks: list[int]) -> list[tuple[int, np.ndarray]]:
        """For each segment, merged with the candidates skipped that its mask names: how many came up, and the ids.

        Segments of up to ``KEPT`` + 1 characters are merged side by side.
        """
        out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.int32))] * len(segments)
        order = sorted(range(len(segments)), key=lambda i: len(segments[i]))
        at = 0

        def alone(i: int) -> tuple[int, np.ndarray]:
            given = Given(masks[i])
            ids = self._merge(segments[i], given)
            return given.n, np.array(ids, dtype=np.int32)

        while at < len(order):
            if len(segments[order[at]]) > KEPT + 1:
                out[order[at]] = alone(order[at])
                at += 1
                continue
            some = [i for i in order[at : at + 4096] if len(segments[i]) <= KEPT + 1]
            for i, got in zip(some, self._merge_block([segments[i] for i in some], [masks[i] for i in some]), strict=True):
                out[i] = got if got is not None else alone(i)
            at += len(some)
        return out

    def _candidates(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NEVER`` if none) and result of the merges of symbols side by side."""
        want = left << 22 | right
        i = self._slot(want)
        got = self.join_key[i]
        ok = got == want
        for _ in range(self.reach):
            on = np.nonzero(~ok & (got >= 0))[0]
            if not len(on):
                break
            i[on] += 1
            got[on] = self.join_key[i[on]]
            ok[on] = got[on] == want[on]
        return np.where(ok, self.join_rank[i].astype(np.int64), NEVER), self.join_to[i].astype(np.int64)

    def _merge_block(self, segments: list[str], masks: list[int]) -> list[tuple[int, np.ndarray] | None]:
        """Segments of like length, a candidate of each at a time; None for those with characters that have no piece, or
        more candidates than there are bits."""
        sizes = np.array([len(x) for x in segments])
        n, width = len(segments), int(sizes.max())
        flat = self.symbol[np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        inside = np.arange(width)[None, :] < sizes[:, None]
        sym = np.full((n, width + 1), -1, dtype=np.int64)
        sym[:, :width][inside] = flat
        skips = np.array(masks, dtype=np.uint64)
        up = np.zeros(n, dtype=np.int64)
        after = np.minimum(np.arange(1, width + 2)[None, :], sizes[:, None])  # the next symbol's place; the size: none
        before = np.tile(np.arange(-1, width), (n, 1))
        rank = np.full((n, width + 1), NEVER, dtype=np.int64)
        to = np.zeros((n, width + 1), dtype=np.int64)
        alive = np.concatenate([inside, np.zeros((n, 1), dtype=bool)], axis=1)
        r, c = np.nonzero(np.arange(1, width)[None, :] < sizes[:, None])
        rank[r, c], to[r, c] = self._candidates(sym[r, c], sym[r, c + 1])
        going = np.arange(n)
        while len(going):
            i = rank[going].argmin(axis=1)
            on = rank[going, i] < NEVER
            rows = going = going[on]
            i = i[on]
            skipped = skips[rows] & np.uint64(1) == 1
            skips[rows] >>= np.uint64(1)
            up[rows] += 1
            rank[rows, i] = NEVER
            if skipped.any():
                rows, i = rows[~skipped], i[~skipped]
            j = after[rows, i]
            end = after[rows, j]
            sym[rows, i] = to[rows, i]
            alive[rows, j] = False
            rank[rows, j] = NEVER
            after[rows, i] = end
            before[rows, end] = i
            m = end < sizes[rows]
            a, x, y = rows[m], i[m], end[m]
            rank[a, x], to[a, x] = self._candidates(sym[a, x], sym[a, y])
            m = i > 0
            a, x = rows[m], i[m]
            p = before[a, x]
            rank[a, p], to[a, p] = self._candidates(sym[a, p], sym[a, x])
        ids = sym[alive]
        odd = up > KEPT
        odd[np.nonzero(alive)[0][ids >= self.size]] = True
        ids = ids.astype(np.int32)
        ends = np.cumsum(alive.sum(axis=1))
        return [None if o else (u, ids[s:e]) for o, u, s, e in zip(odd.tolist(), up.tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _merge_long(self, parts: list[str], limit: int, key: int) -> list[str]:
        return self._merge_heap(parts, Draw(key, limit))

    def _merge_heap(self, parts: list[str], draw: Draw | Given) -> list[str]:
        """The same by a heap and links, for segments without a space in sight."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        agenda: list[tuple[int, int, int, int]] = []

        def propose(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n:
                c = self.rank.get(parts[i] + parts[j], NEVER)
                if c != NEVER:
                    heapq.heappush(agenda, (c, i, j, after[j]))

        for i in range(n - 1):
            propose(i)
        while agenda:
            _, i, j, end = heapq.heappop(agenda)
            if not alive[i] or after[i] != j or j >= n or after[j] != end:
                continue
            if draw.skips():
                continue
            parts[i] += parts[j]
            alive[j] = False
            after[i] = end
            if end < n:
                before[end] = i
            if before[i] >= 0:
                propose(before[i])
            propose(i)
        return [p for p, a in zip(parts, alive, strict=True) if a]

    @cached_property
    def _spelt(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces in a row; where each piece's begin, and how many it has."""
        size = np.array([len(x) for x in self.bytes])
        return np.frombuffer(b"".join(self.bytes), dtype=np.uint8), np.cumsum(size) - size, size

    def decode_bytes(self, ids: np.ndarray, ends: np.ndarray) -> list[memoryview]:
        """The UTF-8 of the texts that runs of ids spell; a run ends where the next begins."""
        raw, start, size = self._spelt
        n = size[ids]
        out = raw[_runs(start[ids], n)].data
        stops = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], ends])].tolist()
        return [out[s + 1 if self.prefix and e > s else s : e] for s, e in zip(stops, stops[1:], strict=False)]

    def decode(self, ids) -> str:
        """The text that ids spell."""
        table = self.bytes
        out = b"".join([table[i] for i in ids])
        return (out[1:] if self.prefix else out).decode("utf-8", "surrogatepass")


@lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)


def _runs(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each run, one run after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


#: Words of up to so many bytes are looked up by array.
SHORT = 32
LANES = SHORT // 8
#: What is left of eight bytes of which the first few belong to a word.
PART = np.array([(1 << 8 * k) - 1 for k in range(8)] + [MASK], dtype=np.uint64)


class Words:
    """Numbers of short words in an open table. A word is known by two hashes of 64 bits of its bytes."""

    def __init__(self, room: int) -> None:
        self.used = 0
        self._empty((2 * room).bit_length())
        rng = np.random.default_rng(7)
        self.weights = rng.integers(1, 1 << 63, (2, LANES + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def _empty(self, bits: int) -> None:
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.one, self.two = (np.zeros(1 << bits, dtype=np.uint64) for _ in range(2))
        self.number = np.full(1 << bits, -1, dtype=np.int32)

    def hashes(self, raw: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words of up to ``SHORT`` bytes that start in ``raw``, which goes on for as many bytes after the last."""
        eight = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        one, two = (size.astype(np.uint64) * w[LANES] for w in self.weights)
        for k in range(LANES):
            on = slice(None) if not k else np.nonzero(size > 8 * k)[0]
            lane = eight[start[on] + 8 * k] & PART[np.minimum(size[on] - 8 * k, 8)]
            one[on] += lane * self.weights[0, k]
            two[on] += lane * self.weights[1, k]
        return _mixed(one), two

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for one that is not there."""
        out = np.full(len(one), -1, dtype=np.int64)
        slot, todo = (one >> self.shift).astype(np.int64), np.arange(len(one))
        while len(todo):
            got = self.number[slot]
            hit = (got >= 0) & (self.one[slot] == one[todo]) & (self.two[slot] == two[todo])
            out[todo[hit]] = got[hit]
            on = ~hit & (got >= 0)
            todo, slot = todo[on], slot[on] + 1 & self.last
        return out

    def add(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        """New words, each once; the table grows so that half of it at least is free."""
        self.used += len(one)
        if 2 * self.used > self.last:
            held = np.nonzero(self.number >= 0)[0]
            old = self.one[held], self.two[held], self.number[held]
            self._empty((2 * self.used).bit_length() + 1)
            self._put(*old)
        self._put(one, two, numbers)

    def _put(self, one: np.ndarray, two: np.ndarray, numbers: np.ndarray) -> None:
        slot, todo = (one >> self.shift).astype(np.int64), np.arange(len(one))
        while len(todo):
            free = np.nonzero(self.number[slot] < 0)[0]
            at, first = np.unique(slot[free], return_index=True)
            first = free[first]
            self.one[at], self.two[at], self.number[at] = one[todo[first]], two[todo[first]], numbers[todo[first]]
            on = np.ones(len(todo), dtype=bool)
            on[first] = False  # the others' slots are taken
            todo, slot = todo[on], slot[on] + 1 & self.last


class Encoder:
    """Encodes texts in a worker, keeping the segmentations it has met.

    What is kept goes by token: a text's words between single spaces, where a line feed starts a new one. Texts with
    runs of spaces, a space at the start or characters that tokens use as marks go by segment. A segmentation is a
    number: of a token without skips, or of another segmentation with one more candidate skipped after its last.
    """

    def __init__(self, path: str, rate: float = 0.0, seed: int = 0) -> None:
        self.pieces, self.seed, self.limit = load(path), seed, int(rate * 2**53)
        self.room = CACHE if self.limit else 2 * CACHE  # words are kept without their letters where none is skipped
        self._forget()

    def _forget(self) -> None:
        self.words = Words(self.room)  # a token's segmentation without skips: short tokens
        self.root: dict[str, int] = {}  # and others
        self.child: dict[int, int] = {}  # by segmentation and the candidate skipped next
        self.token: list[str] = []  # of each segmentation the token, the set of skips as bits; with dropout
        self.mask: list[int] = []
        self.count = 0
        self.n = np.empty(0, dtype=np.int32)  # how many candidates come up, and where its ids are
        self.start = np.empty(0, dtype=np.int64)
        self.size = np.empty(0, dtype=np.int32)
        self.ids = np.empty(0, dtype=np.int32)
        self.used = 0  # of ids

    def plain(self, text: str) -> bool:
        """Whether a text's tokens are its words."""
        return self.pieces.prefix and "  " not in text and text[:1] != " " and SPACE not in text and "\0" not in text

    def tokens(self, text: str) -> list[str]:
        if not text:
            return []
        if self.plain(text):
            return text.replace("\n", " \n").split(" ")
        return ["\0" + s for s in self.pieces.segments(text)]

    @staticmethod
    def _segments(token: str) -> list[str]:
        if token[:1] == "\0":
            return [token[1:]]
        if token[:1] == "\n":
            return ["\n", token[1:]] if len(token) > 1 else ["\n"]
        return [SPACE + token]

    def _number(self, tokens: list[str], masks: list[int]) -> np.ndarray:
        """New numbers in order."""
        at, self.count = self.count, self.count + len(tokens)
        if self.limit:
            self.token += tokens
            self.mask += masks
        if self.count > len(self.n):
            self.n, self.start, self.size = (np.concatenate([x, np.zeros(max(4096, self.count), dtype=x.dtype)]) for x in (self.n, self.start, self.size))
        return np.arange(at, self.count)

    def _keep(self, numbers: np.ndarray, n: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """What numbers stand for."""
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(1 << 16, self.used // 2 + 2 * len(flat)), dtype=np.int32)])
        self.n[numbers], self.size[numbers] = n, sizes
        self.start[numbers] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return numbers

    def _learn(self, new: list[str]) -> np.ndarray:
        """Numbers of new tokens' segmentations without skips. The library merges the same, and faster."""
        numbers, p = self._number(new, [0] * len(new)), self.pieces
        odd = [i for i, t in enumerate(new) if t[:1] == "\0"]
        some, mine = new, numbers
        if odd:
            some, mine = [t for t in new if t[:1] != "\0"], np.delete(numbers, odd)
            self._merged(numbers[odd], [new[i] for i in odd], [0] * len(odd))
        if not some:
            return numbers
        told = p.library.encode(some, num_threads=1)
        sizes = np.fromiter(map(len, told), dtype=np.int64, count=len(told))
        flat = np.fromiter(chain.from_iterable(told), dtype=np.int32, count=int(sizes.sum()))
        line = np.fromiter((t[:1] == "\n" for t in some), dtype=bool, count=len(some))
        if line.any():  # after a line feed no space goes before; the library's comes out as a piece of its own
            flat = np.delete(flat, (np.cumsum(sizes) - sizes)[line])
            sizes -= line
        if "" in some:  # the space alone
            at = some.index("")
            flat = np.insert(flat, int(sizes[:at].sum()), p.ids[SPACE])
            sizes[at] += 1
        parts = sizes
        if self.limit:
            parts = sizes.copy()
            for i in np.unique(np.repeat(np.arange(len(some)), sizes)[p.is_byte[flat]]).tolist():  # a character without a piece is one part
                parts[i] -= sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in some[i] if c not in p.ids)
        n = np.fromiter(map(len, some), dtype=np.int64, count=len(some)) + ~line - parts
        self._keep(mine, n, sizes, flat)
        return numbers

    def _merged(self, numbers: np.ndarray, tokens: list[str], masks: list[int]) -> None:
        """Merges tokens with skips; a line feed at the start has no candidates."""
        got = self.pieces.merge_masked([self._segments(t)[-1] for t in tokens], masks)
        line = np.array(self.pieces.merge("\n"), dtype=np.int32)
        ids = [np.concatenate([line, x]) if t[:1] == "\n" and len(t) > 1 else x for t, (_, x) in zip(tokens, got, strict=True)]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self._keep(numbers, np.array([n for n, _ in got]), sizes, np.concatenate(ids))

    def _by_word(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of texts whose tokens are their words: the number of each token, and how many each text has."""
        parts = [t.encode("utf-8", "surrogatepass") for t in texts]
        raw = b"".join([b" ", b" ".join(parts), b" " * SHORT])  # a space goes before each text, and ends the last
        a = np.frombuffer(raw, dtype=np.uint8)[: len(raw) - SHORT + 1]
        marks = np.nonzero((a == 32) | (a == 10))[0]  # before each token: a space, or its own line feed
        start = marks[:-1] + (a[marks[:-1]] == 32)
        size = marks[1:] - start
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)])
        counts = np.diff(np.searchsorted(marks, first))
        found = np.full(len(start), -1, dtype=np.int64)
        short = np.nonzero(size <= SHORT)[0]
        one, two = self.words.hashes(raw, start[short], size[short])
        found[short] = self.words.find(one, two)
        word = lambda i: raw[start[i] : start[i] + size[i]].decode("utf-8", "surrogatepass")
        if len(miss := np.nonzero(found[short] < 0)[0]):
            _, at, inverse = np.unique(one[miss], return_index=True, return_inverse=True)
            new = miss[at]
            s, e = start[short[new]].tolist(), (start + size)[short[new]].tolist()
            numbers = self._learn([raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(s, e, strict=True)])
            self.words.add(one[new], two[new], numbers)
            found[short[miss]] = numbers[inverse]
        if len(long := np.nonzero(size > SHORT)[0]):
            found[long] = self._by_token([word(i) for i in long.tolist()])
        return found, counts

    def _by_token(self, tokens: list[str]) -> np.ndarray:
        new = list(dict.fromkeys(t for t in tokens if t not in self.root))
        if new:
            self.root.update(zip(new, self._learn(new).tolist(), strict=True))
        return np.fromiter(map(self.root.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def encode_flat(self, texts: list[str], docs: list[int] | None = None, passes: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's end. With dropout each token's skips depend on its text's
        ``docs`` and ``passes``, and its place."""
        if self.count >= self.room:
            self._forget()
        counts, words, others = np.zeros(len(texts), dtype=np.int64), [], []
        for i, t in enumerate(texts):
            if t:
                (words if self.plain(t) else others).append(i)
        parts = []
        if words:
            found, counts[words] = self._by_word([texts[i] for i in words])
            parts.append((words, found))
        if others:
            split = [self.tokens(texts[i]) for i in others]
            counts[others] = list(map(len, split))
            parts.append((others, self._by_token(list(chain.from_iterable(split)))))
        found, at = np.zeros(int(counts.sum()), dtype=np.int64), np.cumsum(counts) - counts
        for rows, some in parts:
            found[_runs(at[rows], counts[rows])] = some
        if self.limit:
            starts = [xxhash.xxh64_intdigest(f"{self.seed},{d},{k}") for d, k in zip(docs or [0] * len(texts), passes or [0] * len(texts), strict=True)]
            place = _runs(np.ones(len(counts), dtype=np.int64), counts).astype(np.uint64)
            self._drop(found, _mixed(np.repeat(np.array(starts, dtype=np.uint64), counts) + place * np.uint64(GOLDEN)))
        sizes = self.size[found].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(counts)]
        return self.ids[_runs(self.start[found], sizes)], ends

    def _drop(self, found: np.ndarray, keys: np.ndarray) -> None:
        """Turns each token's segmentation without skips into that with the skips of its key, a skip of all at a time."""
        skip = _gaps(keys, self.limit)
        on = np.nonzero(skip < self.n[found])[0]
        key, skip = keys[on], skip[on]
        alone: list[int] = []
        while len(on):
            wild = skip >= KEPT
            if wild.any():
                alone += on[wild].tolist()
                on, key, skip = on[~wild], key[~wild], skip[~wild]
            want, inverse = np.unique(found[on] << 6 | skip, return_inverse=True)
            got = list(map(self.child.get, want.tolist()))
            if None in got:
                new = [w for w, g in zip(want.tolist(), got, strict=True) if g is None]
                words, masks = [self.token[w >> 6] for w in new], [self.mask[w >> 6] | 1 << (w & 63) for w in new]
                made = self._number(words, masks)
                self._merged(made, words, masks)
                self.child.update(zip(new, made.tolist(), strict=True))
                got = map(self.child.__getitem__, want.tolist())
            found[on] = np.fromiter(got, dtype=np.int64, count=len(want))[inverse]
            key = _mixed(key + np.uint64(GOLDEN))
            skip = skip + 1 + _gaps(key, self.limit)
            still = skip < self.n[found[on]]
            on, key, skip = on[still], key[still], skip[still]
        for i in alone:  # skips beyond the bits of a mask
            token = self.token[found[i]]
            parts = self._segments(token)
            ids = [x for s in parts[:-1] for x in self.pieces.merge(s)] + self.pieces._merge(parts[-1], Draw(int(keys[i]), self.limit))
            found[i] = self._keep(self._number([token], [0]), np.zeros(1), np.array([len(ids)]), np.array(ids, dtype=np.int32))[0]

    def encode_many(self, texts: list[str], docs: list[int] | None = None, passes: list[int] | None = None) -> list[np.ndarray]:
        """The ids of each text."""
        flat, ends = self.encode_flat(texts, docs, passes)
        return np.split(flat, ends[:-1]) if len(texts) else []

    def encode(self, text: str, doc: int = 0) -> np.ndarray:
        return self.encode_many([text], [doc])[0]


@lru_cache(maxsize=4)
def encoder(path: str, rate: float, seed: int) -> Encoder:
    """One for each setting in a worker; ``let_go`` ends it."""
    return Encoder(path, rate, seed)


def let_go() -> None:
    """At the end of a task: a machine may have more idle workers than cores, and each would hold all it has met."""
    encoder.cache_clear()
    release()


def piece_encode(docs: DataFrame, rate: float = 0.1, seed: int = 2, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", pass_col: str | None = None) -> DataFrame:
    """``doc_id, ids, n_tokens, decoded_sha256``: each whole text's piece ids, and a hash of what these decode to.

    ``rate`` 0 gives the model's plain segmentation; else each word of a document is drawn for by its place, and by the
    number in ``pass_col``, for documents that occur in several passes. Null and empty texts: no ids. Very long texts and segments: like
    others. Null ids: encoded as id 0 would. Rows that repeat: each its own row, with equal ids unless their passes differ. Empty table: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        enc = encoder(model, rate, seed)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                docs, texts, passes = (b.column(i).slice(at, 500).to_pylist() for i in (0, 1, 2))
                flat, ends = enc.encode_flat([t or "" for t in texts], [d or 0 for d in docs], [n or 0 for n in passes])
                told = [hashlib.sha256(x).hexdigest() for x in enc.pieces.decode_bytes(flat, ends)]
                ends = np.concatenate([[0], ends])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 500), lists, pa.array(np.diff(ends)), pa.array(told)], ["doc_id", "ids", "n_tokens", "decoded_sha256"])
            release()
        let_go()

    cols = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(pass_col).cast("bigint").alias("pass") if pass_col else F.lit(0).cast("bigint").alias("pass"))
    return cols.mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens bigint, decoded_sha256 string")


def piece_decode(tokens: DataFrame, model: str = MODEL, ids_col: str = "ids") -> DataFrame:
    """``tokens`` with ``text``, what ``ids_col`` spells; null ids: null."""

    @F.pandas_udf("string")
    def run(ids):
        table = load(model)
        return ids.map(lambda x: None if x is None else table.decode(x.tolist()))

    return tokens.withColumn("text", run(F.col(ids_col)))


def op2_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return piece_encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
