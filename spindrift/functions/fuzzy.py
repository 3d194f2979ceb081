"""String similarity, 0 to 100: by longest common subsequence, token order and best window.

No SQL function counts a substitution as two edits, so the ratio itself runs in Arrow batches, over distinct pairs.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _places(a: str) -> dict[str, int]:
    """Where each character of a string stands, as the bits of an integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    return where


def _common(where: dict[str, int], n: int, b: str) -> int:
    """The length of the longest common subsequence, a row of the table as the bits of one integer."""
    full = (1 << n) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return n - row.bit_count()


def lcs(a: str, b: str) -> int:
    return _common(_places(a), len(a), b) if a and b else 0


def ratio(a: str, b: str) -> int:
    """Twice the common part of both lengths together, in per cent, halves to even."""
    total = len(a) + len(b)
    return round(200 * lcs(a, b) / total) if total else 100


def partial_ratio(a: str, b: str) -> int:
    """The best ratio of the shorter string with any part of the longer that is as long, at its ends also shorter."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100 if not long else 0
    n, where = len(short), _places(short)
    if not lcs(short, long):
        return 0
    best = 0
    for at in range(1 - n, len(long)):
        part = long[max(0, at) : at + n]
        most = sum(ch in where for ch in part)  # no more of it can be in common
        if round(200 * min(n, most) / (n + len(part))) > best:
            best = max(best, round(200 * _common(where, n, part) / (n + len(part))))
        if best == 100:
            break
    return best


def tokens(s: str) -> list[str]:
    return sorted(re.sub(r"[\W_]+", " ", s.lower()).split())


def token_sort_ratio(a: str, b: str) -> int:
    return ratio(" ".join(tokens(a)), " ".join(tokens(b)))


def token_set_ratio(a: str, b: str) -> int:
    """The best ratio among the words in common, and these with what only one side has."""
    x, y = set(tokens(a)), set(tokens(b))
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if not x or not y:
        return 0
    p, q = f"{both} {only_x}".strip(), f"{both} {only_y}".strip()
    if both and (not only_x or not only_y):
        return 100
    return max([ratio(p, q)] + ([ratio(both, p), ratio(both, q)] if both else []))


def _pairwise(f):
    @F.pandas_udf("int")
    def run(a, b):
        return a.fillna("").combine(b.fillna(""), f).astype("int32")

    return run


def ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(ratio)(a, b)


def partial_ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(partial_ratio)(a, b)


def token_sort_ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio)(a, b)


def token_set_ratio_col(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio)(a, b)


def best_ratio(a: str, b: str) -> int:
    return max(token_sort_ratio(a, b), partial_ratio(a, b), ratio(a, b))


def best_ratio_col(a: Column, b: Column) -> Column:
    """The best of token order, window and plain ratio."""
    return _pairwise(best_ratio)(a, b)
