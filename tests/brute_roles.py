"""The role matchers once more, by tables and loops over plain Python, for the values that queries are held against."""

import re

from spindrift.operators import roles as R


def common(a, b):
    """The longest common subsequence, by the table."""
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


def ratio(a, b):
    return round(200 * common(a, b) / (len(a) + len(b))) if a or b else 100


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 0 if b else 100
    whole = [b[i : i + len(a)] for i in range(len(b) - len(a) + 1)]
    ends = [b[:i] for i in range(1, len(a))] + [b[-i:] for i in range(1, len(a))]
    return max(ratio(a, x) for x in whole + ends)


def words(s):
    return sorted(re.findall(r"[^\W_]+", s.lower()))


def token_sort(a, b):
    return ratio(" ".join(words(a)), " ".join(words(b)))


def token_set(a, b):
    x, y = set(words(a)), set(words(b))
    both, ab, ba = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if not x or not y:
        return 0
    if both and (not ab or not ba):
        return 100
    one, two = " ".join(filter(None, (both, ab))), " ".join(filter(None, (both, ba)))
    return max(ratio(one, two), ratio(both, one) if both else 0, ratio(both, two) if both else 0)


def match_role(normalized, excluded, modifier, law, least=70):
    """(role, score, points, others) of a normalised title."""
    title = " ".join((normalized or "").split()).lower()
    found = []
    for at, name in enumerate(R.LAW_ROLES if law else R.PARALEGAL_ROLES):
        role = name.lower()
        score = max(token_sort(title, role), partial(title, role), ratio(title, role))
        shared = (set(title.split()) & set(role.split())) - set(R.GENERIC)
        score = min(100, score + min(10, 5 * len(shared)))
        if "professor" in title.split() and "professor" not in role.split() and not any(w in role for w in ("faculty", "academic", "dean")):
            score = max(0, score - 20)
        if any(k in role and not any(w in title for w in need) for k, need in R.SPECIFIC.items()):
            score = max(0, score - 25)
        if score >= least:
            found.append((-score, at, name))
    if excluded or not title or not found:
        return None, 0, 0, ""
    found.sort()
    best = -found[0][0]
    points = next(p for s, p in ((90, 20), (85, 17), (80, 14), (75, 11), (70, 8)) if best >= s)
    return found[0][2], best, max(0, min(20, points + modifier)), "|".join(n for _, _, n in found[1:])


def plain(s):
    return re.sub(r"[^\w\s&/-]", "", re.sub(r"\s+", " ", (s or "").lower())).strip()


def match_target(title, law, least=65):
    """(role, score, kind, why) of the second matcher."""
    t, best = plain(title), (None, 0, None, None)
    for role, (synonyms, keywords, context) in (R.LAW_TARGETS if law else R.PARALEGAL_TARGETS).items():
        known, syn = plain(role), [plain(s) for s in synonyms]
        near = max((token_set(t, s), -i, s) for i, s in enumerate(syn))
        has, also = [k for k in map(plain, keywords) if k in t], [k for k in map(plain, context) if k in t]
        if t == known:
            got = 100, "Exact", f"Exact match: '{role}'"
        elif t in syn:
            got = 95, "Exact Synonym", f"Exact synonym: '{t}'"
        elif (p := token_set(t, known)) >= 90:
            got = p, "Fuzzy Primary", f"Strong fuzzy match: {p}% similar to '{role}'"
        elif near[0] >= 85:
            got = near[0] - 2, "Fuzzy Synonym", f"Fuzzy synonym match: {near[0]}% similar to '{near[2]}'"
        elif has and also:
            got = min(80, 65 + 5 * len(has) + 3 * len(also)), "Context", f"Context match: keywords={has}, context={also}"
        else:
            continue
        if t and got[0] >= least and got[0] > best[1]:
            best = role, *got
    return best
