"""Plain versions of what the operators compute, for small tables."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(text):
    out = [(m.start(), 0, "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def secret(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()


def counts(text):
    w = WORD.findall(text)
    seen = Counter(zip(w, w[1:], w[2:]))
    mark = {k + j for k, x in enumerate(zip(w, w[1:], w[2:])) if seen[x] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(mark)


def near(texts):
    """Number of links and the members of the class, by position."""
    sets = []
    for t in texts:
        w = WORD.findall(t or "")
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    n = len(sets)
    linked = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9] for i in range(n)]
    out = []
    for i in range(n):
        reached, todo = {i}, [i]
        while todo:
            for j in linked[todo.pop()]:
                if j not in reached:
                    reached.add(j)
                    todo.append(j)
        out.append((len(linked[i]), reached))
    return out


def shares(sizes):
    """Targets of sources (name: words) in the order of their names, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight, total, capped = {s: k % 3 + 1 for k, s in enumerate(names)}, sum(sizes.values()), set()
    while True:
        left, w = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else left * weight[s] / w for s in names}
        more = {s for s in names if s not in capped and t[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return t
        capped |= more
