"""Brute-force interval operators on lists of (id, chrom, start, end, strand)."""

from collections import Counter


def hit(a, b):
    return a[1] == b[1] and a[2] < b[3] and b[2] < a[3]


def segments(a, rows):
    """(cs, ce) of the rows that overlap ``a``, cut to it."""
    return [(max(a[2], b[2]), min(a[3], b[3])) for b in rows if hit(a, b)]


def merge(rows, d=0):
    out = []
    for chrom in sorted({r[1] for r in rows}):
        cur = None
        for s, e in sorted((r[2], r[3]) for r in rows if r[1] == chrom):
            if cur and s <= cur[2] + d:
                cur[2] = max(cur[2], e)
                cur[3] += 1
            else:
                cur = [chrom, s, e, 1]
                out.append(cur)
    return [tuple(x) for x in out]


def subtract(a, b):
    out = []
    for x in a:
        cuts = sorted(segments(x, b))
        if not cuts:
            out.append((x[0], x[2], x[3]))
            continue
        at = x[2]
        for s, e in cuts:
            if at < s:
                out.append((x[0], at, s))
            at = max(at, e)
        if at < x[3]:
            out.append((x[0], at, x[3]))
    return out


def depth(rows, chrom, size):
    d = [0] * size
    for r in rows:
        if r[1] == chrom:
            for p in range(min(r[2], size), min(r[3], size)):
                d[p] += 1
    return d


def closest(a, b, io=False, iu=False, id_=False, most=None):
    out = []
    for x in a:
        found = []
        for y in b:
            if x[1] != y[1]:
                continue
            s = 0 if hit(x, y) else -(x[2] - y[3] + 1) if y[3] <= x[2] else y[2] - x[3] + 1
            if (io and s == 0) or (iu and s < 0) or (id_ and s > 0) or (most is not None and abs(s) > most):
                continue
            found.append((abs(s), y[0]))
        best = min((f[0] for f in found), default=None)
        out += [(x[0], y, best) for d, y in found if d == best] if found else [(x[0], None, -1)]
    return out


def coverage(a, b):
    out = []
    for x in a:
        cuts, n = segments(x, b), x[3] - x[2]
        covered = len({p for s, e in cuts for p in range(s, e)})
        out.append((x[0], len(cuts) if n else 0, covered if n else 0, n))
    return out


def histogram(a, b):
    out = Counter()
    for x in a:
        if x[2] == x[3]:
            out[x[0], 0] = 0
        cuts = segments(x, b)
        for p in range(x[2], x[3]):
            out[x[0], sum(s <= p < e for s, e in cuts)] += 1
    return {k: v for k, v in out.items()}
