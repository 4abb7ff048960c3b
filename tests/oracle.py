"""Plain restatements of the rules for small fixtures."""

import math


def _angle(s):
    return math.degrees(math.atan2(s[3] - s[1], s[2] - s[0])) % 180


def _length(s):
    return math.sqrt((s[2] - s[0]) ** 2 + (s[3] - s[1]) ** 2)


def _unit(s):
    size = _length(s)
    return ((s[2] - s[0]) / size, (s[3] - s[1]) / size) if size > 1e-9 else (1.0, 0.0)


def _gap(a, b):
    d = abs(_angle(a) - _angle(b))
    return min(d, 180 - d)


def candidates(lines):
    """(i, j, distance) of all pairs inside the tolerances; ``lines`` are (x1, y1, x2, y2)."""
    found = []
    for i, a in enumerate(lines):
        ux, uy = _unit(a)
        for j in range(i + 1, len(lines)):
            b = lines[j]
            bucket = int(_angle(b) / 5)
            if int(_angle(a) / 5) not in (bucket, (bucket + 1) % 36) or _gap(a, b) > 5:
                continue
            mx = (b[0] + b[2]) / 2 - (a[0] + a[2]) / 2
            my = (b[1] + b[3]) / 2 - (a[1] + a[3]) / 2
            distance = abs(mx * -uy + my * ux)
            if not 0.01 <= distance <= 0.8:
                continue
            span = sorted((0.0, (a[2] - a[0]) * ux + (a[3] - a[1]) * uy))
            other = sorted(
                ((b[0] - a[0]) * ux + (b[1] - a[1]) * uy, (b[2] - a[0]) * ux + (b[3] - a[1]) * uy)
            )
            if span[1] + 0.3 >= other[0] and other[1] + 0.3 >= span[0]:
                found.append((i, j, distance))
    return found


def greedy(pairs):
    used, taken = set(), set()
    for i, d, j in sorted((i, d, j) for i, j, d in pairs):
        if i not in used and j not in used:
            used |= {i, j}
            taken.add((i, j))
    return taken


def chains(lines):
    """(seed, x1, y1, x2, y2) of joined fragments."""
    used, found = set(), []
    for seed, s in enumerate(lines):
        if seed in used:
            continue
        used.add(seed)
        tail, tip = s, s[2:]
        while True:
            for n, t in enumerate(lines):
                if n in used or _gap(tail, t) > 5:
                    continue
                ux, uy = _unit(tail)
                mx = (t[0] + t[2] - tail[0] - tail[2]) / 2
                my = (t[1] + t[3] - tail[1] - tail[3]) / 2
                to_start, to_end = math.dist(tip, t[:2]), math.dist(tip, t[2:])
                if abs(my * ux - mx * uy) > 0.015 or min(to_start, to_end) > 0.5:
                    continue
                used.add(n)
                tail, tip = t, (t[:2] if to_end < to_start else t[2:])
                break
            else:
                break
        if math.dist(s[:2], tip) > 1e-6:
            found.append((seed, *s[:2], *tip))
    return found
