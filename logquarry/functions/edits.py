"""The shortest way from one short list to another, by Myers' algorithm."""

from __future__ import annotations


def edit_script(a: list, b: list, most: int) -> list[tuple[str, int, int]] | None:
    """(kind, lines of ``a`` and of ``b`` used so far) with the fewest changes; None if these are more than ``most``.

    The furthest point on each diagonal keeps the trail that led there: its change, and the trail before that.
    """
    front: dict[int, tuple[int, tuple | None]] = {}
    for changes in range(min(most, len(a) + len(b)) + 1):
        reached: dict[int, tuple[int, tuple | None]] = {}
        for k in range(-changes, changes + 1, 2):
            over, under = front.get(k - 1), front.get(k + 1)
            if not changes:
                x, trail = 0, None
            elif under and (not over or over[0] < under[0]):
                x, trail = under[0], ("add", under[0], under[0] - k, under[1])
            elif over:
                x, trail = over[0] + 1, ("del", over[0] + 1, over[0] + 1 - k, over[1])
            else:
                continue
            y = x - k
            if x > len(a) or y > len(b):
                continue
            while x < len(a) and y < len(b) and a[x] == b[y]:
                x, y = x + 1, y + 1
            if x == len(a) and y == len(b):
                return _unrolled(trail, x, y)
            reached[k] = (x, trail)
        front = reached
    return None


def _unrolled(trail: tuple | None, x: int, y: int) -> list[tuple[str, int, int]]:
    out: list[tuple[str, int, int]] = []
    while trail:
        kind, at_x, at_y, trail = trail
        out += [("same", x - i, y - i) for i in range(x - at_x)]
        out.append((kind, at_x, at_y))
        x, y = at_x - (kind == "del"), at_y - (kind == "add")
    out += [("same", x - i, y - i) for i in range(x)]
    return out[::-1]


def compared(a: list, b: list, most: int) -> tuple[list[tuple[str, int, int]], bool]:
    """The edit script of two short lists, and whether it is only an approximation."""
    start = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    rest = min(len(a), len(b)) - start
    end = next((i for i in range(rest) if a[-1 - i] != b[-1 - i]), rest)
    n, m = len(a) - end, len(b) - end
    inner = edit_script(a[start:n], b[start:m], most)
    rough = inner is None
    if rough:
        inner = [("del", i + 1, 0) for i in range(n - start)] + [("add", n - start, i + 1) for i in range(m - start)]
    same = [("same", i + 1, i + 1) for i in range(start)]
    tail = [("same", n + i + 1, m + i + 1) for i in range(end)]
    return [*same, *[(kind, x + start, y + start) for kind, x, y in inner], *tail], rough
