"""Cutting files into chunks of whole lines, by a budget of characters that aren't white space."""

from __future__ import annotations

#: Characters a chunk may hold, and the version of this rule; files cut by another version are cut again.
BUDGET, VERSION = 1500, 3


def weight(line: str) -> int:
    return sum(not c.isspace() for c in line)


def windows(source: str, budget: int = BUDGET) -> list[tuple[int, int]]:
    """Windows (first line, last line, from 1) that cover a text, without overlap.

    A window takes at least two lines where there are, and ends with the line that crosses the budget.
    """
    sizes = [weight(x) for x in source.split("\n")]
    if source.endswith("\n") or not source:
        sizes.pop()
    out, first, used = [], 0, 0
    for i, n in enumerate(sizes):
        if i - first >= 2 and used > budget:  # the line before crossed it
            out.append((first + 1, i))
            first, used = i, 0
        used += n
    if sizes:
        out.append((first + 1, len(sizes)))
    return out


def around(source: str, units: list[tuple[int, int]], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Chunks that follow definitions (their first and last lines, nested or not), without overlap and without a gap.

    Neighbours lie together while they fit.  A definition over the budget is cut at the definitions in it, one without any
    by windows; what lies between definitions belongs to the one after it, as far as that isn't cut.  Blank chunks go.
    """
    lines = source.split("\n")
    if source.endswith("\n"):
        lines.pop()
    upto = [0]
    for x in lines:
        upto.append(upto[-1] + weight(x))
    size = lambda a, b: upto[b] - upto[a - 1]
    pieces: list[tuple[int, int]] = []
    todo = [(1, len(lines), sorted({u for u in units if 1 <= u[0] <= u[1] <= len(lines)}, key=lambda u: (u[0], -u[1])))]
    while todo:  # ranges of lines with the definitions in them, the next one last
        a, b, inside = todo.pop()
        if a > b:
            continue
        inside = [u for u in inside if u != (a, b)]
        if size(a, b) <= budget:
            pieces.append((a, b))
        elif not inside:
            pieces += [(a + x - 1, a + y - 1) for x, y in windows("\n".join(lines[a - 1 : b]) + "\n", budget)]
        else:
            parts, at, k = [], a, 0
            while k < len(inside):
                first, last = inside[k]
                n = k + 1
                while n < len(inside) and inside[n][0] <= last:
                    last = max(last, inside[n][1])  # definitions that begin in one another's lines stay together
                    n += 1
                if size(at, last) <= budget or (first, last) == (a, b):  # all in one another's lines: by windows
                    parts.append((at, last, []))
                else:
                    parts += [(at, first - 1, []), (first, last, inside[k:n])]
                at, k = last + 1, n
            todo += reversed([*parts, (at, b, [])])
    out: list[tuple[int, int]] = []
    for a, b in pieces:
        if out and size(out[-1][0], b) <= budget:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return [(a, b) for a, b in out if size(a, b)]
