"""Line alignment inside one hunk: a shortest edit script, and its blocks with context.

Plain Python over the lines of a single hunk or file section; the operators of
:mod:`quarry.operators.apply` call it in Arrow batches.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict


def common_lines(old: list[str], new: list[str]) -> list[tuple[int, int]]:
    """Longest run of pairs ``(i, j)``, both rising, with ``old[i] == new[j]``.

    Equal ends are paired first.  Between them, the pairs of equal lines are visited by
    rising ``i`` and falling ``j``; the longest rising run of their ``j`` is a longest
    common subsequence.  Among the longest runs the one that ends with the least ``j`` wins.
    """
    lo, hi_old, hi_new = 0, len(old), len(new)
    while lo < min(hi_old, hi_new) and old[lo] == new[lo]:
        lo += 1
    while hi_old > lo and hi_new > lo and old[hi_old - 1] == new[hi_new - 1]:
        hi_old, hi_new = hi_old - 1, hi_new - 1
    where = defaultdict(list)
    for j in range(hi_new - 1, lo - 1, -1):
        where[new[j]].append(j)
    ends: list[int] = []      # least last j of a run of each length
    runs: list[tuple] = []    # (i, j, run one shorter) of that run
    for i in range(lo, hi_old):
        for j in where.get(old[i], ()):
            k = bisect_left(ends, j)
            node = (i, j, runs[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                runs.append(node)
            else:
                ends[k], runs[k] = j, node
    middle, node = [], runs[-1] if runs else None
    while node:
        middle.append(node[:2])
        node = node[2]
    tail = [(hi_old + k, hi_new + k) for k in range(len(old) - hi_old)]
    return [(k, k) for k in range(lo)] + middle[::-1] + tail


def edit_blocks(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """``(i0, i1, j0, j1)``: ``old[i0:i1]`` becomes ``new[j0:j1]``; the blocks between which lines are common."""
    out, i, j = [], 0, 0
    for a, b in [*common_lines(old, new), (len(old), len(new))]:
        if a > i or b > j:
            out.append((i, a, j, b))
        i, j = a + 1, b + 1
    return out


def hunks_of(old: list[str], edits: list[tuple[int, int, list[str]]], context: int) -> list[dict]:
    """Unified hunks of ``edits`` ``(i0, i1, lines put there)``, sorted, over the whole ``old``.

    Positions are 0-based starts in the old and the new text.  Edits whose contexts touch share a hunk.
    """
    out: list[dict] = []
    shift, reach = 0, None
    for i0, i1, put in edits:
        if reach is not None and i0 - reach <= 2 * context:
            hunk = out[-1]
            hunk["lines"] += [" " + x for x in old[reach:i0]]
        else:
            if out:
                _close(out[-1], old, reach, context)
            lo = max(0, i0 - context)
            hunk = {"old": lo, "new": lo + shift, "lines": [" " + x for x in old[lo:i0]]}
            out.append(hunk)
        hunk["lines"] += ["-" + x for x in old[i0:i1]] + ["+" + x for x in put]
        shift += len(put) - (i1 - i0)
        reach = i1
    if out:
        _close(out[-1], old, reach, context)
    return out


def _close(hunk: dict, old: list[str], reach: int, context: int) -> None:
    hunk["lines"] += [" " + x for x in old[reach:reach + context]]


def header(old_start: int, new_start: int, lines: list[str]) -> str:
    """``@@`` line for 0-based starts; an empty range names the line before it, a length of 1 is left out."""
    def part(start, marks):
        n = sum(x[0] in marks for x in lines)
        return f"{start + 1 if n else start}" + ("" if n == 1 else f",{n}")
    return f"@@ -{part(old_start, ' -')} +{part(new_start, ' +')} @@"
