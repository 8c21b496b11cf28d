"""Splitting one cell that packs several values.

A cell is first cut into atoms at everything that may separate. Delimiters outside quotes and brackets are hard cuts; a slash with
a blank on one side only and a delimiter in round brackets are soft ones. An Aho-Corasick automaton then finds all known whole values that
begin and end at cuts, and a dynamic program chooses the cheapest cover of the atoms: a known value is cheaper than other text,
whatever delimiters it holds, other text ends at every hard cut and goes on over soft ones.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

#: Characters that separate values wherever they stand outside quotes and round brackets (fixed values).
HARD = ",;|\t\n\r•·"
#: Quote characters and what closes them (fixed values).
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»"}


@lru_cache(maxsize=8)
def _automaton(known: frozenset[str]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for value in sorted(known):
        if value:
            a.add_word(value, len(value))
    if len(a):
        a.make_automaton()
    return a


def lower_alike(text: str) -> str:
    """Lower case of the same length: the few characters whose lower case is longer stay as they are."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def fold(text: str) -> str:
    """Lower case with single blanks, of the same length where nothing is collapsed."""
    return re.sub(r"\s+", " ", lower_alike(text.strip()))


def _quoted(cell: str, i: int) -> int:
    """End (exclusive) of a quoted value that opens at ``i``, or 0 if it isn't one: the closing quote must be followed by a delimiter or the end."""
    close, j, n = QUOTES[cell[i]], i + 1, len(cell)
    while j < n:
        if cell[j] == "\\" and j + 1 < n:
            j += 2
            continue
        if cell[j] == close:
            if j + 1 < n and cell[j + 1] == close and close in "\"'":
                j += 2
                continue
            k = j + 1
            while k < n and cell[k] == " ":
                k += 1
            if k == n or cell[k] in HARD or (cell[k] == "/" and (k + 1 == n or cell[k + 1].isspace())):
                return j + 1
        j += 1
    return 0


def _unquote(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] in QUOTES and text[-1] == QUOTES[text[0]]:
        q, text = text[0], text[1:-1]
        text = text.replace(q * 2, q) if q in "\"'" else text
        text = re.sub(r"\\(.)", r"\1", text)
    return text.strip()


#: Costs of a known value and of other text in the cover: two known values are cheaper than one unknown text over a soft cut.
KNOWN, OTHER = 0.45, 1.0


def _cuts(cell: str) -> list[tuple[int, bool]]:
    """Places of the delimiters and whether they are soft."""
    out, i, n, depth, fresh = [], 0, len(cell), 0, True
    closing = cell.rfind(")")
    while i < n:
        ch = cell[i]
        if fresh and ch in QUOTES and (end := _quoted(cell, i)):
            i, fresh = end, False
            continue
        if ch == "(" and i < closing:
            depth += 1
        elif ch == ")":
            depth = max(0, depth - 1)
        blanks = (i == 0 or cell[i - 1].isspace()) + (i + 1 == n or cell[i + 1].isspace()) if ch == "/" else 0
        if ch in HARD or blanks:
            soft = depth > 0 or blanks == 1
            out.append((i, soft))
            fresh = fresh if soft else True
        elif not ch.isspace():
            fresh = False
        i += 1
    return out


def segment(cell: str | None, known: frozenset[str]) -> list[str]:
    """Values of a cell in the order written, without quotes, escapes and blanks around; none for a null or blank cell.

    ``known`` holds folded whole values. Empty pieces are dropped. A JSON array gives its items.
    """
    if cell is None or not cell.strip():
        return []
    t = cell.strip()
    if t[0] == "[" and t[-1] == "]":
        try:
            items = json.loads(t)
            return [s for s in (str(x).strip() for x in items if x is not None) if s]
        except ValueError:
            t = t[1:-1]
    cuts = _cuts(t)
    if not cuts:
        v = _unquote(t)
        return [v] if v else []
    starts, ends = [0, *(c + 1 for c, _ in cuts)], [*(c for c, _ in cuts), len(t)]
    soft = [False, *(s for _, s in cuts)]  # whether the cut before atom k is soft
    n = len(starts)
    spans: dict[int, list[int]] = {}
    auto, low = _automaton(known), lower_alike(t)
    if len(auto):
        first, last = {}, {}
        for k in range(n):
            piece = t[starts[k] : ends[k]]
            first[starts[k] + len(piece) - len(piece.lstrip())] = k
            last[starts[k] + len(piece.rstrip())] = k
        for at, size in auto.iter(low):
            a, b = first.get(at + 1 - size), last.get(at + 1)
            if a is not None and b is not None and b >= a:
                spans.setdefault(b, []).append(a)
    # best[k]: cheapest cover of the first k atoms and where its last value begins; text: the same if that value isn't a known one
    best: list[tuple[float, int]] = [(0.0, 0)]
    text: list[tuple[float, int]] = [(float("inf"), 0)]
    for k in range(n):
        own = (best[k][0] + (OTHER if t[starts[k] : ends[k]].strip() else 0.0), k)
        text.append(min(own, text[k]) if soft[k] and text[k][0] < float("inf") else own)
        best.append(min([text[-1], *((best[a][0] + KNOWN, a) for a in spans.get(k, ()))]))
    out, k = [], n
    while k:
        a = best[k][1]
        out.append(_unquote(t[starts[a] : ends[k - 1]]))
        k = a
    return [v for v in reversed(out) if v]
