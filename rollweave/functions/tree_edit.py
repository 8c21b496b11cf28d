"""Edit scripts between two nested schemas.

A schema is a tree of nodes ``(label, type, profile, children)``; the order of siblings doesn't count. The distance is the
unordered tree edit distance in its constrained form: the children of matched nodes are matched one to one by a minimum-cost
assignment, an unmatched subtree is deleted or added as a whole, and a subtree deleted under one parent and added under another
becomes a move when that is cheaper.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field

from rollweave.functions.aliases import plain_key

#: Costs of the script's steps. A rename must be cheaper than a deletion and an addition together.
DELETE = ADD = 1.0
RETYPE = 0.4
MOVE = 0.5
#: Least likeness of two nodes that can be one field under two names.
LIKENESS = 0.5

#: Likeness of two labels as a whole corpus shows it, where it is known.
Known = Mapping[tuple[str, str], float]


@dataclass
class Node:
    label: str
    type: str = ""
    values: int = 0  # bit signature of the words of its values
    children: list[Node] = field(default_factory=list)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)


@dataclass(frozen=True)
class Edit:
    kind: str
    before: str
    after: str


def blend(a: str, b: str, values: float) -> float:
    """Likeness of two labels whose values are alike to a degree: what values don't tell, common words of the labels tell in part."""
    wa, wb = set(plain_key(a).split("_")), set(plain_key(b).split("_"))
    words = len(wa & wb) / max(1, min(len(wa), len(wb)))
    return 1 - (1 - values) * (1 - 0.5 * words)


def likeness(a: Node, b: Node, known: Known | None = None) -> float:
    """How far two nodes look like the same information, from 0 to 1: as ``known``, else by words of the labels and of the values."""
    if a.label == b.label:
        return 1.0
    told = known.get((a.label, b.label)) if known else None
    if told is not None:
        return told
    shared = (a.values & b.values).bit_count()
    return blend(a.label, b.label, shared / math.sqrt(a.values.bit_count() * b.values.bit_count()) if shared else 0.0)


def assign(cost: list[list[float]]) -> list[int]:
    """Minimum-cost assignment of rows to columns of a square matrix (shortest augmenting paths with potentials)."""
    n = len(cost)
    inf = float("inf")
    row_price, col_price, match = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        slack, via, done = [inf] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[j0] = True
            i0, step, j1 = match[j0], inf, 0
            for j in range(1, n + 1):
                if done[j]:
                    continue
                left = cost[i0 - 1][j - 1] - row_price[i0] - col_price[j]
                if left < slack[j]:
                    slack[j], via[j] = left, j0
                if slack[j] < step:
                    step, j1 = slack[j], j
            for j in range(n + 1):
                if done[j]:
                    row_price[match[j]] += step
                    col_price[j] -= step
                else:
                    slack[j] -= step
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[via[j0]]
            j0 = via[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def _match_cost(a: Node, b: Node, known: Known | None) -> float:
    """Cost of keeping ``a`` as ``b``, with what happens below; infinite if they can't be the same field."""
    like = likeness(a, b, known)
    if like < LIKENESS:
        return float("inf")
    own = (0.0 if a.label == b.label else 0.2 + (1 - like)) + (RETYPE if a.type != b.type else 0.0)
    return own + (_forest(a.children, b.children, None)[0] if a.children and b.children else 0.05 * (len(a.children) + len(b.children)))


def _forest(old: list[Node], new: list[Node], known: Known | None) -> tuple[float, list[tuple[Node | None, Node | None]]]:
    """Minimum cost between two sets of siblings and the pairs behind it."""
    same = {b.label: b for b in new}
    kept = [(a, same[a.label]) for a in old if a.label in same]  # a key that stays is the same field
    names = {a.label for a, _ in kept}
    o, n = [a for a in old if a.label not in names], [b for b in new if b.label not in names]
    total, pairs = sum(_match_cost(a, b, known) for a, b in kept), list(kept)
    if not o or not n:
        return total + DELETE * sum(x.size() for x in o) + ADD * sum(x.size() for x in n), pairs + [(a, None) for a in o] + [(None, b) for b in n]
    size, big = len(o) + len(n), 1e9
    cost = [[0.0] * size for _ in range(size)]
    for i in range(size):
        for j in range(size):
            if i < len(o) and j < len(n):
                cost[i][j] = min(big, _match_cost(o[i], n[j], known))
            elif i < len(o):
                cost[i][j] = DELETE * o[i].size() if j - len(n) == i else big
            elif j < len(n):
                cost[i][j] = ADD * n[j].size() if i - len(o) == j else big
    for i, j in enumerate(assign(cost)):
        if i < len(o) and j < len(n):
            pairs.append((o[i], n[j]))
        elif i < len(o):
            pairs.append((o[i], None))
        elif j < len(n):
            pairs.append((None, n[j]))
        total += cost[i][j] if i < len(o) or j < len(n) else 0.0
    return total, pairs


def edit_script(old: list[Node], new: list[Node], deep: bool = False, known: Known | None = None) -> list[Edit]:
    """Steps that turn the fields ``old`` into ``new``, ordered by name.

    Kinds: ``added``, ``removed``, ``renamed``, ``retyped`` and, with ``deep``, ``moved`` for a field that changes its parent; paths
    below the top are only given with ``deep``.
    """
    out: list[Edit] = []
    lost: list[tuple[str, Node]] = []
    found: list[tuple[str, Node]] = []

    def walk(o: list[Node], n: list[Node], path: str) -> None:
        for a, b in _forest(o, n, None if path else known)[1]:
            if a is None:
                found.append((path + b.label, b))
            elif b is None:
                lost.append((path + a.label, a))
            else:
                if a.label != b.label:
                    out.append(Edit("renamed", path + a.label, path + b.label))
                elif a.type and b.type and a.type != b.type:
                    out.append(Edit("retyped", path + a.label, path + b.label))
                if deep and a.children and b.children:
                    walk(a.children, b.children, f"{path}{a.label}.")

    walk(old, new, "")
    if deep:
        below = lambda at, nodes: [(f"{at}.{c.label}", c) for x in nodes for c in x.children]
        spare_new = found + [y for p, x in found for y in below(p, [x])]
        spare_old = lost + [y for p, x in lost for y in below(p, [x])]
        for p, x in list(spare_old):
            hit = next(((q, y) for q, y in spare_new if likeness(x, y) >= LIKENESS and x.type == y.type and p != q), None)
            if hit and x.size() * (DELETE + ADD) > MOVE:
                out.append(Edit("moved", p, hit[0]))
                spare_new.remove(hit)
                lost = [z for z in lost if z[0] != p]
                found = [z for z in found if z[0] != hit[0]]
    out += [Edit("removed", p, "") for p, _ in lost] + [Edit("added", "", p) for p, _ in found]
    return sorted(out, key=lambda e: (e.kind, e.before, e.after))


def parse_type(text: str) -> tuple[str, list[Node]]:
    """JSON type and children of a variant schema such as ``OBJECT<a: BIGINT, b: ARRAY<STRING>>``; an array has the children of its objects."""
    text = text.strip()
    head = re.match(r"[A-Z]+", text)
    word = head[0] if head else ""
    if word == "OBJECT":
        kids, depth, part = [], 0, ""
        for ch in text[len("OBJECT<") : -1] + ",":
            if ch == "," and depth == 0:
                if ":" in part:
                    label, _, kind = part.strip().partition(": ")
                    t, sub = parse_type(kind)
                    kids.append(Node(label.strip("`"), t, children=sub))
                part = ""
                continue
            depth += (ch in "<(") - (ch in ">)")
            part += ch
        return "object", kids
    if word == "ARRAY":
        return "array", parse_type(text[len("ARRAY<") : -1])[1]
    if word == "DECIMAL":
        m = re.match(r"DECIMAL\((\d+),\s*(\d+)\)", text)
        return ("integer" if m and int(m[1]) > 18 and m[2] == "0" else "decimal"), []
    kinds = {"BIGINT": "integer", "INT": "integer", "SMALLINT": "integer", "TINYINT": "integer", "DOUBLE": "decimal", "FLOAT": "decimal", "STRING": "string", "BOOLEAN": "boolean", "ARRAY": "array"}
    return kinds.get(word, ""), []
