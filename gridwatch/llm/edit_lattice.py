"""The edit lattice of a conversation: cheapest edits that make its roles a chat, by bidirectional Dijkstra.

A node is a number of rows consumed and a state: nothing said yet (0), a system turn (1), a user turn (2), an
assistant turn (3). Rows are kept (``K``, 0), given the other role (``R``, 1) or deleted (``D``, 2), and empty turns are inserted
(``I``, 5). Blank rows and repeats must go; a truncated row that stays costs 5 more. The roles that are left
read ``(s?(ua)+)?``, so from each state only one role can follow a change, and an audit (the edits' initials) names one path.
"""

from __future__ import annotations

import heapq

WHITE = " \t\n\v\f\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: Costs of the edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Role that a changed or inserted turn takes after each state, and states by the role's initial.
NEXT = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATES = {"s": 1, "u": 2, "a": 3}
ENDS = (0, 3)
LEGAL = {"su", "ua", "au"}

Cell = tuple[str, int]
Found = tuple[int, str]


def fault(text: str) -> int:
    """Blank, truncated or fine; whether the row repeats an earlier one is told apart elsewhere."""
    said = text.rstrip(WHITE)
    return BLANK if not said else FINE if said[-1] in ".!?" else TRUNCATED


def kept_as(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, or None where the role can't stand there."""
    to = STATES.get(initial)
    if to is None or (to == 1 and state != 0) or (to == 2 and state == 2) or (to == 3 and state != 2):
        return None
    return to


def moves(cell: Cell, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row: initial, cost and state after it."""
    initial, kind = cell
    out = [("D", DELETE, state)]
    if kind not in (BLANK, DUPLICATE):
        more = CUT_OFF if kind == TRUNCATED else 0
        to = kept_as(state, initial)
        if to is not None:
            out.append(("K", more, to))
        out.append(("R", REROLE + more, STATES[NEXT[state][0]]))
    return out


class _Side:
    """One heap of the search. Nodes of equal cost leave it in the order of their rows, so that an audit is final when its node leaves."""

    def __init__(self, nodes: list[tuple[int, int]]):
        self.found: dict[tuple[int, int], Found] = dict.fromkeys(nodes, (0, ""))
        self.heap = [(0, 0, n) for n in nodes]
        self.closed: set[tuple[int, int]] = set()

    def top(self) -> int | None:
        while self.heap and self.heap[0][2] in self.closed:
            heapq.heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def offer(self, node: tuple[int, int], place: int, value: Found) -> bool:
        old = self.found.get(node)
        if node in self.closed or (old is not None and old <= value):
            return False
        self.found[node] = value
        heapq.heappush(self.heap, (value[0], place, node))
        return True


def search(cells: list[Cell], start: int = 0, ends: tuple[int, ...] = ENDS) -> tuple[int, str] | None:
    """Least cost from ``start`` before the first row to one of ``ends`` after the last, and the ASCII-least audit of that cost."""
    n = len(cells)
    ahead, back = _Side([(0, start)]), _Side([(n, q) for q in ends])
    into: list[dict[int, list[tuple[str, int, int]]]] = [{} for _ in cells]  # edits of a row by the state after it
    for i, cell in enumerate(cells):
        for q in range(4):
            for edit, cost, to in moves(cell, q):
                into[i].setdefault(to, []).append((edit, cost, q))
    best = 0 if start in ends and not n else None
    while True:
        f, b = ahead.top(), back.top()
        if f is None or b is None or (best is not None and f + b > best):
            break
        side, other = (ahead, back) if f <= b else (back, ahead)
        cost, _, node = heapq.heappop(side.heap)
        side.closed.add(node)
        (i, q), (_, audit) = node, side.found[node]
        reached = []
        if side is ahead:
            reached += [((i + 1, to), i + 1, (cost + c, audit + e)) for e, c, to in (moves(cells[i], q) if i < n else [])]
            reached.append(((i, STATES[NEXT[q][0]]), i, (cost + INSERT, audit + "I")))
        else:
            reached += [((i - 1, p), n - i + 1, (cost + c, e + audit)) for e, c, p in (into[i - 1].get(q, []) if i else [])]
            reached += [((i, p), n - i, (cost + INSERT, "I" + audit)) for p in range(4) if STATES[NEXT[p][0]] == q]
        for to, place, value in reached:
            if side.offer(to, place, value) and to in other.found:
                total = value[0] + other.found[to][0]
                best = total if best is None else min(best, total)
    if best is None:
        return None
    both = ((ahead.found[x], back.found[x]) for x in ahead.found.keys() & back.found.keys())
    return best, min(x[1] + y[1] for x, y in both if x[0] + y[0] == best)


def edited(turns: list[tuple[str, str]], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """(role, text) after the edits of ``audit``."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role, text = turns[i] if edit != "I" else ("", "")
        i += edit != "I"
        if edit != "K":
            role = NEXT[state]
        state = STATES[role[0]]
        out.append((role, text))
    return out


def summary(cells: list[Cell]) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit) of a block of rows, for every two states that edits can join."""
    out = []
    for p in range(4):
        for q in range(4):
            found = search(cells, p, (q,))
            if found:
                out.append((p, q, *found))
    return out
