"""Auction shortest paths on a layered lattice of four states with integer costs.

A layer lists, for each state, its arcs (mark, step, cost): ``step`` leads from node 4 * layer + state to a state of the same
or the next layer. Prices never exceed cost + price of any arc's end. The path starts at its origin and ends in its terminal
node: if the terminal's price is below the cheapest arc it rises to that and the path contracts by a node, else the path extends along the
first arc that is tight. Prices only rise and arcs are tried in the order of their marks, so an arc that was passed over
cannot be on a shortest path, and the path that reaches the last layer is the least of all shortest paths by its marks.

Layers are settled in windows from the last to the first: the prices at a window's end are exact, so a contraction never
leaves its window and the work grows with the number of layers.
"""

from __future__ import annotations

INF, WINDOW = float("inf"), 32


def _run(layers: list, price: list, lo: int, hi: int, state: int) -> tuple[list, int]:
    """Marks of the path from (lo, state) to layer hi, and its last state; the origin can reach layer hi."""
    path, marks = [4 * lo + state], []
    while path[-1] < 4 * hi:
        at = path[-1]
        best, to, mark = INF, at, None
        for m, step, cost in layers[at >> 2][at & 3]:
            if cost + price[at + step] < best:
                best, to, mark = cost + price[at + step], at + step, m
        if price[at] < best:
            price[at] = best
            if len(path) > 1:
                path.pop()
                marks.pop()
        else:
            path.append(to)
            marks.append(mark)
    return marks, path[-1] & 3


def _windows(n: int, size: int = WINDOW) -> list[tuple[int, int]]:
    return [(lo, min(lo + size, n)) for lo in range(0, n, size)]


def prices(layers: list, exits: list, window: int = WINDOW) -> list:
    """Prices of all nodes, exact at the borders of windows: entry state s costs price[s]. ``exits``: prices past the last layer, some finite."""
    n = len(layers)
    price = [0] * (4 * n) + list(exits)
    dead = [False] * (4 * n) + [x == INF for x in exits]
    for lo, hi in reversed(_windows(n, window)):
        low = min(price[4 * hi:4 * hi + 4])
        for i in reversed(range(lo, hi)):
            low += _least(layers[i])
            price[4 * i:4 * i + 4] = [low] * 4
            if any(dead[4 * i + 4:4 * i + 8]):
                dead[4 * i:4 * i + 4] = [True] * 4
                for _ in range(4):  # arcs inside a layer chain at most three times
                    for s in range(4):
                        dead[4 * i + s] = all(dead[4 * i + s + step] for _, step, _ in layers[i][s])
                for s in range(4):
                    if dead[4 * i + s]:
                        price[4 * i + s] = INF
        for s in range(4):
            if not dead[4 * lo + s]:
                _run(layers, price, lo, hi, s)
    return price


def _least(layer: list) -> int:
    """The cheapest way on from any state of a layer."""
    return min(c for s, arcs in enumerate(layer) for _, step, c in arcs if s + step > 3)


def trace(layers: list, price: list, state: int) -> tuple[list, int]:
    """Marks of the least shortest path from an entry state, and its exit state."""
    marks = []
    for lo, hi in _windows(len(layers)):
        m, state = _run(layers, price, lo, hi, state)
        marks += m
    return marks, state
