"""How the columns of table versions relate; schema-sized work on the driver."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass


def inserted(names: list[str], more: Sequence[str]) -> list[str]:
    """``names`` with the unknown ones of ``more``, each behind the known or new one that it follows there."""
    out, at = list(names), 0
    for name in more:
        if name in out:
            at = out.index(name) + 1
        else:
            out.insert(at, name)
            at += 1
    return out


def _kept_order(places: Sequence[int]) -> set[int]:
    """Indices of a longest increasing subsequence of places.

    Of equally long ones, that with more members whose place is their index,
    and of those the one that begins earliest.
    """
    best: list[tuple[int, int, tuple[int, ...]]] = []
    for i in range(len(places) - 1, -1, -1):
        tails = [best[len(places) - 1 - j] for j in range(i + 1, len(places)) if places[j] > places[i]]
        length, fixed, chain = max(tails, key=lambda t: (t[0], t[1], [-c for c in t[2]]), default=(0, 0, ()))
        best.append((length + 1, fixed + (places[i] == i), (i, *chain)))
    return set(max(best, key=lambda t: (t[0], t[1], [-c for c in t[2]]), default=(0, 0, ()))[2])


@dataclass
class ColumnDiff:
    """names: the union layout, primary key first. For each layer (version compared with base): its added
    and removed columns, and moved ones as {index: (before, after)}, either of which is a neighbour's index or -1."""

    names: list[str]
    base: list[str]
    layers: list[list[str]]
    added: list[list[str]]
    removed: list[list[str]]
    moved: list[dict[int, tuple[int, int]]]


def compare_columns(base: Sequence[str], layers: Sequence[Sequence[str]], pk: Sequence[str] = ()) -> ColumnDiff:
    """Layers' columns in their order, base's columns put in where they stood, and pk in front."""
    names: list[str] = []
    for layer in [*layers, base]:
        names = inserted(names, layer)
    moved = [_moves(base, layer, names) for layer in layers]
    front = [c for c in pk if c in names]
    layout = front + [c for c in names if c not in front]
    return ColumnDiff(
        layout,
        list(base),
        [list(x) for x in layers],
        [[c for c in layout if c in x and c not in base] for x in layers],
        [[c for c in layout if c in base and c not in x] for x in layers],
        [{layout.index(names[i]): m for i, m in sorted(each.items())} for each in moved],
    )


def _moves(base: Sequence[str], layer: Sequence[str], names: list[str]) -> dict[int, tuple[int, int]]:
    common = [c for c in names if c in layer and c in base]
    places = [list(base).index(c) for c in common]
    still = _kept_order(places)
    anchors = sorted((places[i], names.index(common[i])) for i in still)
    out = {}
    for i, c in enumerate(common):
        if i not in still:
            before = bisect_left(anchors, (places[i], -1))
            out[names.index(c)] = (-1, anchors[before - 1][1]) if before else (anchors[0][1], -1)
    return out
