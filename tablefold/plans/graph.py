"""The commit graph: metadata, held on the driver as {sum: Commit}."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Commit:
    sum: str
    table: str
    parents: tuple[str, ...] = ()
    time: float = 0.0
    author: str = ""
    email: str = ""
    message: str = ""
    zone: str = "+0000"


def ancestors(commits: Mapping[str, Commit], starts: Iterable[str]) -> set[str]:
    """The commits reachable from starts, themselves included; parents that aren't held are passed over."""
    seen, queue = set(), deque(starts)
    while queue:
        if (at := queue.popleft()) in commits and at not in seen:
            seen.add(at)
            queue.extend(commits[at].parents)
    return seen


def is_ancestor(commits: Mapping[str, Commit], old: str, new: str) -> bool:
    return old in ancestors(commits, commits[new].parents)


def newest_first(commits: Mapping[str, Commit], starts: Iterable[str]) -> Iterator[Commit]:
    """Each reachable commit once, always the newest of those met."""
    heap: list[tuple[float, str]] = []
    seen: set[str] = set()

    def meet(sums: Iterable[str]) -> None:
        for s in sums:
            if s in commits and s not in seen:
                seen.add(s)
                heapq.heappush(heap, (-commits[s].time, s))

    meet(starts)
    while heap:
        at = commits[heapq.heappop(heap)[1]]
        yield at
        meet(at.parents)


def first_parents(commits: Mapping[str, Commit], start: str) -> Iterator[Commit]:
    """A branch's own history."""
    at: str | None = start
    while at in commits:
        yield commits[at]
        at = next(iter(commits[at].parents), None)


def merge_base(commits: Mapping[str, Commit], heads: Iterable[str]) -> str:
    """A nearest commit that all heads have among themselves and their ancestors.

    Of the common ones that no other common one descends from, the newest.
    """
    heads = list(heads)
    common = set.intersection(*(ancestors(commits, [h]) for h in heads))
    if not common:
        raise LookupError("common ancestor commit not found")
    inner = ancestors(commits, [p for c in common for p in commits[c].parents])
    return max(common - inner, key=lambda c: (commits[c].time, c))


def unreachable(commits: Mapping[str, Commit], refs: Mapping[str, str]) -> set[str]:
    return set(commits) - ancestors(commits, refs.values())


def to_send(commits: Mapping[str, Commit], wants: Iterable[str], haves: Iterable[str], depth: int | None = None) -> tuple[list[str], set[str]]:
    """What a receiver with ``haves`` lacks of ``wants``: commits, parents first, and the tables of those at most ``depth`` steps from a want."""
    wants = list(wants)
    known = ancestors(commits, [h for h in haves if h in commits])
    missing = ancestors(commits, wants) - known
    steps = {w: 1 for w in wants}
    queue = deque(wants)
    while queue:
        at = queue.popleft()
        for p in commits[at].parents if at in commits else ():
            if p not in steps:
                steps[p] = steps[at] + 1
                queue.append(p)
    tables = {commits[c].table for c in missing if depth is None or steps[c] <= depth} - {commits[c].table for c in known}
    return parents_first(commits, missing), tables


def without_ancestors(commits: Mapping[str, Commit], queue: Iterable[str], of: Iterable[str]) -> list[str]:
    """A queue without the commits that ``of`` lead to."""
    known = ancestors(commits, of)
    return [s for s in queue if s not in known]


def parents_first(commits: Mapping[str, Commit], some: set[str]) -> list[str]:
    """Each of some commits once, behind all its parents among them."""
    out: list[str] = []
    done: set[str] = set()
    for start in sorted(some):
        stack = [(start, False)]
        while stack:
            at, ready = stack.pop()
            if at in done or at not in some:
                continue
            if ready:
                done.add(at)
                out.append(at)
            else:
                stack += [(at, True), *((p, False) for p in commits[at].parents)]
    return out


def resolve(name: str, refs: Mapping[str, str], commits: Mapping[str, Commit], exclude_tags: bool = False) -> tuple[str, str]:
    """(full ref name or '', sum) of a branch, tag, remote ref or commit sum, with ^ and ~N suffixes.

    A short name is looked up among heads, then tags, remotes, and the rest.
    """
    base, up = name, 0
    if "~" in base:
        base, _, n = base.partition("~")
        up = int(n or 1)
    while base.endswith("^"):
        base, up = base[:-1], up + 1
    order = {"heads": 0, "tags": 1, "remotes": 2}
    names = sorted((r for r in refs if not (exclude_tags and r.startswith("tags/"))), key=lambda r: (order.get(r.split("/")[0], 3), r))
    ref = next((r for r in names if r == base or r.endswith(f"/{base}")), "")
    at = refs[ref] if ref else base
    if at not in commits:
        raise LookupError(f"can't find commit {name!r}")
    for _ in range(up):
        if not commits[at].parents:
            raise LookupError(f"{name!r} leads beyond the first commit")
        at = commits[at].parents[0]
    return ref, at
