"""Merging sorted runs with a tree of losers."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any


def merge(runs: Sequence[Iterable[Any]], key: Callable[[Any], Any]) -> Iterator[Any]:
    """All items of sorted runs in order; equal keys in the order of the runs.

    Inner nodes hold the run that lost there, so an item that leaves costs one comparison per level on the way
    from its leaf to the root.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    if not k:
        return
    items: list[Any] = [None] * k
    keys: list[tuple] = [()] * k

    def advance(run: int) -> None:
        try:
            items[run] = next(sources[run])
            keys[run] = (0, key(items[run]), run)
        except StopIteration:
            items[run], keys[run] = None, (1, run)  # after all others

    for run in range(k):
        advance(run)
    losers = [0] * k
    winners = [0] * k + list(range(k))
    for node in range(k - 1, 0, -1):
        a, b = winners[2 * node], winners[2 * node + 1]
        winners[node], losers[node] = (a, b) if keys[a] < keys[b] else (b, a)
    winner = winners[1]
    while keys[winner][0] == 0:
        yield items[winner]
        advance(winner)
        node = (winner + k) // 2
        while node:
            if keys[losers[node]] < keys[winner]:
                winner, losers[node] = losers[node], winner
            node //= 2
