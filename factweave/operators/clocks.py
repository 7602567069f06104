"""Clock and frame graphs. They have tens of nodes and are walked on the driver; the results are applied to columns."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Link:
    """``target = offset + rate * source`` ticks, within ``bound`` ticks, stated or inferred."""

    source: str
    target: str
    offset: Fraction
    rate: Fraction
    bound: Fraction = Fraction(0)
    stated: bool = True

    def back(self) -> Link:
        return Link(self.target, self.source, -self.offset / self.rate, 1 / self.rate, self.bound / abs(self.rate), self.stated)


def path(links: Iterable[Link], source: str, target: str) -> Link | None:
    """The map between two clocks over the fewest links, stated ones first; errors add up along the way."""
    out: dict[str, list[Link]] = {}
    for link in links:
        for x in (link, link.back()):
            out.setdefault(x.source, []).append(x)
    found = {source: Link(source, source, Fraction(0), Fraction(1))}
    queue = deque([source])
    while queue:
        here = found[queue.popleft()]
        for step in sorted(out.get(here.target, ()), key=lambda x: (not x.stated, x.target)):
            if step.target not in found:
                found[step.target] = Link(source, step.target, step.offset + step.rate * here.offset, step.rate * here.rate, abs(step.rate) * here.bound + step.bound, here.stated and step.stated)
                queue.append(step.target)
    return found.get(target)


def aligned(ticks: Column, link: Link) -> Column:
    """Ticks on the other clock, in exact decimals, to the nearest."""
    rate, offset = (F.lit(f"{float(x):.12f}").cast("decimal(38,12)") for x in (link.rate, link.offset))
    return F.round(ticks.cast("decimal(20,0)") * rate + offset).cast("long")


def comparable(edges: Iterable[tuple[str, str]], a: str, b: str, links: Iterable[tuple[str, str]] = ()) -> list[str] | None:
    """Frames from a to b over transforms first, over links only where needed; None if nothing joins them."""
    edges = tuple(edges)
    for more in ((), tuple(links)):
        near: dict[str, set[str]] = {}
        for x, y in (*edges, *more):
            near.setdefault(x, set()).add(y)
            near.setdefault(y, set()).add(x)
        came: dict[str, str | None] = {a: None}
        queue = deque([a])
        while queue:
            here = queue.popleft()
            for step in sorted(near.get(here, ())):
                if step not in came:
                    came[step] = here
                    queue.append(step)
        if b in came:
            out: list[str] = []
            at: str | None = b
            while at is not None:
                out.append(at)
                at = came[at]
            return out[::-1]
    return None
