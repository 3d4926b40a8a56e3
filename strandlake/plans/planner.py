"""From a search scheme to seeds: what a hit must share with a query exactly."""

from __future__ import annotations

from .schemes import Scheme, is_complete, is_valid


def seed_regions(scheme: Scheme) -> tuple[list[tuple[int, int]], int]:
    """(regions of parts [a, b) that a search wants free of errors, number of parts).

    A complete scheme covers every distribution of errors by some search, whose first parts are free of errors as far as
    its upper bounds are 0; so every hit shares the whole region of one of its searches. Raises ValueError where a search
    has no such part: it can't be found by a join.
    """
    if not is_valid(scheme):
        raise ValueError("the scheme is not valid")
    out = []
    for s in scheme:
        free = [p for p, u in zip(s.pi, s.u) if u == 0]
        if not free:
            raise ValueError("a search of the scheme has no part that is free of errors")
        out.append((min(free), max(free) + 1))
    return sorted(set(out)), len(scheme[0].pi)


def usable(scheme: Scheme, max_k: int) -> bool:
    """Whether joins on the scheme's seeds find every hit of up to max_k errors."""
    return is_valid(scheme) and is_complete(scheme, 0, max_k) and all(s.u[0] == 0 for s in scheme)
