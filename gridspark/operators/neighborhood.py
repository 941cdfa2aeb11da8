"""Which cells are neighbours."""

from __future__ import annotations

from itertools import product

from gridspark.operators.grid import Grid

#: Most axes along which neighbours of each connectivity differ.
_REACH = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}


def check_connectivity(connectivity: int, grid: Grid, periodic: bool = False, delta: float = 0) -> None:
    if connectivity not in _REACH or (connectivity in (4, 8) and grid.ndim == 3):
        allowed = (4, 8, 6, 18, 26) if grid.ndim < 3 else (6, 18, 26)
        raise ValueError(f"connectivity must be one of {allowed} for rank {grid.ndim}: {connectivity}")
    if periodic and connectivity not in (4, 8, 6):
        raise ValueError("periodic boundaries need connectivity 4, 8 or 6")
    if delta < 0:
        raise ValueError("delta must not be negative")
    if periodic and delta > 0:
        raise ValueError("periodic boundaries and delta exclude each other")


def offsets(connectivity: int, ndim: int) -> list[tuple[int, int, int]]:
    """All neighbour offsets (dx, dy, dz) of a cell, both ways."""
    axes = 2 if connectivity in (4, 8) else ndim
    steps = product((-1, 0, 1), repeat=axes)
    return [(*s, *(0,) * (3 - axes)) for s in steps if 0 < sum(map(abs, s)) <= _REACH[connectivity]]


def half_offsets(connectivity: int, ndim: int) -> list[tuple[int, int, int]]:
    """One offset of each opposite pair: the one that leads back in z, then y, then x."""
    return [o for o in offsets(connectivity, ndim) if o[::-1] < (0, 0, 0)]


def row_offsets(connectivity: int, ndim: int) -> dict[tuple[int, int], int]:
    """(dy, dz) of the rows to look back at, with how far apart in x two touching runs may be there."""
    out: dict[tuple[int, int], int] = {}
    for dx, dy, dz in half_offsets(connectivity, ndim):
        if (dy, dz) != (0, 0):
            out[dy, dz] = max(out.get((dy, dz), 0), abs(dx))
    return out


#: Bits of a connectivity field, lowest first: the direction (dx, dy, dz) that may be passed.
BITS_2D = [(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0)]
BITS_3D = [
    (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1),
    (1, 1, 0), (-1, 1, 0), (1, -1, 0), (-1, -1, 0), (1, 0, 1), (-1, 0, 1), (0, 1, 1), (0, -1, 1), (1, 0, -1), (-1, 0, -1), (0, 1, -1), (0, -1, -1),
    (1, 1, 1), (-1, 1, 1), (1, -1, 1), (-1, -1, 1), (1, 1, -1), (-1, 1, -1), (1, -1, -1), (-1, -1, -1),
]
