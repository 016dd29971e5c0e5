"""Named places at which tests make the driver's side of a change fail, to see that nothing half done is left."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

#: where a failure can be planted
POINTS = ("store.write", "store.written", "store.checked", "store.swap", "checkpoint.write", "checkpoint.written", "vacuum.delete")
_armed: set[str] = set()


class Planted(RuntimeError):
    pass


@contextlib.contextmanager
def armed(*points: str) -> Iterator[None]:
    """Within, reaching one of the points fails."""
    unknown = set(points) - set(POINTS)
    if unknown:
        raise ValueError(f"no such point: {sorted(unknown)}")
    before = set(_armed)
    _armed.update(points)
    try:
        yield
    finally:
        _armed.clear()
        _armed.update(before)


def reach(point: str) -> None:
    if point in _armed:
        raise Planted(point)
