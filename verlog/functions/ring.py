"""The ring of virtual nodes as plain Python, for replays and for the small tables that plans are built from."""

from __future__ import annotations

import bisect
from typing import NamedTuple

from .collections import OFFSET, PRIME_LOW

WRAP = (1 << 64) - 1
MAX_TOKENS = 100_000


class Node(NamedTuple):
    id: str
    host: str
    port: int
    weight: int = 1
    alive: bool = True

    @property
    def valid(self) -> bool:
        return bool(self.id and self.host and self.port > 0)


def fnv(text: str) -> int:
    h = OFFSET
    for b in text.encode():
        h = ((h ^ b) * ((1 << 40) + PRIME_LOW)) & WRAP
    return h


class Ring:
    """Tokens of the living nodes in the order of their ids; a token that is taken moves up to the next free number."""

    def __init__(self, nodes: list[Node], virtual: int = 8):
        self.nodes = {n.id: n for n in sorted(nodes) if n.valid}
        self.rows: list[tuple[str, int, int]] = []  # id, number, token
        taken: dict[int, str] = {}
        for n in self.nodes.values():
            for i in range(max(1, n.weight) * max(1, virtual) if n.alive else 0):
                if len(taken) >= MAX_TOKENS:
                    raise ValueError("too many tokens")
                token = fnv(f"{n.id}#{i}")
                while token in taken:
                    token = (token + 1) & WRAP
                taken[token] = n.id
                self.rows.append((n.id, i, token))
        self.tokens = sorted(taken)
        self.owners = [taken[t] for t in self.tokens]

    def walk(self, at: int, n: int) -> list[str]:
        """The first n distinct nodes from a place in the order of tokens on."""
        out: list[str] = []
        for k in range(len(self.tokens)):
            owner = self.owners[(at + k) % len(self.tokens)]
            if owner not in out:
                out.append(owner)
                if len(out) == n:
                    break
        return out

    def route(self, key: str, n: int = 1) -> list[str]:
        return self.walk(bisect.bisect_left(self.tokens, fnv(key)), n) if self.tokens else []

    def spans(self, n: int, bits: int = 12) -> list[tuple[int, int, int, list[str]]]:
        """(leading bits, low, high, owners): which hashes, both ends included, go to which first n nodes. A span is
        there once for each value of the leading bits that it reaches over, so keys find theirs by equality."""
        out = []
        low = 0
        for k, t in enumerate([*self.tokens, WRAP]):
            if k == len(self.tokens) and (not self.tokens or low > WRAP or self.tokens[-1] == WRAP):
                break
            for lead in range(low >> (64 - bits), (t >> (64 - bits)) + 1):
                out.append((lead, low, t, self.walk(k % len(self.tokens), n)))
            low = t + 1
        return out
