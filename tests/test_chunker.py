"""Chunks cover a text once, follow definitions, and go into large ones."""

import random

from corvid.sources import chunker


def test_large_definitions_are_cut_at_their_members():
    line = "x" * 50
    body = [line] * 10
    source = "\n".join(["import a", "class A:", *body, *body, *body, "tail"]) + "\n"  # 500 characters a member
    units = [(2, 32), (3, 12), (13, 22), (23, 32)]
    assert chunker.around(source, units, 600) == [(1, 12), (13, 22), (23, 33)]
    assert chunker.around(source, units, 1100) == [(1, 22), (23, 33)]


def test_chunks_cover_every_line_once():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(1, 60)
        source = "\n".join("y" * rng.randrange(1, 40) for _ in range(n)) + "\n" * rng.randrange(2)
        units = []
        for _ in range(rng.randrange(8)):
            a = rng.randrange(1, n + 1)
            units.append((a, rng.randrange(a, n + 1)))
        got = chunker.around(source, units, 100)
        assert [x for a, b in got for x in range(a, b + 1)] == list(range(1, n + 1))
        assert all(sum(map(chunker.weight, source.split("\n")[a - 1 : b])) + sum(map(chunker.weight, source.split("\n")[c - 1 : d])) > 100 for (a, b), (c, d) in zip(got, got[1:]))
