"""Fingerprints that share their leading bits: the join splits them and loses no link."""

from __future__ import annotations

import random

import pytest

from aerolake.llm import simhash
from aerolake.llm.components import components


@pytest.mark.parametrize("shared", [0xABCDEF, 0])
def test_hot_prefix_against_all_pairs(spark, shared):
    r = random.Random(shared + 1)
    keys = {(shared << 40) | r.getrandbits(40) for _ in range(300)}
    for k in sorted(keys)[:200]:
        for _ in range(2):
            x = k
            for bit in r.sample(range(64), r.randrange(1, 5)):
                x ^= 1 << bit
            keys.add(x)
    keys = sorted(keys)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    fps = spark.createDataFrame([(signed(k),) for k in keys], "fp long")
    of = {x.node: x.root for x in components(simhash.links(fps, leaves=4)).collect()}
    groups = lambda name: sorted(sorted(g) for g in _by(keys, name).values())
    assert groups(find) == groups(lambda k: of.get(signed(k), signed(k)))


def _by(keys, name):
    out: dict = {}
    for k in keys:
        out.setdefault(name(k), []).append(k)
    return out
