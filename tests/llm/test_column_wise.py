from __future__ import annotations

import random

import numpy as np

from crosspanel.llm.column_wise import build, equal_strings
from crosspanel.llm.repeated_spans import COLLECTION, _collections


def common_prefix(a, b):
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def test_order_and_common_prefixes_match_a_sort_of_all_suffixes():
    rng = random.Random(1)
    for _ in range(300):
        strings = [bytes(rng.choice(b"ab\x00\xff"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(1, 12))]
        size = np.array([len(s) for s in strings])
        found = build(np.frombuffer(b"".join(strings), np.uint8), size)
        got = [strings[s][len(strings[s]) - n :] for s, n in zip(found.string.tolist(), found.length.tolist(), strict=True)]
        assert got == sorted(s[k:] for s in strings for k in range(len(s) + 1))
        assert found.common.tolist() == [0] + [common_prefix(a, b) for a, b in zip(got, got[1:])]  # noqa: B905
        for length in (1, 2, 3):
            string, start, group = equal_strings(found, size, length)
            assert sorted(zip(string.tolist(), start.tolist(), strict=True)) == [(i, k) for i, s in enumerate(strings) for k in range(len(s) - length + 1)]
            of: dict[bytes, set[int]] = {}
            for i, k, g in zip(string.tolist(), start.tolist(), group.tolist(), strict=True):
                of.setdefault(strings[i][k : k + length], set()).add(g)
            assert all(len(g) == 1 for g in of.values()) and len(set().union(*of.values())) == len(of)


def test_no_strings():
    found = build(np.zeros(0, np.uint8), np.zeros(0, np.int64))
    assert len(found.string) == 0 and len(equal_strings(found, np.zeros(0, np.int64), 100)[0]) == 0


def test_collections_keep_anchors_together():
    rng = np.random.default_rng(2)
    for n in (0, 1, 50, 4000):
        anchor = rng.integers(0, max(1, n // 3), n).astype(np.uint64)
        anchor[: n // 5] = 7
        size = rng.integers(100, 161, n)
        groups = list(_collections(anchor, size))
        assert sorted(np.concatenate([*groups, np.zeros(0, int)]).astype(int).tolist()) == list(range(n))
        seen = [set(anchor[g].tolist()) for g in groups]
        assert sum(map(len, seen)) == len(set(anchor.tolist()))
        largest = max([int(size[anchor == a].sum()) for a in set(anchor.tolist())], default=0)
        assert all(size[g].sum() <= 2 * COLLECTION + largest for g in groups)
