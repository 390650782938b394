"""Product codes against plain loops, and the search against measuring every entry."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from gaugeworks.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, id int, error string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def by_hand(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = max(1, -(-max((len(r[1]) for r in kept), default=0) // parts))
    whole = []
    for _, vector, _ in kept:
        own = [math.floor(256 * float(np.float32(x))) for x in vector] + [0] * (width * parts)
        whole.append([own[p * width : (p + 1) * width] for p in range(parts)])
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, [np.float32(x) for x in kept[k][1]]))
    books = [[whole[k][p] for k in order[:entries]] for p in range(parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, x: min((gap(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            own = defaultdict(list)
            for w in whole:
                own[nearest(p, w[p])[1]].append(w[p])
            for e, xs in own.items():
                new[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
        books = new
    found = [[nearest(p, w[p]) for p in range(parts)] for w in whole]
    totals = Counter()
    for (_, _, label), f in zip(kept, found):
        totals[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return Counter(
        (r[0], "".join(f"{e:02x}" for _, e in f), sum(d for d, _ in f), totals[r[2]], sha) for r, f in zip(kept, found)
    )


def columns(df):
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return Counter(map(tuple, df.collect()))


@pytest.mark.parametrize(("seed", "n", "dims"), [(0, 150, 64), (1, 40, 16), (2, 90, 50), (3, 1, 32), (4, 80, 0)])
def test_codes_against_plain_loops(spark, seed, n, dims):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, rng.choice([0.1, 3])) for _ in range(dims)], rng.choice([0, 0, 1, None])) for i in range(n)]
    rows += [(r[0], list(r[1]), r[2]) for r in rows[:5]] + [(n + i, list(rows[0][1]), 3) for i in range(20)]
    rows += [(None, [0.5] * dims, 1), (900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 3, 1), (903, [float("inf")], None)]
    rng.shuffle(rows)
    assert columns(vector_codes.compress(frame(spark, rows).repartition(5))) == by_hand(rows)


def test_short_vectors_are_filled_up_and_large_components_bounded(spark):
    rows = [(1, [1.0] * 16, 1), (2, [-1.0] * 3, 1), (3, [], None)]
    assert columns(vector_codes.compress(frame(spark, rows))) == by_hand(rows)
    found = vector_codes.compress(frame(spark, [(1, [3e38] * 64, 1), (2, [-3e38] * 64, 1)]), entries=1, rounds=0).collect()
    assert {r.vec_id: r.error for r in found} == {1: 0, 2: 64 * (2 * (1 << 26)) ** 2}


def test_empty_tables(spark):
    assert vector_codes.compress(frame(spark, [(1, [1.0], 1)]).limit(0)).count() == 0
    assert vector_codes.compress(frame(spark, [(1, None, 1)])).count() == 0


def test_search_is_exact_and_leaves_entries_out():
    rng = np.random.default_rng(5)
    for width in (1, 2, 4, 9):
        entries = rng.integers(-40, 40, (64, width))
        entries[40:50] = entries[3]  # ties
        book = vector_codes.Codebook(entries)
        x = rng.integers(-60, 60, (500, width))
        found, best = book.nearest(x)
        gaps = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (best == gaps.min(axis=1)).all() and (found == gaps.argmin(axis=1)).all()
        assert book.examined < (0.7 if width < 5 else 1) * 64 * 500
