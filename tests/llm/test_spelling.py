"""Words one edit apart, their forms and roots against comparing every pair."""

import random
import re
import zlib
from collections import Counter

import pytest

from gaugeworks.llm import queries, spelling
from tests.llm.test_text_operators import LOWER, frame, invented

SMALL = "/root/testdata/sf0.001"
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] or (len(a) == len(b) and a[k + 1 :] == b[k + 1 :])


def neighbours(words):
    """Near words through the forms with one letter left out (or a place marked)."""
    holders = {}
    for w in words:
        for i in range(len(w) + 1):
            for key in {w[:i] + "*" + w[i + 1 :], w[:i] + "*" + w[i:]}:
                holders.setdefault(key, set()).add(w)
    found = {w: set() for w in words}
    for group in holders.values():
        for a in group:
            found[a] |= {b for b in group if one_edit(a, b)}
    return found


def by_hand(rows):
    counts = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near, form = neighbours(n), {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return found


def columns(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    expected = by_hand([(r.doc_id, r.text) for r in docs])
    assert sum(r[1] is not None for r in expected) > 5
    assert columns(queries.op12_spelling(spark, SMALL)) == expected


def misspelt(seed, n_docs=150):
    """Few letters and many errors: long chains of forms, ties, accents, capitals, and one very frequent start."""
    rng = random.Random(seed)
    edit = lambda w, k: w[:k] + rng.choice(["", rng.choice("abé"), rng.choice("aB×") + w[k]]) + w[k + 1 :]
    stems = ["international", "Aaabbab", "babababé", "ÿabcdefgh", *("".join(rng.choices("ab", k=rng.randint(6, 9))) for _ in range(12))]
    rows = []
    for i in range(n_docs):
        words = rng.choices(stems, weights=[2.0 ** -(k % 9) for k in range(len(stems))], k=60)
        for _ in range(rng.randint(0, 2)):
            words = [edit(w, rng.randrange(len(w))) if rng.random() < 0.06 and w else w for w in words]
        rows.append((i, " 7".join(words) if i % 2 else "-".join(words), "en", "s"))
    rows += rows[:4] + [(None, rows[0][1], "en", "s"), (900, None, "en", "s"), (901, "", "en", "s"), (902, "z" * 2_000 + " " + "z" * 2_001 + "y", None, None)]
    return rows + [rows[-1]] * 3


@pytest.mark.parametrize(("seed", "largest"), [(0, 20_000), (1, 20_000), (2, 6), (3, 2)])
def test_misspelt_words(spark, seed, largest):
    rows = misspelt(seed)
    expected = by_hand([r[:2] for r in rows])
    assert any(r[2] not in (r[0], r[1]) for r in expected) or seed
    assert columns(spelling.variants(frame(spark, rows), largest=largest)) == expected


def test_invented_texts_and_empty_tables(spark):
    rows = invented(5)
    assert columns(spelling.variants(frame(spark, rows))) == by_hand([r[:2] for r in rows])
    assert spelling.variants(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("backward", [False, True])
def test_composition_of_acceptors(backward):
    rng = random.Random(3)
    for _ in range(40):
        words = sorted({"".join(rng.choices("abc", k=rng.randint(1, 6))) for _ in range(rng.randint(1, 90))})
        pairs = {frozenset((words[i], words[j])) for i, j in spelling.near_pairs(words, backward)}
        assert pairs == {frozenset((a, b)) for a in words for b in words if one_edit(a, b)}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("re", "un", "mis", "") for b in ("do", "done", "doing"))
    machine = spelling.Acceptor(words)
    assert machine.count[machine.start] == len(words)
    assert len(machine.arcs) == len({(tuple(sorted((c, to) for c, (to, _) in a.items())), f) for a, f in zip(machine.arcs, machine.final)})
    assert len(machine.arcs) < sum(len(w) for w in words) / 2


def test_very_long_words_take_linear_time():
    pairs = {frozenset(p) for p in spelling.near_pairs(["z" * 50_000, "z" * 50_001, "z" * 25_000 + "y" + "z" * 25_000], True)}
    assert pairs == {frozenset(p) for p in ((0, 1), (0, 2), (1, 2))}
