"""Fingerprints, edited texts and the search within a radius against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
import xxhash

from gaugeworks.llm import queries, simhash
from tests.llm.test_text_operators import frame, invented

SPACE = re.compile(r"[\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


def print_by_hand(text):
    words = [w for w in SPACE.split(text or "") if w]
    terms = [" ".join(words[i : i + 2]) for i in range(len(words) - 1)] or words
    votes = [0] * 128
    for term in terms:
        raw = term.encode()
        halves = xxhash.xxh64_intdigest(raw, 42), xxhash.xxh64_intdigest(raw, xxhash.xxh64_intdigest(b"second", 42))
        weight = min(len(term), 16)
        for i in range(128):
            votes[i] += weight if halves[i // 64] >> i % 64 & 1 else -weight
    return sum(1 << i for i in range(128) if votes[i] > 0)


def as_text(x):
    return f"{x & (1 << 64) - 1:016x}{x >> 64:016x}"


def compared_by_hand(rows, radius=6):
    """Rows of (id, text) with distinct ids; null ids come last."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    prints = [print_by_hand(t) for _, t in order]
    found = []
    for at, (ident, text) in enumerate(order):
        following = (at + 1) % len(order)
        m = len(text) // 3
        edited = text[: len(text) - m] + order[following][1][:m]
        own, other = prints[at], print_by_hand(edited)
        like = lambda a, b: 1 - (a ^ b).bit_count() / 128
        near = None
        if ident is not None and ident % 50 == 0:
            near = sum((own ^ p).bit_count() <= radius for p in prints) - 1
        sha = hashlib.sha256(edited.encode()).hexdigest()
        found.append((ident, len(text), sha, as_text(own), as_text(other), like(own, other), like(own, prints[following]), near))
    return Counter(found)


def columns(r):
    return (r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next, r.n_near)


def test_query_against_brute_force(spark):
    found = queries.op11_simhash(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    by_hand = compared_by_hand([(r.doc_id, r.text) for r in docs])
    assert Counter(map(columns, found.collect())) == by_hand
    edited, following = (sum(r[i] * n for r, n in by_hand.items()) / len(docs) for i in (5, 6))
    assert edited > 0.7 > 0.55 > following


@pytest.mark.parametrize("seed", range(2))
def test_nulls_copies_long_and_empty_texts(spark, seed):
    rows = [r for r in invented(seed) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    rows += [(1000, "x" * 200_000 + " " + "word é " * 30_000, "en", "s"), (1050, "\U0001f600" * 7, None, None), (None, "no id", None, None)]
    rows += [(1100 + i, "the same text in very many rows", "en", "s") for i in range(120)]
    found = simhash.compare_edits(frame(spark, rows))
    assert Counter(map(columns, found.collect())) == compared_by_hand([r[:2] for r in rows])


def test_repeated_rows_come_back_once_each(spark):
    rows = [(7, "one two three", "en", "s")] * 3 + [(7, "another text", "en", "s"), (3, None, "en", "s"), (3, "", "en", "s")]
    found = simhash.compare_edits(frame(spark, rows)).collect()
    assert Counter(r.doc_id for r in found) == {7: 4, 3: 2}
    same = {columns(r) for r in found if r.fingerprint == as_text(print_by_hand("one two three"))}
    assert len(same) == 1
    assert all(r.fingerprint == "0" * 32 for r in found if r.doc_id == 3)
    assert {r.doc_id: r.fingerprint for r in simhash.fingerprints(frame(spark, rows[-2:])).collect()} == {3: "0" * 32}


def test_empty_table_and_a_single_document(spark):
    assert simhash.compare_edits(frame(spark, [(1, "a", "en", "s")]).limit(0)).count() == 0
    [only] = simhash.compare_edits(frame(spark, [(50, "abcdef", "en", "s")])).collect()
    assert columns(only) == next(iter(compared_by_hand([(50, "abcdef")])))


@pytest.mark.parametrize(("radius", "blocks"), [(6, 7), (6, 8), (3, 4), (3, 6), (0, 1), (10, None)])
def test_search_finds_all_within_the_radius(spark, radius, blocks, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(radius)
    centres = [rng.getrandbits(128) for _ in range(20)]
    prints = {c ^ sum(1 << b for b in rng.sample(range(128), rng.randint(0, 14))) for c in centres for _ in range(60)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = lambda x: (signed(x & (1 << 64) - 1), signed(x >> 64))
    held = spark.createDataFrame([(*halves(p), 1 + p % 3) for p in prints], "f1 long, f2 long, n long")
    asked = [*centres, *rng.sample(sorted(prints), 40), rng.getrandbits(128)]
    found = simhash.count_within(spark.createDataFrame([halves(q) for q in asked], "f1 long, f2 long"), held, radius=radius, blocks=blocks)
    expected = {halves(q): sum(1 + p % 3 for p in prints if (p ^ q).bit_count() <= radius) for q in asked}
    assert {(r.f1, r.f2): r.n_within for r in found.collect()} == {q: n for q, n in expected.items() if n}


def test_plan_is_native(spark):
    plan = queries.op11_simhash(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
