"""Near copies against brute force over all pairs."""

import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from gridwell.llm import common, jaccard, nearcopies

SMALL = "/root/testdata/sf0.001"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def groups(texts):
    """Sets of indexes that links of Jaccard 0.8 and more connect, by comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    found = {}
    for i in range(len(texts)):
        found.setdefault(find(i), set()).add(i)
    return {frozenset(g) for g in found.values()}


def made(rng):
    """Texts of many lengths with copies of every similarity, a line that many share, and a large group of near copies."""
    vocabulary = [f"w{i}" for i in range(500)]
    line = rng.choices(vocabulary, k=40)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "a b c d e f", "a b c d e f g h i"]
    for n in (5, 9, 20, 60, 150, 400):
        for _ in range(6):
            base = rng.choices(vocabulary, k=n) + (line if rng.random() < 0.5 else [])
            for edits in (0, 0, 1, 2, 3, 5, 8):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(" ".join(copy[: len(copy) - rng.choice([0, 0, len(copy) // 12, len(copy) // 6])]))
    base = rng.choices(vocabulary, k=120)
    for i in range(120):
        copy = list(base)
        for _ in range(i % 6):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("members", [jaccard.MEMBERS, 1, 10**9])
def test_near_copies_against_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)
    texts = made(random.Random(members % 97))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    found = {}
    for r in nearcopies.near_copies(docs).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(g) for g in found.values()} == groups(texts)


def test_stage_drops_what_shares_four_fifths_of_its_shingles(spark):
    texts = made(random.Random(5))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = {r.doc_id for r in P.drop_near_duplicates(spark, docs, SMALL).collect()}
    assert left == {min(g) for g in groups(texts)}


def test_stage_leaves_one_row_of_repeated_and_null_ids(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "s"), (1, a, "s"), (1, a, None), (2, b, "s"), (2, c, "s"), (3, c + " end", "s"), (None, a, "s"), (None, a, "s"), (None, a + " end", "s"), (1, b, "s")]
    left = P.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), SMALL).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in left) == [("1", "a"), ("1", "b"), ("2", "c"), ("None", "a")]


def test_sketches_bound_how_far_sets_are_apart():
    rng = np.random.default_rng(5)
    for n in (0, 1, 40, 3000):
        u, v = (np.unique(rng.integers(-(2**63), 2**63 - 1, n)) for _ in range(2))
        v = np.unique(np.concatenate([v, u[: n // 2]]))
        bits = sum(int(x).bit_count() for x in (jaccard.odd(u) ^ jaccard.odd(v)).view(np.uint64))
        assert bits <= len(np.setxor1d(u, v)) and len(jaccard.odd(u)) == jaccard.BITS // 64


def test_a_line_that_many_share_makes_no_candidates(spark, monkeypatch):
    """Texts that have one of ten lines and are otherwise unlike: no pair of them is ever held against another, however many there are."""
    asked = []
    whole = jaccard._open
    monkeypatch.setattr(jaccard, "_open", lambda queries, *more: asked.append(queries.count()) or whole(queries, *more))
    for n in (400, 1600):
        rng = random.Random(n)
        lines = [" ".join(f"l{k}.{i}" for i in range(12)) for k in range(10)]
        texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) + " " + lines[i % 10] for i in range(n)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
        assert nearcopies.near_copies(docs).select("root").distinct().count() == n
    assert max(asked) <= 3


def test_tokens_and_signatures_are_not_written_with_the_nodes(spark):
    """Texts of a thousand words have some 500 signatures each; no table that is left behind holds them."""
    before = len(common.WRITTEN)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(1000)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    assert nearcopies.near_copies(docs).select("root").distinct().count() == len(texts)
    sizes = [sum(f.stat().st_size for f in Path(urlparse(folder).path).rglob("*.parquet")) for folder in common.WRITTEN[before:]]
    assert 0 < max(sizes) < 1500 * len(texts)


def test_signatures_left_of_two_similar_sets_have_one_in_common():
    """Whatever order of all signatures there is, what each set keeps of its own has one in common with each similar set's."""
    rng = np.random.default_rng(3)
    for n in [*range(4, 40), 90, 400, 2000]:
        for _ in range(6):
            own = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            lost = int(rng.integers(0, n // 5 + 1))
            added = (len(own) - lost) * 5 // 4 - len(own)
            other = np.unique(np.concatenate([own[lost:], rng.integers(-(2**63), 2**63 - 1, added)]))
            assert 5 * (len(own) - lost) >= 4 * (len(own) + added)
            seed = np.uint64(rng.integers(1, 2**63))
            left = []
            for tokens in (own, other):
                signs, spare = nearcopies.signatures(tokens), nearcopies._spare(tokens)
                signs = signs[np.argsort(common.mix(signs.view(np.uint64) ^ seed))]
                left.append({s for k in range(nearcopies.KINDS) for s in signs[signs % nearcopies.KINDS == k][spare[k] :].tolist()})
            assert left[0] & left[1] or lost + added == 0


def test_copies_that_are_nearly_similar_enough_make_few_candidates(spark, monkeypatch):
    """Copies of a text with about a ninth of its lines changed, each to one that others have as well: many pairs are a little below four fifths."""
    made, closely = [], nearcopies.jaccard.between

    def between(shared, outside, sets, before, stars, percent, *more, **named):
        entries = shared.join(outside, "node").select("sign", "node", "group", "n", "held", "odd")
        other = entries.withColumnsRenamed({c: f"other_{c}" for c in ("node", "group", "n", "held", "odd")})
        made.append(entries.join(other, "sign").where("group < other_group").where(jaccard._near("other_", percent, *more, **named)).count())
        return closely(shared, outside, sets, before, stars, percent, *more, **named)

    monkeypatch.setattr(jaccard, "between", between)
    rng = random.Random(11)
    lines = [[" ".join(f"w{rng.randrange(10**6)}" for _ in range(10)) for _ in range(2)] for _ in range(40)]
    texts = [" ".join(choices[rng.random() < 0.11] for choices in lines) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("key", F.xxhash64("text"))
    found = {}
    for r in nearcopies.near_copies(docs).collect():
        found.setdefault(r.root, set()).add(r.doc_id)
    assert {frozenset(g) for g in found.values()} == groups(texts)
    assert 0 < max(made) < 35_000  # 70,341 with all signatures and sketches of whole sets
