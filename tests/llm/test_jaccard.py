"""The Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.llm import jaccard as J


def own_set(text, words=3):
    parts = (text or "").encode().lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(len(parts) - words + 1, 1))} if parts else set()


def brute(rows, percent=90, words=3):
    sets = [own_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    order = sorted(range(len(rows)), key=lambda i: len(sets[i]))
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if len(sets[j]) * percent > len(sets[i]) * 100:
                break
            if find(i) != find(j) and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, len(s), least.get(find(i)) if s else key) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(table):
    return Counter(map(tuple, table.select("doc_id", "n", "component_id").collect()))


def test_signatures_meet_in_all_similar_pairs():
    rng = np.random.default_rng(3)
    for percent in (70, 80, 90, 95):
        for n in [*range(2, 40), 99, 300, 2500, 30_000]:
            for _ in range(30 if n < 1000 else 2):
                whole = rng.integers(-(1 << 62), 1 << 62, n)
                # as far apart as similar sets can be, by tokens that only one has
                apart = n * (100 - percent) // 100
                cut = int(rng.integers(0, apart + 1))
                a, b = np.unique(whole[cut:]), np.unique(whole[: n - (apart - cut)])
                common = len(np.intersect1d(a, b))
                if len(a) and len(b) and 100 * common >= percent * (len(a) + len(b) - common) and a.tobytes() != b.tobytes():
                    assert set(J.signatures(a, percent).tolist()) & set(J.signatures(b, percent).tolist())


def texts(rng):
    """Classes of near copies of all degrees, a passage that many share, short texts, exact copies."""
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=40)
    out = []
    for size in (4, 12, 30, 60, 200):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size)
            for edits in (0, 0, 1, 1, 2, 3, 5, 9):
                copy = list(base)
                for _ in range(edits * size // 60 + (edits > 0)):
                    at = rng.randrange(len(copy))
                    copy[at : at + rng.choice((0, 1))] = [rng.choice(vocabulary)]
                out.append(" ".join(copy))
    out += [" ".join(passage + rng.choices(vocabulary, k=rng.choice((1, 2, 4, 40)))) for _ in range(60)]
    return out


@pytest.mark.parametrize("percent", [80, 90])
def test_join_by_all_pairs(spark, monkeypatch, percent):
    rng = random.Random(percent)
    rows = list(enumerate(texts(rng)))
    rng.shuffle(rows)
    monkeypatch.setattr(J, "MEMBERS", 5)  # so that classes have several groups
    monkeypatch.setattr(J, "QUERIES", 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows, percent)
    assert sum(k[0] != k[2] for k in want) > 50
    assert found(J.similar_texts(docs, 3, percent)) == want


def test_nulls_ties_repeats_and_clashing_columns(spark):
    long = " ".join(f"v{i % 5000} {i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "One"), (6, "one two"), (None, "one two"), (None, "a b c d"), (None, "a b c d"), (7, long), (8, long + " more"), (8, long + " more"), (9, "one two three"), (-3, "ONE two\tthree")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "node", "n", "group", "hash", "own", "sign", "root")})
    assert found(J.similar_texts(docs)) == brute(rows)
    assert J.similar_texts(docs.where("false")).count() == 0
    assert found(J.similar_texts(docs.where("text is null"))) == Counter([(1, 0, 1)])


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert Counter(map(tuple, J.op11_jaccard(spark, folder).select("doc_id", "n_shingles", "component_id").collect())) == brute(rows)
