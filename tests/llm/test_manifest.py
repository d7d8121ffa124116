"""The manifest against one that is made by the definition, on small trees of all shapes."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridwell.llm import manifest as M


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes):
    """The root and each node's siblings, by whole levels."""
    proofs, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for k, p in enumerate(place):
            run = runs[p // 16]
            proofs[k] += [(run[: p % 16], run[p % 16 + 1 :])]
            place[k] = p // 16
        nodes = ["".join(r) for r in runs]
        nodes = [h(n) for n in nodes]
    return nodes[0], proofs


def folded(node, proof):
    for left, right in proof:
        node = h("".join(left) + node + "".join(right))
    return node


def brute(rows):
    """rows (doc_id, source, leaf, seen) to all results."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        by.setdefault(r[1], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    inner = {s: tree([r[2] for r in by[s]]) for s in names}
    root, outer = tree([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, outer, strict=True):
        for r, proof in zip(by[s], inner[s][1], strict=True):
            whole = proof + above
            end = folded(r[3] or r[2], whole)
            out.append((r[0], r[2], inner[s][0], root, h("".join("".join(a + b) for a, b in whole)), end, end == root))
    return out


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def found(table):
    return Counter(map(tuple, table.select(*COLUMNS).collect()))


@pytest.mark.parametrize("sizes", [[1], [2], [16], [17], [1, 1], [256, 1, 15], [257, 3], [4096, 4097, 1], [9000], [3] * 20])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(i * 7, f"s{k}" if k else None, h(f"{k} {i}"), h("other") if i % 5 == 0 else None) for k, n in enumerate(sizes) for i in range(n)]
    table = spark.createDataFrame(rows, "doc_id long, source string, leaf string, seen string")
    assert found(M.manifest(table)) == Counter(brute(rows))


def test_block_traversal_holds_few_nodes():
    leaves = [h(str(i)) for i in range(4096)]
    paths, whole = M.Paths(leaves, 3), tree(leaves)[1]
    for i in range(4096):
        assert paths.sides == [("".join(a), "".join(b)) for a, b in whole[i]]
        assert sum(map(len, paths.runs)) + sum(map(len, paths.ahead)) + sum(len(r) for s in paths.stacks for r in s.rows) <= 16 * 9
        paths.step()


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, None), (1, "é", "en", 3, "Abc"), (1, "é", "en", 3, "Abc"), (1, "e", None, 0, ""), (2, "", "x", 5, "a:-1"), (5, "Z", "en", 1, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(7) for c in ("leaf_", "g", "block", "at", "root", "_rank", "_n")})
    leaf = M.leaf_of(*[F.col(c) for c in M.FIELDS])
    table = docs.withColumns({"leaf": leaf, "seen": F.when(F.col("doc_id") == 1, F.lit("0" * 64))})

    def by_hand(row):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], row[4])))

    want = brute([(r[0], r[1], by_hand(r), "0" * 64 if r[0] == 1 else None) for r in rows])
    assert found(M.manifest(table)) == Counter(want)
    assert M.manifest(table.where("false")).count() == 0


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    lower = str.maketrans({c: c.lower() for c in M.A_TO_Z})

    def leaf(r, text):
        return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    rows = [(r.doc_id, r.source, leaf(r, r.text), leaf(r, r.text.translate(lower)) if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else None) for r in docs]
    own = found(M.op13_manifest(spark, folder))
    assert own == Counter(brute(rows))
    assert 0 < sum(n for r, n in own.items() if not r[-1]) < len(rows) / 3
