"""Alignment against sets of boundaries and counts of occurrences, with both vocabularies' own libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridwell.llm import alignment as A

TEXTS = [
    "The quick brown fox, it's 42.", "", None, "  two  spaces\n\n\nlines\t", "naïve café Ελλάδα 日本語 🎈🎈", "▁ a sign that is a space elsewhere", "<|endoftext|> and <s> stay </s> text", "x" * 3000, " " * 700 + "y", "The quick brown fox, it's 42.",
    "​﻿ zero é", "ᄒ" * 400, "a", " ", "The the THE", "\x00\x01",
]


def encoders():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in own]
    byte = {chr(i): i for i in own} | {chr(256 + k): i for k, i in enumerate(rest)}
    return a, b, byte


def brute(rows):
    a, b, byte = encoders()
    docs = []
    for key, text in rows:
        if not text:
            docs.append((key, [], [], []))
            continue
        data = (" " + text).encode()
        ia, ib = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        ta = [bytes(byte[c] for c in a.id_to_token(i)) for i in ia]
        tb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        if b"".join(ta) != data or b"".join(tb) != data:
            docs.append((key, [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ta]).tolist(), np.cumsum([len(x) for x in tb]).tolist()
        both = sorted(set(ea) & set(eb))
        groups, last = [], 0
        for end in both:
            groups.append(([i for i, e in zip(ia, ea, strict=True) if last < e <= end], [i for i, e in zip(ib, eb, strict=True) if last < e <= end]))
            last = end
        docs.append((key, ia, ib, groups))
    links = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for *_, groups in docs]
    counts = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    out = []
    for (key, ia, ib, groups), own in zip(docs, links, strict=True):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((key, len(ia), len(ib), len(groups), sum(own.values()), sum(n for p, n in own.items() if counts[p] == most[p[0]]), sum(n * counts[p] for p, n in own.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("frequent", [0, 5, A.FREQUENT])
def test_alignment_by_hand(spark, frequent):
    rows = [(k if k != 3 else None, t) for k, t in enumerate(TEXTS)] + [(0, TEXTS[0]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("row", "pairs", "times", "n", "pair", "groups")})
    aligned = A.written(A.align(docs))
    own = A.score(aligned, A.written(A.pair_counts(aligned)), frequent)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    assert Counter(map(tuple, own.select(*COLUMNS, digest).collect())) == Counter(brute(rows))
    assert A.score(aligned.where("false"), A.pair_counts(aligned.where("false"))).count() == 0
    assert A.align(docs.where("false")).count() == 0


def test_wide_groups_count_like_listed_ones(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 300), rng.integers(0, 4, 400)
    lengths_a, lengths_b = np.array([4, 4, 8, 4, 12]), np.array([6, 3, 3, 9])
    total = int(lengths_a[a].sum())
    while (gap := total - int(lengths_b[b].sum())) > 0:
        b = np.append(b, 1 if gap >= 3 else 1)
    b = b[np.cumsum(lengths_b[b]) <= total]
    lengths_b = np.append(lengths_b, total - int(lengths_b[b].sum()))
    if lengths_b[-1]:
        b = np.append(b, 4)
    names = A.signed_names(10)
    listed = A.linked(a, b, lengths_a, lengths_b, names)
    monkeypatch.setattr(A, "WIDE", 1)
    wide = A.linked(a, b, lengths_a, lengths_b, names)
    assert listed.groups == wide.groups and listed.pairs.tolist() == wide.pairs.tolist() and listed.times.tolist() == wide.times.tolist()


def test_million_spaces_go_to_the_other_library():
    coder = A.Coder(None, None)
    text = "x" + " " * 1_100_000 + "y"
    a, b = coder.both(text)
    assert int(coder.a_lengths[a].sum()) == int(coder.b_lengths[b].sum()) == len(text) + 1


def test_query_on_documents(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert Counter(map(tuple, A.op12_alignment(spark, folder).collect())) == Counter(brute(rows))
