"""Brute-force twins, round trips and awkward tables for the operators on training data."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridwell.llm import bpe, components, language, licenses, media, packing, quality, repeats, simhash, topk, toxicity

SMALL = "/root/testdata/sf0.001"
EXTRA = "score double, kept string, lang_pred string, fp long, length int, _group int, salt int, payload string, stays long, value int, start long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty, white, long and repeated texts, repeated ids, clashing columns."""
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "delta", "épsilon", "ζeta", "<|endoftext|>", "x" * 700, "it's", "42"]
    text = [None, "", "   \n\t ", "one", "one two", " ".join(rng.choices(words, k=40_000)), "a b c d e f g h i j k l m n o p", "z a b c d e f g h i j k l m n o p", "日本語 の テキスト", "!!! ???", "\x00\x1f   x"]
    rows = [(i, t) for i, t in enumerate(text)] + [(6, text[6]), (6, text[6]), (None, text[6]), (None, None), (-5, text[7]), (2**62, "one two")]
    docs = spark.createDataFrame([(i, t, None if n % 3 else "en", None if n % 4 else "s", None) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    for column in EXTRA.split(", "):
        name, kind = column.split(" ")
        docs = docs.withColumn(name, F.lit(7).cast(kind))
    return docs


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def empty(docs):
    return docs.where("false")


MODELS = {
    "quality": lambda docs: quality.train([("Good line here.\nAnother one.", 1), ("BAD!! BAD!!", 0)] * 4, 0.8, steps=5),
    "language": lambda docs: language.Model(["de", "en"], np.full((1 << language.BITS, 2), 1.0 / (1 << language.BITS))),
    "toxicity": lambda docs: toxicity.train([("nice words", 0), ("scum words", 1)] * 30, 0.5, steps=5),
}
PER_ROW = {
    "media": media.media_columns,
    "quality": lambda d: quality.score(d, MODELS["quality"](d)),
    "language": lambda d: language.predict(d, MODELS["language"](d)),
    "toxicity": lambda d: toxicity.score(d, MODELS["toxicity"](d)),
    "simhash": simhash.near_duplicates,
    "repeats": repeats.remove_repeats,
    "bpe": bpe.encode,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_awkward_and_empty_tables(awkward, name):
    n = awkward.count()
    assert PER_ROW[name](awkward).count() == n
    assert PER_ROW[name](empty(awkward)).count() == 0


def test_packing_and_licenses_take_awkward_and_empty_tables(awkward, spark):
    packed = packing.pack_documents(awkward)
    assert packed.where("piece = 0").count() == awkward.count()
    assert packing.pack_documents(empty(awkward)).count() == 0
    assert licenses.scan(awkward, licenses.templates(spark)).count() == 0
    assert licenses.scan(empty(awkward), licenses.templates(spark)).count() == 0
    assert licenses.scan(awkward, licenses.templates(spark, {"short": "two words"})).count() == 0


def test_media_is_lossless_and_equal_texts_are_equal(awkward):
    rows = media.media_columns(awkward).collect()
    for r, text in zip(rows, [x.text for x in awkward.select("text").collect()], strict=True):
        raw = (text or "").encode()
        assert bytes(r.payload) == raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        assert media.from_wav(bytes(r.media)) == bytes(r.payload)
    same = [(bytes(r.media), tuple(r.pair_code), tuple(r.pair_time)) for r in rows if r.doc_id == 6]
    assert len(same) == 3 and len(set(same)) == 1


def test_media_peaks_of_blocks_are_those_of_the_whole(monkeypatch):
    samples = np.random.RandomState(0).randint(0, 256, 50_000).astype(np.uint8)
    whole = media.peaks(samples)
    monkeypatch.setattr(media, "BLOCK", 17)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.peaks(samples), strict=True))


def test_media_finds_a_tone():
    tone = (128 + 100 * np.sin(2 * np.pi * 20 / media.FRAME * np.arange(4096))).astype(np.uint8)
    times, bins = media.peaks(tone)
    assert (bins == 19).sum() >= 20  # bins start behind the constant part


def _auc(labels, scores):
    order = np.argsort(np.argsort(scores))
    good = labels == 1
    return (order[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(quality.op2_quality, "quality", 0.95), (toxicity.op4_toxicity, "toxic", 0.85)])
def test_classifiers_tell_held_out_documents(spark, query, label, least):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = query(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select(label, "score").collect()
    values = np.array([(r[0], r[1]) for r in rows])
    assert _auc(values[:, 0], values[:, 1]) > least


def test_crf_marginals_are_those_of_all_labellings():
    rng = np.random.RandomState(2)
    emission, chain = rng.randn(4, 2), rng.randn(2, 2)
    marginal, _ = quality.forward_backward(emission, chain, np.array([0, 4]), np.ones(4))
    total, own = 0.0, np.zeros((4, 2))
    for code in range(16):
        y = [code >> i & 1 for i in range(4)]
        p = np.exp(sum(emission[i, y[i]] for i in range(4)) + sum(chain[y[i], y[i + 1]] for i in range(3)))
        total += p
        for i in range(4):
            own[i, y[i]] += p
    assert np.allclose(marginal, own / total)


def test_classifiers_without_labels_or_with_one_class(spark):
    docs = spark.createDataFrame([(1, "a text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, none, F.lit(True))).count() == 2
    one = spark.createDataFrame([(1, 1, None), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.score(docs, quality.learn(docs, one, F.lit(True))).count() == 2
    assert toxicity.score(docs, toxicity.train([], 0.1)).count() == 2


def test_language_of_held_out_documents_and_of_a_mixture(spark, documents):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language.op8_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    model = language.learn(docs, F.lit(True))
    by = {r.lang: r.text for r in docs.where("length(text) > 4000").select("lang", "text").collect()}
    found = dict(language.identify((by["en"][:3000] + " " + by["fr"][:3000]).encode(), model))
    assert set(found) == {"en", "fr"} and min(found.values()) > 0.3
    assert language.identify(b"", model) == []


def test_language_without_letters_is_unknown(awkward):
    rows = {r.doc_id: r for r in PER_ROW["language"](awkward).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (0, 1, 2, 9))


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", topk.quantised(F.col("embedding")).alias("value"))


def test_topk_against_brute_force_with_ties_and_invalid_vectors(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 70)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 3)
    rng = np.random.RandomState(3)
    rows = [(i, [float(x) for x in rng.randint(-3, 4, 6) / 8]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(40)] + [(400, None), (450, [float("nan")] * 6), (500, [None] + [0.1] * 5), (550, [float("inf")] * 6), (None, [0.1] * 6)]
    vectors = _vectors(spark, rows)
    found: dict = {}
    for r in topk.search(vectors, vectors.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    valid = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()}
    assert set(found) == {i for i in valid if i % 50 == 0}
    for q, got in found.items():
        best = sorted(((-int(v @ valid[q]), i) for i, v in valid.items() if i != q))[:5]
        assert sorted(got) == [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert topk.search(vectors.where("false"), vectors).count() == 0
    assert topk.search(vectors.where("vec_id in (0, 1)"), vectors.where("vec_id = 0")).count() == 1


def test_packing_is_exact_for_planned_lengths():
    for seed in range(30):
        rng = random.Random(seed)
        capacity = rng.choice([7, 16, 50])
        histogram = {n: rng.randint(1, 60) for n in rng.sample(range(1, capacity + 1), rng.randint(1, capacity))}
        places: dict = {}
        ranges = packing.plan(histogram, capacity)
        by_length: dict = {}
        for r in ranges:
            by_length.setdefault(r.length, []).append(r)
        for length, n in histogram.items():
            for rank in range(n):
                r = [x for x in by_length[length] if x.first <= rank][-1]
                at = rank - r.first
                places.setdefault(r.sequence + at // r.bins, []).append((r.offset + at % r.bins * length, length))
        for own in places.values():
            end = 0
            for offset, length in sorted(own):
                assert offset == end
                end += length
            assert end <= capacity
        total = sum(k * n for k, n in histogram.items())
        assert len(places) >= -(-total // capacity)
        assert len(places) <= 11 / 9 * max(-(-total // capacity), sum(n for k, n in histogram.items() if 2 * k > capacity)) + 4


def test_bpe_of_every_sign_is_that_of_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    theirs.no_truncation()
    theirs.no_padding()
    texts = [f"a{chr(c)}!{chr(c)}1" for c in range(0x40000) if not 0xD800 <= c < 0xE000]
    wrong = [t for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False), strict=True) if e.ids != ours.encode(t)]
    assert not wrong


def test_packing_against_the_tokenizers_library(spark, awkward):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = awkward.where("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = packing.pack_documents(docs).orderBy("doc_id", "piece").collect()
    for key, text in texts.items():
        ids = np.array([*coder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in rows if r.doc_id == key]
        assert sum(r.length for r in own) == len(ids) and all(r.length == 2048 for r in own[1:])
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    places: dict = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0] + [n for _, n in sorted(own)])[:-1]) and sum(n for _, n in own) <= 2048


def test_packing_takes_a_million_white_space_signs_in_a_row(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = 1_100_000
    texts = ["x" + " " * n + "y", "x" + "\n" * n + "y <|endoftext|> z", "x" + " \n" * (n // 2), "\u3000" * n + "1", "a plain text"]
    rows = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "piece").collect()
    for key, text in enumerate(texts):
        ids = np.array([*coder.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = [r for r in rows if r.doc_id == key]
        assert sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_simhash_links_against_brute_force(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(60)]
    values = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(12)} | {0, 2**64 - 1, 1, 3, 7, 15}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    found = [(r.u, r.v) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()]
    true = {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert {(min(p), max(p)) for p in found} == true and len(found) == len(true)


def test_simhash_fingerprint_is_sparks_hash(spark):
    text = "A b\tC d e\x0bf"
    words = text.lower().split()
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [spark.sql(f"select xxhash64('{s}') & -1 as h").first().h & (2**64 - 1) for s in shingles]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text.encode()) & (2**64 - 1) == expected
    assert simhash.fingerprint(b" \n ") == 0


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (None, 3), (300, 299), (300, 299)]
    found = {r.u: r.v for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)} | {200 + i: 200 for i in range(1, 9)} | {300: 299}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_keep_null_ids(awkward):
    rows = simhash.near_duplicates(awkward).collect()
    assert {r.component_id for r in rows if r.fp == 0} == {0}
    assert {r.component_id for r in rows if r.doc_id == 6 or r.doc_id is None and r.fp != 0} <= {6, -5}


def _removed(docs, window=13):
    """Words that go, by the definition."""
    first: dict = {}
    words = {i: (t or "").encode().split() for i, t in docs}
    for i in sorted(words):
        for p in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][p : p + window]), i)
    out = {}
    for i, own in words.items():
        mask = [False] * len(own)
        for p in range(len(own) - window + 1):
            if first[tuple(own[p : p + window])] < i:
                mask[p : p + window] = [True] * window
        out[i] = (len(own), sum(mask), b" ".join(w for w, m in zip(own, mask, strict=True) if not m).decode())
    return out


@pytest.mark.parametrize("window", [13, 12, 4])
def test_repeats_against_the_definition(spark, window):
    rng = random.Random(window)
    passages = [" ".join(rng.choices("abcdefgh", k=rng.randint(window, 40))) for _ in range(12)]
    docs = [(i * 7 % 101, "  ".join(rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choices([f"w{k}" for k in range(500)], k=rng.randint(1, 30))) for _ in range(rng.randint(0, 8))) + "\n") for i in range(101)]
    rows = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), window).collect()
    expected = _removed(docs, window)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == expected
    assert all(sum(s.length for s in r.removed) == r.n_removed for r in rows)
    assert sum(x[1] for x in expected.values()) > 100


def test_repeats_of_the_test_documents(spark, documents):
    rows = repeats.remove_repeats(documents).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == _removed([(r.doc_id, r.text) for r in documents.collect()])


def test_repeats_in_very_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "STEP_BYTES", 50)
    text = " ".join(f"w{i}" for i in range(400))
    assert b"".join(repeats._cut(text.encode())) == text.encode() and max(map(len, repeats._cut(text.encode()))) <= 100
    from pyarrow import table

    whole = repeats.Words(table({"doc_id": [1], "text": [text]})).hashes
    assert len(whole) == 400 and len(set(whole.tolist())) == 400


def test_repeats_leave_rows_without_ids_and_equal_ids(awkward):
    rows = repeats.remove_repeats(awkward).collect()
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None or r.doc_id == -5)
    assert [r.n_removed for r in rows if r.doc_id == 6] == [16] * 3  # all in -5's text


@pytest.mark.parametrize("seed", range(3))
def test_bpe_against_the_tokenizers_library(documents, seed):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    theirs, ours = Tokenizer.from_file(path), bpe.WordBpe(path)
    rng = random.Random(seed)
    odd = ["", " ", "İstanbul ΑΣ Σ", "é x\u0085y", "don'T 'ſ 'LL", "12 ½ Ⅷ ٣", "<|endoftext|>a<|startoftext|>", "x" * 5000, "?!" * 900, "日本語 한국어 क्षि", "😀👍🏽 ﻿​"]
    odd += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x17F), rng.randint(0x370, 0x3FF), rng.randint(0x1E00, 0x1FFF), rng.randint(0x4E00, 0x4E80)])) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    for text in odd + [r.text for r in documents.limit(40).collect()]:
        ids = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text) == ids, text[:80]
        assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_long_pieces_merge_alike():
    import public_tokenizers

    coder = bpe.WordBpe(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(5)
    for _ in range(50):
        parts = [coder.first[b] for b in "".join(rng.choices("theinaro", k=200)).encode()]
        assert coder._merged_long(list(parts)) == coder.merged(list(parts))


def test_bpe_decodes_a_table(spark, documents):
    coded = bpe.encode(documents)
    back = {r.doc_id: r.decoded for r in bpe.decode(coded).collect()}
    assert back == {r.doc_id: r.decoded for r in coded.collect()}
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().decoded == ""


def test_licenses_find_whole_and_nearly_whole_notices(spark):
    text = licenses.TEMPLATES["MIT-permission"]
    words = text.split()
    docs = [(1, "some words before. " * 30 + text + " after"), (2, " ".join(words[:-6])), (3, " ".join(words[: len(words) // 2])), (4, text.upper().replace(" ", "\n * ")), (4, "Released under the MIT License."), (None, "Released under the MIT License.")]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), licenses.templates(spark)).collect()
    found = {(r.doc_id, r.template): r.containment for r in rows}
    assert found[1, "MIT-permission"] == found[4, "MIT-permission"] == 1 and found[2, "MIT-permission"] >= 0.8 and (3, "MIT-permission") not in found
    assert found[4, "MIT"] == 1 and found[None, "MIT"] == 1


def test_license_bands_and_the_join_without_a_list_of_shingles(spark, documents, monkeypatch):
    assert all((1 - (np.ceil(0.8 * (b // 2 + 1)) / (2 * b + b // 2 + 1 - np.ceil(0.8 * (b // 2 + 1))))) ** licenses.bands(b) <= licenses.MISS * 1.0001 for b in (1, 2, 4, 32))
    whole = sorted(map(tuple, licenses.scan(documents, licenses.templates(spark, {"MIT": licenses.TEMPLATES["MIT"], "GPL": licenses.TEMPLATES["GPL-3.0"]})).collect()))
    monkeypatch.setattr(licenses, "KNOWN_SHINGLES", 0)
    assert whole == sorted(map(tuple, licenses.scan(documents, licenses.templates(spark, {"MIT": licenses.TEMPLATES["MIT"], "GPL": licenses.TEMPLATES["GPL-3.0"]})).collect()))


def _notices(rows, known):
    """What scan() tells of rows, by holding every window of every text against every template."""
    import regex

    def shingles(text):
        words = regex.sub(r"[^\p{L}\p{N}]+", " ", (text or "").lower()).strip(" ").split(" ")
        return [tuple(words[i : i + licenses.SHINGLE]) for i in range(len(words) - licenses.SHINGLE + 1)]

    out = []
    forms = {name: set(shingles(text)) for name, text in known.items()}
    for doc_id, text in rows:
        own = shingles(text)
        for name, parts in forms.items():
            block = 1 << (len(parts) - 1).bit_length()
            best = max(((len(parts.intersection(own[s : s + 2 * block])), -s) for s in range(0, len(own), block)), default=(0, 0))
            if best[0] >= licenses.CONTAINED * len(parts):
                out.append((doc_id, name, best[0], len(parts), best[0] / len(parts), -best[1]))
    return sorted(out)


@pytest.mark.parametrize("known", [20_000, 0])
def test_licenses_across_parts_with_very_long_words(spark, monkeypatch, known):
    """Notices before, on and after the end of a part, with words or white space of many signs in their middle."""
    monkeypatch.setattr(licenses, "KNOWN_SHINGLES", known)
    notice = licenses.TEMPLATES["Apache-2.0-header"].split()
    middle = {"none": [], "word": ["é" * 90_000], "longer": ["x" * 400_000], "space": ["\n " * 200_000], "dots": [". . " * 100_000]}
    rows = [(1, None), (2, ""), (3, " " * 600_000)]
    for n, (at, words) in enumerate((at, w) for at in (0, licenses.PIECE - 200, licenses.PIECE - 1, licenses.PIECE + 7) for w in middle.values()):
        lead = ("lorem ipsum " * (at // 12 + 1))[:at]
        rows.append((10 + n, lead + " ".join([*notice[:30], *words, *notice[30:]]) + " end of the text" * (n % 3 * 9_000)))
    docs = spark.createDataFrame(rows + rows[5:7], "doc_id long, text string")
    texts = {k: licenses.TEMPLATES[k] for k in ("Apache-2.0-header", "Apache-2.0", "MIT")}
    found = sorted((r.doc_id, r.template, r.found, r.shingles, r.containment, r.start) for r in licenses.scan(docs, licenses.templates(spark, texts)).collect())
    assert {r[0] for r in found if r[1] == "Apache-2.0-header"} == set(range(10, 30))
    assert found == _notices(rows, texts)


def test_license_parts_have_the_windows_of_the_whole(spark, monkeypatch):
    """Parts of a few hundred signs, cut anywhere in words and spaces, give what one part gives."""
    rng = random.Random(5)
    texts = {k: licenses.TEMPLATES[k] for k in ("MIT", "CC0-1.0", "ISC", "GPL-3.0")}
    rows = []
    for i in range(60):
        words = [rng.choice([rng.choice(["of", "the", "İstanbul", "y" * rng.randint(1, 90), "𝔘𝔫𝔦", "—"]), rng.choice(list(texts.values()))]) for _ in range(rng.randint(0, 60))]
        rows.append((i, rng.choice(["", "  ", "a"]) + rng.choice([" ", "  ", ", "]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, licenses.scan(docs, licenses.templates(spark, texts)).collect()))
    for size in (1, 97, 256):
        monkeypatch.setattr(licenses, "PIECE", size)
        assert whole and sorted(map(tuple, licenses.scan(docs.where("doc_id < 12") if size == 1 else docs, licenses.templates(spark, texts)).collect())) == [r for r in whole if size > 1 or r[0] < 12]


def test_licenses_run_no_python(spark, documents):
    plan = licenses.scan(documents, licenses.templates(spark))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_digests_of_the_queries(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in media.op1_media_columns(spark, SMALL).collect():
        payload = media.padded((texts[r.doc_id] or "").encode())
        assert (r.payload_sha256, r.tail_crc32, r.media_sha256) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), hashlib.sha256(media.to_wav(payload)).hexdigest())
    for r in repeats.op9_repeats(spark, SMALL).collect():
        assert r.n_removed <= r.n_words


@pytest.mark.parametrize(("query", "sql"), [(topk.op3_topk, topk.ORACLES["op3_topk"]), (licenses.op7_licenses, licenses.ORACLES["op7_licenses"]), (repeats.op9_repeats, repeats.ORACLES["op9_repeats"])])
def test_sql_twins(spark, query, sql):
    import duckdb

    connection = duckdb.connect()
    for table in ("documents", "embeddings"):
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    own, twin = query(spark, SMALL).toPandas(), connection.execute(sql).fetchdf()
    names = sorted(own.columns)
    plain = [t[names].astype(str).sort_values(names).reset_index(drop=True) for t in (own, twin)]
    assert len(own) and plain[0].equals(plain[1])
