"""Language identification of mixed documents: proportions by expectation-maximisation.

Each language is a distribution over hashed byte trigrams. A document is a mixture: every trigram
comes from one of its languages, and expectation-maximisation estimates how large each language's
part is. The languages of a document are the set that maximises its likelihood less a penalty for
each one. The set grows from the most likely language by the one that raises the value most, as long as
one does. The likelihood is concave in the proportions, so its slopes bound what any more languages can
gain: where that is less than one penalty, no larger set is tried, and none can be better.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_mod, others, read, slices
from .grams import gram_counts

#: Labelled documents that a language is learned from, at most (a bound on fitting, not on what is predicted).
LEARNED_DOCS = 400
BITS, SIZES = 13, (3,)
#: Expectation-maximisation ends when the likelihood can't rise by more than this many nats, or after so many rounds.
CLOSE, ROUNDS = 0.01, 500
#: Nats that one more language must gain, for each half logarithm of the number of trigrams.
PENALTY = 8.0
UNKNOWN = "und"

RESULTS = {"lang_pred": "string", "score": "double", "languages": "array<struct<lang:string,share:double>>"}


class Model(NamedTuple):
    names: list[str]
    #: P(trigram bucket | language), buckets by languages.
    likely: np.ndarray


def learn(docs: DataFrame, where: Column, per_language: int = LEARNED_DOCS) -> Model:
    """Languages from those rows of docs (doc_id, text, lang) that where names and that have a lang and a text.

    Of each language the per_language rows count that come first by hash of id and text. Their trigrams are counted on the
    executors; the driver gets 2**BITS numbers at most for each language, and no text.
    """
    known = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    counts = np.full((1 << BITS, len(names)), 0.5)
    if not names:
        return Model([], counts)
    # a hash lets about twice as many through, so that few rows are sorted; the window takes the first of them
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 2 * per_language / n + 32 / n))])
    few = known.select("lang", "text", F.xxhash64("doc_id").alias("h"), F.xxhash64("doc_id", "text").alias("h2")).where(F.pmod("h", F.lit(1 << 20)) < share[F.col("lang")] * (1 << 20))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 20)), "h", "h2"))
    chosen = few.withColumn("place", place).where(F.col("place") <= per_language).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[str, np.ndarray] = {}
        for part in slices(batches):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                own[lang] = own.get(lang, 0) + gram_counts(text, SIZES, BITS)
        for lang, count in own.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(count[at], pa.int64())], names=["lang", "at", "n"])

    for r in chosen.mapInArrow(run, "lang string, at int, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect():
        counts[r["at"], names.index(r["lang"])] += r["n"]
    return Model(names, counts / counts.sum(axis=0))


def mixture(likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """Proportions of the languages in likely (trigrams by languages), the log-likelihood that they give counts, and the probabilities of the trigrams."""
    part = np.full(likely.shape[1], 1 / likely.shape[1])
    n = counts.sum()
    mixed = likely @ part
    for _ in range(ROUNDS):
        slope = (counts / mixed) @ likely
        if slope.max() - n <= CLOSE:  # what any other proportions can gain
            break
        part = part * slope / n
        mixed = likely @ part
    return part, float(counts @ np.log(mixed)), mixed


def identify(text: bytes, model: Model) -> list[tuple[str, float]]:
    """The languages of text with their proportions, the largest first; none without trigrams or languages."""
    count = gram_counts(text, SIZES, BITS)
    found = np.flatnonzero(count)
    if not len(found) or not model.names:
        return []
    likely, counts = model.likely[found], count[found].astype(float)
    alone = counts @ np.log(likely)
    chosen, best, shares = [int(alone.argmax())], float(alone.max()), np.ones(1)
    mixed, n = likely[:, chosen[0]], counts.sum()
    price = PENALTY * 0.5 * np.log(n + 1)
    while len(chosen) < len(model.names):
        slope = (counts / mixed) @ likely
        if slope.max() - n <= price:
            break
        tried = []
        for k in np.flatnonzero(slope > n):
            if k not in chosen:
                own, value, seen = mixture(likely[:, [*chosen, k]], counts)
                tried.append((value, -int(k), own, seen))
        if not tried:
            break
        value, k, own, seen = max(tried, key=lambda t: t[:2])
        if value - price <= best:
            break
        chosen, best, shares, mixed = [*chosen, -k], value, own, seen
    return sorted(((model.names[i], float(s)) for i, s in zip(chosen, shares, strict=True)), key=lambda x: (-x[1], x[0]))


def predict(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """docs with lang_pred, score (that language's proportion) and languages (all of the chosen set).

    lang_pred is "und" and score 0 where the text is null or has no letter, or where no language was learned.
    Columns of docs that are named like these (with prefix before the name, in any case) give way; all other columns
    and all rows stay. Repeated texts get equal values; a very long one is counted in parts; an empty table gives none.
    """
    results = [prefix + c for c in RESULTS]
    names = others(docs, results)
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))  # 2**BITS numbers for each language; a plain tuple, so that executors need no class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for text in part.column("text").to_pylist():
                found = identify(text.encode(), Model(*held.value)) if text and any(map(str.isalpha, text)) else []
                first = found[0] if found else (UNKNOWN, 0.0)
                rows.append((*first, [{"lang": a, "share": b} for a, b in found]))
            kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[*names, *results])

    from pyspark.sql import types as T

    docs = docs.select(*names)
    added = [T.StructField(n, T.DataType.fromDDL(kind)) for n, kind in zip(results, RESULTS.values(), strict=True)]
    schema = T.StructType([*docs.schema, *added])
    return docs.mapInArrow(run, schema)


def op8_language(spark, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    out = crc_mod("doc_id", 4) == 2
    model = learn(docs, ~out)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))
