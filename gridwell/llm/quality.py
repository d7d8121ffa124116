"""Document quality by a linear-chain conditional random field over lines.

Every line gets a label, good or bad, from features of itself and of the lines beside it, and from
its neighbours' labels. Training documents give their label to all of their lines. A document's
quality is the mean of its lines' forward-backward marginals, weighted by their lengths, brought to
the scale of a probability by a logistic curve that is fitted on the training documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Powers, crc_mod, joined, kept, labelled_sample, others, read, slices, span_hashes, words_of

#: Labelled documents of each class that the field is trained on, at most.
LEARNED_DOCS = 800
STEPS, RIDGE = 250, 1e-3
#: Bytes of training texts whose lines are found at once, for the driver's memory: about 50 bytes a byte.
LEARN_BYTES = 1 << 18

#: Kinds of bytes whose shares are features of a line.
KINDS = [
    np.isin(np.arange(256), np.frombuffer(signs, np.uint8))
    for signs in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"|", b".,;:?'\"-()", b"#$%&*+/<=>@[\\]^_`{}~", bytes(range(128, 256)))
]
OWN = len(KINDS) + 6


class Model(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    #: Of a line's features, its neighbours' and a constant, for the label good against bad.
    emission: np.ndarray
    #: Log-potentials of a line's label (rows) and the next one's.
    chain: np.ndarray
    #: Slope and intercept of the curve over the log-odds of the weighted mean.
    curve: tuple[float, float]


class Lines(NamedTuple):
    features: np.ndarray
    length: np.ndarray
    #: Where each document's lines start, one more for the end.
    starts: np.ndarray


def lines_of(texts: pa.Array) -> Lines:
    """The lines of texts that have more than white space, with the features of each and of the ones beside it."""
    data, doc_starts = joined(texts)
    breaks = np.flatnonzero(data == 10)
    first = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    last = breaks

    def total(flags: np.ndarray) -> np.ndarray:
        run = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=run[1:])
        return run[last] - run[first]

    visible = total(~SPACE[data])
    word_first, word_last = words_of(data)
    hashes = span_hashes(data, word_first, word_last, kept(("powers",), Powers))
    at = np.zeros(len(data) + 1, np.int64)
    at[word_first + 1] = 1
    at = np.cumsum(at)
    words = at[last] - at[first]
    same = np.zeros(max(len(hashes) + 1, 2), np.int64)
    same[2 : len(hashes) + 1] = np.cumsum(hashes[1:] == hashes[:-1])
    repeated = np.where(words > 1, same[np.maximum(at[last], 1)] - same[np.minimum(at[first] + 1, len(same) - 1)], 0)
    upper_words = np.zeros(len(data), bool)
    upper_words[word_first] = KINDS[0][data[np.minimum(word_first + 1, len(data) - 1)]]
    size = np.maximum(visible, 1)
    line = span_hashes(data, first, last, kept(("powers",), Powers))
    own = [total(k[data]) / size for k in KINDS]
    own += [visible / np.maximum(words, 1) / 10, np.log1p(words), repeated / np.maximum(words - 1, 1), total(upper_words) / np.maximum(words, 1), np.log1p(visible) / 4]
    keep = visible > 0
    own = np.stack(own, axis=1)[keep]
    line, size = line[keep], visible[keep].astype(float)
    starts = np.searchsorted(first[keep], doc_starts)
    doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((line, doc))
    again = np.zeros(len(line))
    again[order[1:]] = (line[order[1:]] == line[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    own = np.column_stack([own, again])
    joins = (doc[1:] == doc[:-1])[:, None] if len(doc) else np.zeros((0, 1), bool)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1] * joins, own[1:] * joins
    return Lines(np.concatenate([own, before, after], axis=1), size, starts)


def lines_in_steps(texts: pa.Array) -> Lines:
    """The same as lines_of, with no more memory than LEARN_BYTES or one text take, besides the lines."""
    found = [lines_of(part.column("text")) for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), step=LEARN_BYTES)]
    before = np.cumsum([0, *(p.starts[-1] for p in found)])
    starts = np.concatenate([*(p.starts[:-1] + n for p, n in zip(found, before, strict=False)), before[-1:]])
    return Lines(np.concatenate([p.features for p in found]), np.concatenate([p.length for p in found]), starts)


def _by_place(starts: np.ndarray) -> Iterator[np.ndarray]:
    """For each place of a line in its document: the lines at that place, longer documents first."""
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    base, n = starts[:-1][order], n[order]
    for k in range(int(n[0]) if len(n) else 0):
        yield base[: np.searchsorted(-n, -k, side="left")] + k


def forward_backward(emission: np.ndarray, chain: np.ndarray, starts: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the lines' labels (lines by 2), and pair marginals (2 by 2) summed with the weight of each pair's second line."""
    forward, backward = np.zeros_like(emission), np.zeros_like(emission)
    places = list(_by_place(starts))
    for k, at in enumerate(places):
        forward[at] = emission[at] if k == 0 else emission[at] + _logsum(forward[at - 1][:, :, None] + chain, 1)
    for k in range(len(places) - 2, -1, -1):
        at = places[k + 1]
        backward[at - 1] = _logsum(chain + (emission[at] + backward[at])[:, None, :], 2)
    norm = _logsum(forward + backward, 1)
    marginal = np.exp(forward + backward - norm[:, None])
    at = np.concatenate(places[1:]) if len(places) > 1 else np.zeros(0, np.int64)
    pairs = np.exp(forward[at - 1][:, :, None] + chain + (emission[at] + backward[at])[:, None, :] - norm[at][:, None, None])
    return marginal, (pairs * weight[at][:, None, None]).sum(axis=0)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _emission(lines: Lines, model: Model) -> np.ndarray:
    z = np.column_stack([(lines.features - model.mean) / model.scale, np.ones(len(lines.features))]) @ model.emission
    return np.stack([-z / 2, z / 2], axis=1)


def odds(lines: Lines, model: Model) -> np.ndarray:
    """For each document, the log-odds of the mean marginal of good, weighted by length; 0 without lines."""
    good = forward_backward(_emission(lines, model), model.chain, lines.starts, lines.length)[0][:, 1]
    run = np.concatenate([[0], np.cumsum(good * lines.length)])
    weight = np.concatenate([[0], np.cumsum(lines.length)])
    total = weight[lines.starts[1:]] - weight[lines.starts[:-1]]
    mean = np.where(total > 0, (run[lines.starts[1:]] - run[lines.starts[:-1]]) / np.maximum(total, 1), 0.5)
    mean = np.clip(mean, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def train(rows: list[tuple[str, int]], good_share: float, steps: int = STEPS, ridge: float = RIDGE) -> Model:
    """rows: texts and labels, 1 for good. good_share: that of all labelled documents, which the curve is set for."""
    n_features = 3 * OWN
    blank = Model(np.zeros(n_features), np.ones(n_features), np.zeros(n_features + 1), np.zeros((2, 2)), (1.0, 0.0))
    labels = np.array([y for _, y in rows], int)
    prior = min(max(good_share, 1e-3), 1 - 1e-3)
    if not len(rows) or labels.min() == labels.max():
        return blank._replace(curve=(0.0, float(np.log(prior / (1 - prior)))))
    lines = lines_in_steps(pa.array([t for t, _ in rows], pa.string()))
    counts = np.diff(lines.starts)
    truth = np.repeat(labels, counts)
    mean, scale = lines.features.mean(axis=0), lines.features.std(axis=0) + 1e-3
    x = np.column_stack([(lines.features - mean) / scale, np.ones(len(lines.features))])
    # each class weighs the same, and a document as much as another, however many lines it has
    share = np.bincount(labels, minlength=2)
    weight = np.repeat(0.5 / share[labels] / np.maximum(counts, 1), counts)
    model = blank._replace(mean=mean, scale=scale)
    docs_weight = (0.5 / share[labels] / np.maximum(counts, 1))[counts > 0]
    emission, chain = model.emission.copy(), model.chain.copy()
    seen, seen_chain = np.zeros_like(emission), np.zeros_like(chain)
    both = np.zeros((2, 2))
    for y in (0, 1):
        both[y, y] = (np.maximum(counts - 1, 0)[counts > 0] * docs_weight)[labels[counts > 0] == y].sum()
    for _ in range(steps):
        model = model._replace(emission=emission, chain=chain)
        marginal, pairs = forward_backward(_emission(lines, model), chain, lines.starts, weight)
        slope = x.T @ ((marginal[:, 1] - truth) * weight) + ridge * emission
        slope_chain = pairs - both + ridge * chain
        seen += slope**2
        seen_chain += slope_chain**2
        emission = emission - 0.3 * slope / (np.sqrt(seen) + 1e-8)
        chain = chain - 0.1 * slope_chain / (np.sqrt(seen_chain) + 1e-8)
    model = model._replace(emission=emission, chain=chain)
    return model._replace(curve=_curve(odds(lines, model), labels, prior))


def _curve(x: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and intercept of the logistic curve over x, for classes in the proportion of prior (Newton's method)."""
    share = np.bincount(labels, minlength=2)
    weight = np.where(labels == 1, prior / share[1], (1 - prior) / share[0])
    z = np.column_stack([x, np.ones(len(x))])
    at = np.array([0.5, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ at, -30, 30)))
        hessian = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(hessian, z.T @ (weight * (p - labels)) + 1e-3 * at)
    return max(float(at[0]), 1e-3), float(at[1])


def quality(texts: pa.Array, model: Model) -> np.ndarray:
    value = model.curve[0] * odds(lines_of(texts), model) + model.curve[1]
    return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the probability of good quality as name; a column of docs with that name (in any case) gives way, all rows stay.

    A text that is null, empty or white space has no lines; its score is what the curve gives for even odds. Repeated
    texts get equal scores; one of any length is taken whole, at about 50 bytes of memory a byte. An empty table gives none.
    """
    from pyspark.sql import types as T

    names = others(docs, [name])
    held = docs.sparkSession.sparkContext.broadcast(tuple(model))  # a few hundred numbers; a plain tuple, so that executors need no class

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(quality(part.column("text"), Model(*held.value)))], names=[*names, name])

    docs = docs.select(*names)
    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.DoubleType())]))


def learn(docs: DataFrame, labels: DataFrame, where) -> Model:
    """The field from rows of labels (doc_id, quality) that where names; see labelled_sample for their bound."""
    share = labels.where(where).agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return train(labelled_sample(docs, labels, "quality", where, LEARNED_DOCS), 0.5 if share is None else share)


def op2_quality(spark, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labelled ones that aren't held out."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    out = crc_mod("doc_id", 5) == 0
    scored = score(docs.select("doc_id", "text"), learn(docs, labels, ~out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
