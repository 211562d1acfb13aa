"""Toxicity by a classifier chain.

Categories are predicted in order by logistic regressions over word features; each one also gets the probabilities
of the earlier categories.  While training, those come from out-of-fold predictions, so that a later model
learns from inputs as uncertain as the ones it will meet.  The categories are those that labels tell, and before the
last of them its kinds: clusters of the texts that have it, by the features that tell it best.

Training takes a bounded sample of labelled rows (``SAMPLE_ROWS``), written once; feature counts and feature rows of the
sample are made by Spark tasks, and only the sample's compact feature rows reach the driver, where the small
regressions are solved.  Scoring is one pass over all texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.llm.common import text_slices, written

SAMPLE_ROWS = 16_000  #: most labelled rows that training reads, chosen by a hash of the id
FEATURES = 512  #: most features, shared equally by the labelled categories
KINDS = 2  #: clusters of the last category's texts
LEAST_KIND = 8  #: texts that a cluster has on average, at least; with fewer there are fewer clusters
FOLDS = 3
RIDGE = 0.1
LEAST_DOCS = 4
WORDS = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)  #: word beginnings that count as features too, so that inflected forms share their evidence


def features(text: str | None) -> set[str]:
    """Lower-case words and word beginnings (marked by a trailing hyphen) that occur in a text."""
    words = set(WORDS.findall((text or "").lower()))
    found = set(words)
    for n in PREFIXES:
        found.update({w[:n] + "-" for w in words if len(w) >= n})
    return found


@dataclass
class Chain:
    """A fitted chain: the features, and for each category the weights (features, earlier categories, bias)."""

    categories: list[str]
    vocabulary: dict[str, int] = field(default_factory=dict)
    weights: list[np.ndarray] = field(default_factory=list)

    def active(self, text: str | None) -> list[int]:
        at = self.vocabulary
        return [at[f] for f in features(text) & at.keys()]

    def probabilities(self, rows: list[list[int]]) -> np.ndarray:
        """One row for each list of active features, one column for each category."""
        out = np.zeros((len(rows), len(self.categories)))
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((f for r in rows for f in r), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(rows)), lengths)
        n = len(self.vocabulary)
        for j, w in enumerate(self.weights):
            out[:, j] = probability(np.bincount(owner, w[:n][flat], len(rows)) + out[:, :j] @ w[n : n + j] + w[-1])
        return out


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -8, 8)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the last weight is the bias.  Without examples of both
    classes only the bias differs from zero."""
    n = x.shape[1]
    w = np.zeros(n + 1)
    if not len(y) or y.min() == y.max():
        w[-1] = 8.0 if len(y) and y[0] else -8.0
        return w
    penalty = np.full(n + 1, ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        gradient, curvature = -penalty * w, np.diag(penalty)
        for k in range(0, len(x), 1_024):  # in blocks of rows, so that no second matrix of the whole sample is made
            block = np.hstack([x[k : k + 1_024], np.ones((len(x[k : k + 1_024]), 1))]).astype(np.float64)
            p = 1 / (1 + np.exp(-np.clip(block @ w, -30, 30)))
            gradient += block.T @ (y[k : k + 1_024] - p)
            curvature += (block * (p * (1 - p) + 1e-9)[:, None]).T @ block
        step = np.linalg.solve(curvature, gradient)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return w


def fit_chain(x: np.ndarray, labels: np.ndarray, folds: np.ndarray, own: list[list[int]] | None = None) -> list[np.ndarray]:
    """Weights of each category; ``x`` 0/1 features, ``labels`` a column per category, ``folds`` the fold of each row, and
    ``own`` the features that each category's model uses (all if not given; the others weigh nothing)."""
    weights, width = [], x.shape[1]
    earlier = np.zeros((len(x), labels.shape[1]), np.float32)  # out-of-fold probabilities
    for j in range(labels.shape[1]):
        used = np.arange(width) if own is None else np.array(own[j], np.int64)
        y, inputs = labels[:, j], np.hstack([x[:, used], earlier[:, :j]])
        fitted = logistic(inputs, y)
        weights.append(np.zeros(width + j + 1))
        weights[-1][used], weights[-1][width:] = fitted[: len(used)], fitted[len(used) :]
        for k in np.unique(folds):
            held = folds == k
            w = logistic(inputs[~held], y[~held])
            earlier[held, j] = probability(inputs[held] @ w[:-1] + w[-1])
    return weights


def kinds_of(x: np.ndarray, most: int, rounds: int = 20) -> np.ndarray:
    """The cluster (0 to ``most`` - 1) of each 0/1 feature row by cosine k-means; a row without features is in none (-1).
    The first centre is the mean, each further one the row that is farthest from those before."""
    lengths = np.sqrt(x.sum(axis=1))
    some = lengths > 0
    k = min(most, int(some.sum()) // LEAST_KIND)
    out = np.full(len(x), -1)
    if k < 1:
        return out
    unit = (x[some] / lengths[some, None]).astype(np.float64)
    centres = [unit.mean(axis=0)]
    for _ in range(k):
        centres.append(unit[(unit @ np.array(centres).T).max(axis=1).argmin()])
    centres = np.array(centres[1:])
    for _ in range(rounds):
        own = (unit @ centres.T).argmax(axis=1)
        moved = np.array([unit[own == c].mean(axis=0) if (own == c).any() else centres[c] for c in range(k)])
        moved /= np.maximum(np.sqrt((moved**2).sum(axis=1, keepdims=True)), 1e-12)
        if np.allclose(moved, centres):
            break
        centres = moved
    out[some] = own
    return out


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, n, hits): in how many texts each feature is, and in how many of each category."""
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        labels = np.array([c.to_numpy() for c in batch.columns[2:]]).T
        for text, flags in zip(batch.column(1).to_pylist(), labels):
            row = np.append(1, flags)
            for f in features(text):
                if f in seen:
                    seen[f] += row
                else:
                    seen[f] = row.copy()
    if seen:
        counts = np.array(list(seen.values()), np.int64)
        hits = pa.FixedSizeListArray.from_arrays(pa.array(counts[:, 1:].ravel()), counts.shape[1] - 1).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(counts[:, 0]), hits], ["feature", "n", "hits"])


def _feature_rows(chain: Chain, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [chain.active(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.int32())), *batch.columns[2:], batch.column(0)], ["active", *names, "fold"])

    return run


def _best_features(sample: DataFrame, names: list[str], n_features: int) -> dict[str, list[str]]:
    """The features that tell each category best: an equal part of ``n_features`` each."""
    sizes = sample.agg(F.count(F.lit(1)), *[F.sum(F.col(c)) for c in names]).first()
    counted = sample.mapInArrow(_count_features, "feature string, n long, hits array<long>").groupBy("feature")
    counted = written(counted.agg(F.sum("n").alias("n"), *[F.sum(F.col("hits")[j]).alias(f"k{j}") for j in range(len(names))]).where(F.col("n") >= LEAST_DOCS), "feature-counts")
    best = {}
    for j, name in enumerate(names):
        rows, hits = sizes[0], sizes[j + 1] or 0
        if not hits or hits == rows:
            best[name] = []
            continue
        share, of_hits, of_rest = F.col("n") / rows, F.col(f"k{j}") / hits, (F.col("n") - F.col(f"k{j}")) / (rows - hits)
        score = F.abs(of_hits - of_rest) / F.sqrt(share * (1 - share) + 1e-6)
        best[name] = [r.feature for r in counted.orderBy(score.desc(), "feature").limit(n_features // len(names)).collect()]  # n_features rows at most
    return best


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, n_features: int = FEATURES, folds: int = FOLDS, kinds: int = KINDS) -> Chain:
    """Fits the chain of ``categories``, in their order, with up to ``kinds`` clusters of the last one's texts before it.

    ``labels`` has the id and whatever label columns the category conditions name; conditions may also use the
    text as ``text``.  A null condition counts as no.  Rows whose id is null or has no document are left out;
    repeated labels are examples each.  Without labelled rows every probability is almost zero.
    """
    names = list(categories)
    last = names[-1]
    chosen = labels.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample_rows)
    # at most sample_rows narrow rows: safe to broadcast at any corpus size
    texts = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    joined = texts.join(F.broadcast(chosen.drop("text")), id_col)
    flags = [F.coalesce(condition.cast("int"), F.lit(0)).alias(name) for name, condition in categories.items()]
    sample = written(joined.select(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(folds)).cast("int").alias("fold"), "text", *flags), "labelled-texts")
    best = _best_features(sample, names, n_features)
    chain = Chain(names, {f: i for i, f in enumerate(sorted(set().union(*best.values())))})
    found = sample.mapInArrow(_feature_rows(chain, names), f"active array<int>, {', '.join(f'`{c}` int' for c in names)}, fold int").toArrow()  # sample_rows rows at most
    found = found.sort_by([(c, "ascending") for c in ["fold", *names]])
    active = found.column("active").combine_chunks()
    x = np.zeros((found.num_rows, len(chain.vocabulary)), np.float32)
    x[np.repeat(np.arange(found.num_rows), active.value_lengths().to_numpy()), active.flatten().to_numpy()] = 1
    y = {c: found.column(c).to_numpy().astype(float) for c in names}
    of_last = y[last] > 0
    kind = np.full(found.num_rows, -1)
    kind[of_last] = kinds_of(x[of_last][:, [chain.vocabulary[f] for f in best[last]]], kinds)
    y = {c: y[c] for c in names[:-1]} | {f"{last}_{k + 1}": (kind == k).astype(float) for k in range(kind.max(initial=-1) + 1)} | {last: y[last]}
    chain.categories = list(y)
    own = [[chain.vocabulary[f] for f in best.get(c, best[last])] for c in y]  # kinds are told by the last category's features
    chain.weights = fit_chain(x, np.array(list(y.values())).T.reshape(found.num_rows, len(y)), found.column("fold").to_numpy(), own)
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep=()) -> DataFrame:
    """(id, p_<category> ...): probabilities of every whole text, in one pass; ``keep`` columns come along.

    A text without words, null included, has probability 0 throughout; null ids and repeated rows come back as they are.
    """

    first = 0 if text_col in keep else 1  # the text itself leaves the task only if it is to be kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0, 8_000_000):
            texts = part.column(0).to_pylist()
            p = chain.probabilities([chain.active(t) for t in texts])
            p[[not WORDS.search(t or "") for t in texts]] = 0
            yield pa.RecordBatch.from_arrays([*part.columns[first:], *[pa.array(p[:, j]) for j in range(p.shape[1])]], [*part.schema.names[first:], *names])

    names = [f"p_{c}" for c in chain.categories]
    source = docs.select(F.col(text_col), F.col(id_col), *[F.col(c) for c in keep if c != text_col])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[first:]]
    return source.mapInArrow(run, ", ".join([*kinds, *[f"`{n}` double" for n in names]]))
