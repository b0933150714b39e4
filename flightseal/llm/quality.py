"""Quality rules judged by an isolation forest.

Each text gives rule statistics. Trees of random splits are grown on small
samples of labelled good rows; a document that few splits isolate has a short
mean path and a high score. The threshold is read from all labelled rows: the
one that rejects most bad rows among those that keep nearly all good ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import columns, map_batches, small_batches, texts, tidy

#: Bounded fit: at most TREES * SAMPLE labelled rows are read by the driver, whatever the input.
TREES, SAMPLE = 100, 256
#: Largest share of good labelled rows that the threshold may reject.
GOOD_LOSS = 0.005
SCORE_STEPS = 10_000

SPACES, SYMBOLS = " \t\n\r\x0b\x0c", "#*$%&|<>"
WINDOW = 5
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
EXTRA = ("n_upper", "n_marks")
COUNTS = BASE + EXTRA
COUNT_SCHEMA = ", ".join(f"{name} long" for name in COUNTS)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more in the text."""
    last = len(words) - WINDOW
    if last < 1:
        return 0
    windows = list(zip(*(words[i : last + 1 + i] for i in range(WINDOW))))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict[tuple, int] = {}
    again = np.zeros(last + 1, bool)
    for i, window in enumerate(windows):
        first = seen.setdefault(window, i)
        if first != i:
            again[first] = again[i] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(again)[0]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS of a whole text; null has no words and counts zero everywhere."""
    text = text or ""
    words = text.encode().split()
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACES)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        sum(map(str.isupper, text)) if not text.isascii() else len(text) - len(text.translate(_NO_UPPER)),
        text.count("!") + text.count("?"),
    )


_NO_UPPER = {c: None for c in range(ord("A"), ord("Z") + 1)}


def base_failed(n_words, n_repeat_words):
    """The fixed rules; for columns and numpy arrays alike."""
    return (n_words < 10) | (100 * n_repeat_words > 20 * n_words)


def features(counts: np.ndarray) -> np.ndarray:
    """Rates from COUNTS, one row per document."""
    words, chars, symbols, lines, repeats, upper, marks = np.asarray(counts, float).T
    per = np.maximum(words, 1)
    return np.stack([np.log1p(words), chars / per, symbols / per, lines / per, repeats / per, upper / per, marks / per], 1)


def _mean_path(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(rows: np.ndarray, rng: np.random.Generator, limit: int, scale: np.ndarray) -> tuple[np.ndarray, ...]:
    """A tree as arrays: feature (-1: leaf), cut, left child (right: the next), path length.

    Cuts are drawn from somewhat more than the range of the rows, so that a
    document beyond all good ones soon falls into an empty leaf.
    """
    feature, cut, child, path = [], [], [], []

    def node():
        for column, value in ((feature, -1), (cut, 0.0), (child, 0), (path, 0.0)):
            column.append(value)
        return len(feature) - 1

    todo = [(node(), rows, 0)]
    while todo:
        at, part, depth = todo.pop()
        if depth == limit or len(part) <= 1:
            path[at] = depth + _mean_path(len(part))
            continue
        f = rng.integers(part.shape[1])
        low, high = part[:, f].min(), part[:, f].max()
        margin = 0.5 * (high - low) + 0.05 * scale[f]
        feature[at], cut[at] = f, rng.uniform(low - margin, high + margin)
        left = part[:, f] < cut[at]
        child[at], _ = node(), node()
        todo += [(child[at], part[left], depth + 1), (child[at] + 1, part[~left], depth + 1)]
    return np.array(feature), np.array(cut), np.array(child), np.array(path)


def fit(counts: np.ndarray, seed: int, trees: int = TREES, sample: int = SAMPLE) -> list[tuple]:
    """A forest from at most trees * sample rows, each used by one tree if there are enough."""
    rng, rows = np.random.default_rng(seed), features(counts)
    if not len(rows):
        return []
    size = min(sample, len(rows))
    order = np.concatenate([rng.permutation(len(rows)) for _ in range(math.ceil(trees * size / len(rows)))])
    limit, scale = math.ceil(math.log2(max(2, size))) + 4, np.ptp(rows, 0) + 0.05
    return [_grow(rows[order[t * size : (t + 1) * size]], rng, limit, scale) for t in range(trees)]


def scores(forest: list[tuple], counts: np.ndarray, sample: int) -> np.ndarray:
    """2 ** (-mean path / path of a search among `sample` rows): near 1 is an anomaly. No forest: zeros."""
    rows = features(counts)
    total, every = np.zeros(len(rows)), np.arange(len(rows))
    for feature, cut, child, path in forest:
        at = np.zeros(len(rows), np.int64)
        while (inner := feature[at] >= 0).any():
            f = feature[at]
            step = child[at] + (rows[every, np.maximum(f, 0)] >= cut[at])
            at = np.where(inner, step, at)
        total += path[at]
    return 2.0 ** (-total / len(forest) / max(1e-9, _mean_path(sample))) if forest else total


def steps(forest, counts, sample) -> np.ndarray:
    """Scores as whole steps, so that thresholds compare exactly."""
    return np.round(scores(forest, counts, sample) * SCORE_STEPS).astype(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS) of every row, in one pass over the texts."""

    def run(batch):
        ids, bodies = columns(batch, "doc_id", "text")
        return [ids, *zip(*map(statistics, bodies))] if ids else None

    return map_batches(texts(docs), run, f"doc_id long, {COUNT_SCHEMA}")


def calibrate(stats: DataFrame, labels: DataFrame, seed: int = 17, good_loss: float = GOOD_LOSS):
    """(forest, sample size, threshold in steps) from labelled rows that pass the fixed rules.

    labels: doc_id, quality (1 good, 0 bad; null is no label; of repeated labels
    the smallest counts). The trees see at most TREES * SAMPLE good rows, those
    with the smallest hashes; the threshold sees every labelled row, as counts
    per score step. Without good rows nothing is rejected by the forest.
    """
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(marks, "doc_id")
    known = materialize(known.select("doc_id", "quality", *COUNTS), "quality-labelled")
    chosen = known.where("quality = 1").orderBy(F.xxhash64(F.lit(seed), "doc_id"), *COUNTS).limit(TREES * SAMPLE)
    rows = np.array([tuple(r) for r in chosen.select(*COUNTS).collect()], float).reshape(-1, len(COUNTS))
    forest, size = fit(rows, seed), min(SAMPLE, len(rows))

    def run(batch):
        counts = np.array(columns(batch, *COUNTS)).T
        return [batch.column("quality").to_pylist(), steps(forest, counts, size)] if batch.num_rows else None

    found = map_batches(known, run, "quality int, step long").groupBy("quality", "step").count().collect()
    return forest, size, threshold({(r["quality"], r["step"]): r["count"] for r in found}, good_loss)


def threshold(found: dict[tuple[int, int], int], good_loss: float) -> int:
    """Reject above this step: most bad rows, at most `good_loss` of the good; ties take the highest step.

    Without good rows there is nothing to measure the loss by: nothing is rejected.
    """
    good = sum(n for (quality, _), n in found.items() if quality == 1)
    if not good:
        return SCORE_STEPS
    best, lost, caught, most = SCORE_STEPS, 0, 0, 0
    for step in sorted({s for _, s in found}, reverse=True):
        lost, caught = lost + found.get((1, step), 0), caught + found.get((0, step), 0)
        if lost > good_loss * good:
            break
        if caught > most:
            best, most = step - 1, caught
    return best


def _verdict(model, counts: np.ndarray):
    forest, size, limit = model
    step = steps(forest, counts, size)
    failed = base_failed(counts[:, 0], counts[:, 4])
    return step, failed, ~failed & (step <= limit)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, COUNTS, score, base_failed, kept) of every row.

    Null and empty texts have no words and fail; repeated rows keep a row each;
    other columns are not read; an empty table gives no rows.
    """
    stats = materialize(counted(docs), "quality-stats")
    model = calibrate(stats, labels)

    def run(batch):
        data = columns(batch, "doc_id", *COUNTS)
        if not data[0]:
            return None
        step, failed, kept = _verdict(model, np.array(data[1:]).T)
        return [*data, step / SCORE_STEPS, failed, kept]

    return map_batches(stats, run, f"doc_id long, {COUNT_SCHEMA}, score double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that `judge` keeps, without a shuffle of the texts: they are counted again where they lie."""
    model = calibrate(materialize(counted(docs), "quality-stats"), labels)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                counts = np.array([statistics(t) for t in batch.column("text").to_pylist()])
                yield batch.filter(pa.array(_verdict(model, counts)[2]))

    return small_batches(docs).mapInArrow(tidy(run), docs.schema)
