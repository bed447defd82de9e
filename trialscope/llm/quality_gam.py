"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits shallow trees, one feature at a time, on histograms of binned features; each
tree is added to the feature's lookup table, later to the tables of the strongest pairs. A score is
a sum of table entries. Only numpy is used for training, on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import bounded_sample, release, small_batches, text_of

FEATURES = ["log_chars", "word_chars", "upper", "bang", "symbols", "bars", "digits", "stops", "line_words", "distinct", "adjacent", "top_word", "short", "line_repeat", "non_ascii", "long_words"]

#: The bytes that the shares of characters count.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "bang": b"!?",
    "symbols": b"#$%&*@^~=+<>{}[]\\",
    "bars": b"|/_",
    "digits": b"0123456789",
    "stops": b".,;:",
}


def text_features(text: str) -> list[float]:
    """The features of a whole text; an empty one gets zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(FEATURES)
    words, lines = raw.split(), raw.split(b"\n")
    n, nw = len(raw), max(1, len(words))
    share = {k: (n - len(raw.translate(None, c))) / n for k, c in _CLASSES.items()}
    sizes = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    kinds = Counter(words)
    return [
        float(np.log1p(n)),
        float(sizes.mean()),
        *share.values(),
        nw / len(lines),
        len(kinds) / nw ** 0.9,
        sum(map(eq, words, words[1:])) / nw,
        max(kinds.values(), default=0) / nw,
        float((sizes <= 3).mean()),
        1 - len(set(lines)) / len(lines),
        (n - len(text)) / n,
        float((sizes > 12).mean()),
    ]


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """id, other columns if named, and features of every whole text; null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = np.array([text_features(t) for t in b.column(1).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(b.column(c) for c in others), *(pa.array(c) for c in x.T)], names=["id", *others, *FEATURES])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, " + "".join(f"`{c}` {kinds[c]}, " for c in others) + ", ".join(f"{f} double" for f in FEATURES)).withColumnRenamed("id", id_col)


@dataclass
class Gam:
    """Lookup tables: intercept, cut points and a table per feature, and tables of pairs over coarse bins."""

    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of table entries for each row of features."""
        out = np.full(len(x), self.intercept)
        for j, (cuts, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += table[np.searchsorted(cuts, x[:, j], "right")]
        coarse = {j: np.searchsorted(self.pair_cuts[j], x[:, j], "right") for pair in self.pairs for j in pair}
        for (i, j), table in self.pairs.items():
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cut_points(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins with gradients g and hessians h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + 1) + gr**2 / (hr + 1), -np.inf)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) and np.isfinite(gain.max()) else (-np.inf, 0)


def _tree(g: np.ndarray, h: np.ndarray, least: float) -> np.ndarray:
    """A tree of at most four leaves over bins, as the step of each bin."""
    out = np.zeros(len(g))
    regions = [(0, len(g))]
    for _ in range(2):
        split = []
        for a, b in regions:
            gain, at = _best_cut(g[a:b], h[a:b], least)
            split += [(a, a + at), (a + at, b)] if at and gain > g[a:b].sum() ** 2 / (h[a:b].sum() + 1) else [(a, b)]
        regions = split
    for a, b in regions:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[np.ndarray, float]:
    """A tree of at most four leaves over a grid of bins, and its gain."""
    out = np.zeros_like(g)
    regions = [(0, g.shape[0], 0, g.shape[1])]
    for _ in range(2):
        split = []
        for a, b, c, d in regions:
            (ga, at_a), (gb, at_b) = _best_cut(g[a:b, c:d].sum(1), h[a:b, c:d].sum(1), least), _best_cut(g[a:b, c:d].sum(0), h[a:b, c:d].sum(0), least)
            if not at_a and not at_b:
                split.append((a, b, c, d))
            elif ga >= gb:
                split += [(a, a + at_a, c, d), (a + at_a, b, c, d)]
            else:
                split += [(a, b, c, c + at_b), (a, b, c + at_b, d)]
        regions = split
    gain = 0.0
    for a, b, c, d in regions:
        gs, hs = g[a:b, c:d].sum(), h[a:b, c:d].sum()
        out[a:b, c:d] = gs / (hs + 1)
        gain += gs**2 / (hs + 1)
    return out, float(gain)


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 80, pair_rounds: int = 30, n_pairs: int = 10, bins: int = 48, pair_bins: int = 8, rate: float = 0.15, least: float = 2.0) -> Gam:
    """Boost single features in turn, choose the pairs that explain most of the rest, boost those in turn.

    Without rows, or with one class only, the model is the smoothed prior alone.
    """
    p = (y.sum() + 1) / (len(y) + 2)
    cuts = [_cut_points(x[:, j], bins) for j in range(x.shape[1])]
    pair_cuts = [_cut_points(x[:, j], pair_bins) for j in range(x.shape[1])]
    gam = Gam(float(np.log(p / (1 - p))), cuts, [np.zeros(len(c) + 1) for c in cuts], pair_cuts)
    if not len(y) or y.min() == y.max():
        return gam
    at = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    coarse = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(pair_cuts)]
    margin = np.full(len(y), gam.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-margin))
        return y - q, q * (1 - q)

    for _ in range(rounds):
        for j, table in enumerate(gam.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(at[j], g, len(table)), np.bincount(at[j], h, len(table)), least)
            table += step
            margin += step[at[j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]:
        shape = (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1)
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        return np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape), cell, shape

    gains = {(i, j): _pair_tree(*grid(i, j)[:2], least)[1] for i, j in combinations(range(x.shape[1]), 2)}
    for pair in sorted(gains, key=lambda p: (-gains[p], p))[:n_pairs]:
        gam.pairs[pair] = np.zeros((len(pair_cuts[pair[0]]) + 1, len(pair_cuts[pair[1]]) + 1))
    for _ in range(pair_rounds):
        for (i, j), table in gam.pairs.items():
            g, h, cell, _ = grid(i, j)
            step = rate * _pair_tree(g, h, least)[0]
            table += step
            margin += step.ravel()[cell]
    return gam


def in_fold(id_col: str, folds: int, held_out: int) -> Column:
    """Whether crc32(id as text) mod folds is held_out; a null id counts as the text of nothing."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_out


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, learn: Column, id_col: str, text_col: str, most: int) -> pa.Table:
    """_label and features of at most `most` labelled rows for which learn holds, those of least hash of the id.

    Ids are chosen among the labels first, so that only the chosen rows' features are computed.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias("_label"))
    ids = docs.select(id_col).where(learn).join(known, id_col).distinct()
    chosen = bounded_sample(ids, id_col, most)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text")).join(F.broadcast(chosen.select(F.col(id_col).alias("_id"), "_label")), "_id")
    return feature_table(rows, "_id", "_text", ("_label",)).select("_label", *FEATURES).toArrow()


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, folds: int, held_out: int, train_rows: int) -> Gam:
    """The model of at most train_rows labelled rows outside the held-out fold."""
    sample = labelled_sample(docs, labels, "quality", ~in_fold(id_col, folds, held_out), id_col, text_col, train_rows)
    release(docs.sparkSession)
    return fit_gam(np.column_stack([sample[f].to_numpy() for f in FEATURES]), sample["_label"].to_numpy().astype(np.float64))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.3, train_rows: int = 50_000) -> DataFrame:
    """The rows of docs, with all their columns, whose score is threshold or more; no text is shuffled.

    Cases are defined as for score_quality(); each row is judged by its own text, also where ids repeat.
    """
    gam = fit_quality(docs, labels, id_col, text_col, folds, held_out, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = np.array([text_features(t or "") for t in b.column(text_col).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(gam.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out: int = 0, threshold: float = 0.3, train_rows: int = 50_000) -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    The model is fitted on at most train_rows labelled rows outside the held-out fold; its tables (some
    ten thousand numbers, whatever the input's size) go with the scoring function to the executors.

    Defined cases: null text scores as empty text, of which all features are 0; a null id is in the
    fold of the empty text and has no label; repeated rows are scored alike; a very long text is one
    row of a batch; labels that are null are left out, and of several labels of an id the largest
    holds. Without labels the score is 0.5. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    gam = fit_quality(docs, labels, id_col, text_col, folds, held_out, train_rows)
    marked = docs.select(F.col(id_col).alias("id"), in_fold(id_col, folds, held_out).alias("held_out"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            x = np.array([text_features(t) for t in b.column(2).to_pylist()], np.float64).reshape(-1, len(FEATURES))
            score = gam.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return marked.mapInArrow(run, f"id {dict(marked.dtypes)['id']}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
