"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

Two models, one of toxic and one of ordinary labelled documents, give each letter of a word a
probability after the five before it. Each discounts the class's own counts and backs off to one
shared Kneser-Ney model of both classes (its counts at the top order, continuation counts below),
with the discounted mass and BACKOFF sightings more for each different symbol after the context, so
that an expression that a class has hardly seen gets nearly the same probability in both, in a small
corpus as in a large one. Grams start anew at each word: with grams across
words, rare beginnings of words fall into contexts that are too rare to tell the classes apart.

A word's log ratio is its log-likelihood in the toxic class less that in the ordinary class. A
document is scored by the mean of it over all its words, which is the length-normalised difference of
the two models' log-likelihoods of the whole text, and by the part of it above MARGIN that single
words add.

The models are Spark tables of exact counts, which grow with the corpus. Tasks that score get a table
of fixed size, of the most frequent contexts; what a text has of other contexts is joined by shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialscope.llm.common import bounded_sample, drop_path, has_bits, key_bits, kept_table, release, small_batches, text_of
from trialscope.llm.quality_gam import in_fold

#: Symbols of a class's own counts; the shared model has one less, down to one.
ORDER = 6
DISCOUNT = 0.75
#: Sightings that the shared model counts as, in each class's model, for each different symbol that follows the context: the
#: more ways a context goes on, the more of them it takes to know it. It weighs alike whatever the corpus's size.
BACKOFF = 20.0
#: Sightings for each different symbol from which a context has counts of its own in the classes' models; rarer ones use the
#: shared model alone, which leaves a log ratio of zero: theirs would be log(1 + SEEN / BACKOFF) a gram at most, or 0.18.
SEEN = 4
#: Log ratio above which a word by itself speaks for the toxic class.
MARGIN = 1.0
#: Marks before and after a word (white space, so that no word has them).
BEFORE, AFTER = "\t", "\n"
#: Words that each half of a worker's memory holds, and words that a counting task gathers before it hands on their grams.
REMEMBERED, GATHERED = 100_000, 100_000
#: Grams in the table that scoring tasks get: it holds whole contexts, and at most as many of these.
TABLE_GRAMS = 1 << 20
#: Bits of the filter of the other contexts; it spares asking for unknown ones and loses none.
FILTER_BITS = 22
#: Tasks over which the askers of one context are dealt.
SALTS = 8
COUNTS = ("n0", "n1", "m0", "m1")


def tokens(text: str) -> list[str]:
    return text.lower().split()


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of the words as rows of ORDER code points, and the number of each gram's word."""
    marks = BEFORE * (ORDER - 1)
    codes = np.frombuffer("".join([f"{marks}{w}{AFTER}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.lib.stride_tricks.sliding_window_view(codes, ORDER)[codes[ORDER - 1 :] != ord(BEFORE)] if words else np.zeros((0, ORDER), np.uint32)
    return rows, np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1)


def keys(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit keys of the contexts and of the whole grams."""
    h = np.full(len(rows), 0x243F6A8885A308D3, np.uint64)
    for j in range(ORDER - 1):
        h = _mixed(h ^ rows[:, j])
    return h, gram_key(h, rows[:, ORDER - 1])


def gram_key(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return _mixed(context ^ (symbol.astype(np.uint64) + np.uint64(1 << 40)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(29))


def count_grams(rows: DataFrame) -> DataFrame:
    """gram, n0, n1, m0, m1: how often each gram stands in texts of either class, and in those of them with `apart`.

    rows has text, label (0 or 1) and, if wanted, apart. A task gathers words first and hands on sums
    of their grams.
    """

    def handed_on(seen: dict[str, list[int]]) -> pa.RecordBatch:
        grams, owner = windows(list(seen))
        _, whole = keys(grams)
        _, first, of = np.unique(whole, return_index=True, return_inverse=True)
        counts = np.array(list(seen.values()), np.float64)[owner]
        names = grams[first].tobytes().decode("utf-32-le", "surrogatepass")
        sums = [pa.array(np.bincount(of, counts[:, c], len(first)).astype(np.int64)) for c in range(4)]
        return pa.RecordBatch.from_arrays([pa.array([names[i : i + ORDER] for i in range(0, len(names), ORDER)], pa.string()), *sums], names=["gram", *COUNTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for b in small_batches(batches):
            for text, label, apart in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for w, n in Counter(tokens(text)).items():
                    counts = seen.setdefault(w, [0, 0, 0, 0])
                    counts[label] += n
                    if apart:
                        counts[2 + label] += n
            if len(seen) > GATHERED:
                yield handed_on(seen)
                seen = {}
        if seen:
            yield handed_on(seen)

    rows = rows.select("text", "label", "apart" if "apart" in rows.columns else F.lit(False).alias("apart"))
    counted = rows.mapInArrow(run, "gram string, " + ", ".join(f"{c} long" for c in COUNTS))
    return counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in COUNTS))


def backed_off(c: Column, kinds: Column, total: Column, p: Column) -> Column:
    """The discounted share of c in total, and what discounts leave, times p."""
    return (F.greatest(c - DISCOUNT, F.lit(0.0)) + DISCOUNT * kinds * p) / total


def shared_probabilities(grams: DataFrame, order: int) -> DataFrame:
    """gram, p: the shared model's probability of the last symbol of each gram of `order` symbols.

    grams has those of the order above; a gram counts here as often as there are different ones
    that end in it. At most as many grams as there are symbols share a context or a suffix, so no
    window or join is skewed.
    """
    level = grams.groupBy(F.expr(f"substring(gram, 2, {order})").alias("gram")).agg(F.count(F.lit(1)).alias("c"))
    if order == 1:
        return level.select("gram", (F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(0)))).alias("p"))
    level, _ = kept_table(level, f"grams-{order}")
    context = Window.partitionBy(F.expr(f"substring(gram, 1, {order - 1})"))
    placed = level.withColumns({"total": F.sum("c").over(context), "kinds": F.count(F.lit(1)).over(context), "suffix": F.expr(f"substring(gram, 2, {order - 1})")})
    lower = shared_probabilities(level, order - 1).withColumnRenamed("gram", "suffix")
    return placed.join(lower, "suffix").select("gram", backed_off(F.col("c"), F.col("kinds"), F.col("total"), F.col("p")).alias("p"))


def class_probability(n: Column, total: Column, kinds: Column, backoff: Column, p: Column) -> Column:
    """A class's own probability of a symbol seen n times in a context, backed off to p of the shared model."""
    return (F.greatest(n - DISCOUNT, F.lit(0.0)) + (backoff + DISCOUNT * kinds) * p) / (total + backoff)


def gram_ratios(grams: DataFrame) -> DataFrame:
    """gram, total, p0, p1, ratio, base (and m_ratio, m_base): what the models say of each gram of a context seen SEEN times a symbol.

    total is how often its context was seen; p0 and p1 are the classes' probabilities of its last
    symbol; ratio is the log of p1 / p0. base is that of any symbol that neither class has seen in the
    context (its shared probability cancels out); any other context says nothing.
    m_ratio and m_base are of models that have not counted the rows apart.
    """
    context, lower = Window.partitionBy("context"), shared_probabilities(grams, ORDER - 1).withColumnRenamed("gram", "suffix")
    own = grams.select("gram", F.expr(f"substring(gram, 1, {ORDER - 1})").alias("context"), F.expr(f"substring(gram, 2, {ORDER - 1})").alias("suffix"), "n0", "n1", (F.col("n0") - F.col("m0")).alias("l0"), (F.col("n1") - F.col("m1")).alias("l1"))
    own = own.withColumns({f"t_{c}": F.sum(c).over(context) for c in ("n0", "n1", "l0", "l1")} | {f"k_{c}": F.count_if(F.col(c) > 0).over(context) for c in ("n0", "n1", "l0", "l1")} | {"kinds": F.count(F.lit(1)).over(context), "l_kinds": F.count_if(F.col("l0") + F.col("l1") > 0).over(context)})
    own = own.join(lower, "suffix").withColumn("total", F.col("t_n0") + F.col("t_n1")).where(F.col("total") >= SEEN * F.col("kinds"))
    own = own.withColumn("p", backed_off(F.col("n0") + F.col("n1"), F.col("kinds"), F.col("total"), F.col("p")))

    def backoff(c: str) -> Column:
        return BACKOFF * (F.col("kinds") if c[0] == "n" else F.greatest("l_kinds", F.lit(1)))

    def of(c: str) -> Column:
        return class_probability(F.col(c), F.col(f"t_{c}"), F.col(f"k_{c}"), backoff(c), F.col("p"))

    def base(c: str) -> Column:
        return F.log((backoff(c) + DISCOUNT * F.col(f"k_{c}")) / (backoff(c) + F.col(f"t_{c}")))

    return own.select(
        "gram", "total", of("n0").alias("p0"), of("n1").alias("p1"), F.log(of("n1") / of("n0")).alias("ratio"), F.log(of("l1") / of("l0")).alias("m_ratio"),
        (base("n1") - base("n0")).alias("base"), (base("l1") - base("l0")).alias("m_base"),
    )


@dataclass
class Ratios:
    """Frequent contexts as arrays (keys of grams and contexts, sorted, with their ratios), and the table of the others.

    bits is a filter of the other contexts' keys; rest has context, base, m_base and a map of symbols.
    """

    keys: np.ndarray
    values: np.ndarray  # ratio and m_ratio, by columns
    bits: np.ndarray
    rest: DataFrame | None

    def found(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return at, self.keys[at] == asked

    def of(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Ratios (two columns) of the words as far as the arrays know, and what must be asked: (word, context, symbol)."""
        rows, owner = windows(words)
        context, whole = keys(rows)
        kinds, first, of = np.unique(whole, return_index=True, return_inverse=True)
        at, known = self.found(kinds)
        context, symbol = context[first], rows[first, ORDER - 1]
        above, open_ = self.found(context)
        at = np.where(known, at, above)
        values = np.where((known | open_)[:, None], self.values[at] if len(self.values) else np.zeros((len(at), 2)), 0.0)
        sums = np.column_stack([np.bincount(owner, values[of, c], len(words)) for c in (0, 1)])
        ask = ~open_ & has_bits(context.view(np.int64), self.bits)
        places = np.flatnonzero(ask[of]) if ask.any() else np.zeros(0, np.int64)
        return sums, list(zip(owner[places].tolist(), context.view(np.int64)[of[places]].tolist(), symbol[of[places]].tolist(), strict=True))


def ratio_tables(ratios: DataFrame, most: int) -> Ratios:
    """The ratios of gram_ratios(), dealt into arrays of at most `most` grams of the most frequent contexts, and the rest."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.frombuffer("".join(b.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, ORDER)
            context, whole = keys(rows)
            yield pa.RecordBatch.from_arrays([pa.array(context.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(rows[:, -1].astype(np.int32)), *b.columns[1:]], names=["context", "gram", "symbol", *b.schema.names[1:]])

    plain = ratios.select("gram", F.floor(8 * F.log2("total")).cast("int").alias("often"), *(F.col(c).cast("float").alias(c) for c in ("ratio", "m_ratio", "base", "m_base")))
    table, _ = kept_table(plain.mapInArrow(keyed, "context long, gram long, symbol int, often int, ratio float, m_ratio float, base float, m_base float"), "ratios")
    room, least = most, None
    for r in sorted(table.groupBy("often").count().collect(), reverse=True):  # some hundred at most
        room -= r["count"]
        if room < 0:
            break
        least = r["often"]
    frequent = F.col("often") >= (1 << 30 if least is None else least)
    some = table.where(frequent)
    flat = some.select("gram", "ratio", "m_ratio").union(some.select("context", "base", "m_base").distinct()).toArrow()
    by = flat["gram"].to_numpy().view(np.uint64)
    order = np.argsort(by)
    rest = table.where(~frequent).groupBy("context").agg(F.first("base").alias("base"), F.first("m_base").alias("m_base"), F.map_from_entries(F.collect_list(F.struct("symbol", F.struct("ratio", "m_ratio")))).alias("symbols"))
    bits = key_bits(table.where(~frequent).select("context"), FILTER_BITS) if room < 0 else np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    return Ratios(by[order], np.column_stack([flat[c].to_numpy()[order] for c in ("ratio", "m_ratio")]), bits, rest if room < 0 else None)


class Known:
    """A worker's memory of words' ratios (of one column), in two halves as piece_bpe.Memory has them; words with open questions are nan."""

    def __init__(self, ratios: Ratios, column: int):
        self.ratios, self.column = ratios, column
        self.recent: tuple[dict, dict] = ({}, {})
        self.older: tuple[dict, dict] = ({}, {})

    def of(self, words: set[str]) -> tuple[dict[str, float], dict[str, tuple]]:
        """Ratio of each word, and (known part, asked contexts and symbols) of those that are nan."""
        if len(self.recent[0]) > REMEMBERED:
            self.older, self.recent = self.recent, ({}, {})
        new = []
        for w in words.difference(self.recent[0]):
            if w in self.older[0]:
                for mine, before in zip(self.recent, self.older, strict=True):
                    if w in before:
                        mine[w] = before[w]
            else:
                new.append(w)
        for i in range(0, len(new), 50_000):
            part = new[i : i + 50_000]
            sums, asked = self.ratios.of(part)
            own, open_ = sums[:, self.column].copy(), {}
            for k, context, symbol in asked:
                open_.setdefault(k, []).append((context, symbol))
            for k, questions in open_.items():
                self.recent[1][part[k]] = (float(own[k]), questions)
                own[k] = np.nan
            self.recent[0].update(zip(part, own.tolist(), strict=True))
        return self.recent


def evidence(rows: DataFrame, ratios: Ratios, apart: DataFrame, id_col: str = "_id") -> DataFrame:
    """The rows with words, and of their text the mean log ratio and the mean part of it above MARGIN, kept in the shared folder.

    Rows whose id is in apart (id_col, label; few) get the figures of the models without the rows
    apart, and their label; the label of others is null. Each row has an own number, so that repeated
    rows and ids are told apart.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((ratios.keys, ratios.values, ratios.bits))
    marked = rows.join(F.broadcast(apart.select(id_col, F.col("label").alias("_label"))), id_col, "left")
    others = [c for c in rows.columns if c != "text"]
    asked_kind = pa.list_(pa.struct([("word", pa.int32()), ("n", pa.int32()), ("part", pa.float64()), ("context", pa.int64()), ("symbol", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = Ratios(*shared.value, None)
        models = (Known(tables, 0), Known(tables, 1))  # of all rows, and without the rows apart
        for b in small_batches(batches):
            split = [tokens(t) for t in b.column("text").to_pylist()]
            model_of = [int(x is not None) for x in b.column("_label").to_pylist()]
            known = [model.of(set().union(*(ws for ws, m in zip(split, model_of, strict=True) if m == k))) for k, model in enumerate(models)]
            values = np.fromiter(chain.from_iterable(map(known[m][0].__getitem__, ws) for ws, m in zip(split, model_of, strict=True)), np.float64)
            sizes = np.fromiter(map(len, split), np.int64, len(split))
            row = np.repeat(np.arange(len(split)), sizes)
            there = ~np.isnan(values)
            plain = np.where(there, values, 0.0)
            sums, above = np.bincount(row, plain, len(split)), np.bincount(row, np.maximum(plain - MARGIN, 0), len(split))
            asked: list[list[dict]] = [[] for _ in split]
            for k in np.unique(row[~there]).tolist():
                open_ = known[model_of[k]][1]
                for i, (w, n) in enumerate(sorted((w, n) for w, n in Counter(split[k]).items() if w in open_)):
                    asked[k] += [{"word": i, "n": n, "part": open_[w][0], "context": c, "symbol": s} for c, s in open_[w][1]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), b.column("_label"), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(above, pa.float64()), pa.array(asked, asked_kind)], names=[*others, "label", "words", "_sum", "_above", "_asked"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in others) + ", label int, words long, _sum double, _above double, _asked array<struct<word:int,n:int,part:double,context:bigint,symbol:int>>"
    kept, path = kept_table(marked.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id()), "evidence")
    shared.destroy()
    if ratios.rest is not None:
        salt = F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int")
        asked = kept.select("_row", F.col("label").isNotNull().alias("_apart"), F.explode("_asked").alias("_a")).select("_row", "_apart", "_a.*").withColumn("salt", salt)
        rest = ratios.rest.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        of_symbol = F.try_element_at("symbols", F.col("symbol"))
        part = F.when(F.col("_apart"), F.coalesce(of_symbol["m_ratio"], F.col("m_base"))).otherwise(F.coalesce(of_symbol["ratio"], F.col("base")))
        joined = asked.join(rest, ["context", "salt"], "left").withColumn("_part", F.coalesce(part, F.lit(0.0)))
        of_word = joined.groupBy("_row", "word", "n", "part").agg(F.round(F.sum("_part"), 9).alias("_more")).withColumn("_r", F.col("part") + F.col("_more"))
        sums = of_word.groupBy("_row").agg(F.sum(F.col("n") * F.col("_r")).alias("_more_sum"), F.sum(F.col("n") * F.greatest(F.col("_r") - MARGIN, F.lit(0.0))).alias("_more_above"))
        kept = kept.drop("_asked").join(sums, "_row", "left")
    else:
        kept = kept.withColumns({"_more_sum": F.lit(0.0), "_more_above": F.lit(0.0)})

    def per_word(a: str, b: str) -> Column:
        return F.when(F.col("words") > 0, F.round((F.col(a) + F.coalesce(b, F.lit(0.0))) / F.col("words"), 9)).otherwise(0.0)

    found, _ = kept_table(kept.select(*others, "label", "words", per_word("_sum", "_more_sum").alias("mean"), per_word("_above", "_more_above").alias("above")), "evidence-sums")
    drop_path(rows.sparkSession, path)
    return found


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60) -> np.ndarray:
    """Weights of a logistic regression with a constant, by Newton's steps with a light ridge."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(len(w))
        w += np.linalg.solve(h, a.T @ (y - p) - 0.1 * w)
    return w


def score_inputs() -> list[Column]:
    """What the score depends on: the mean log ratio, the part above the margin, and the length (texts of
    some 3,000 words count as long as any); few weights, so that some labels do."""
    return [10 * F.col("mean"), F.log(F.col("above") + 0.002) + 4, F.least(F.log1p("words") - 5, F.lit(3.0))]


def score_weights(found: DataFrame) -> np.ndarray:
    """Weights of the score, from the rows of evidence() that have a label (few)."""
    tune = found.where("label is not null").select("label", *(x.alias(f"x{i}") for i, x in enumerate(score_inputs()))).toArrow()
    y, *x = (c.to_numpy().astype(np.float64) for c in tune.columns)
    if len(y) and y.min() < y.max():
        return logistic(np.column_stack(x), y)
    p = (y.sum() + 0.5) / (len(y) + 1)
    return np.array([np.log(p / (1 - p)), *[0.0] * len(score_inputs())])


def with_score(rows: DataFrame, labels: DataFrame, id_col: str, folds: int, held_out: int, calibration_rows: int) -> DataFrame:
    """The rows (_id, text, ...) with score instead of text, by models of the labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").cast("int").alias("label"))
    known = known.where(~in_fold("_id", folds, held_out))
    tunable = known.where(F.pmod(F.xxhash64("_id"), F.lit(3)) == 0)
    apart, apart_path = kept_table(bounded_sample(tunable, "_id", calibration_rows), "calibration")
    marks = known.join(F.broadcast(apart.select("_id", F.lit(True).alias("apart"))), "_id", "left")
    learn = rows.where(~in_fold("_id", folds, held_out)).select("_id", "text").join(marks.hint("merge"), "_id")  # labels grow with the corpus
    grams, grams_path = kept_table(count_grams(learn.select("text", "label", "apart")), "grams")
    ratios = ratio_tables(gram_ratios(grams), TABLE_GRAMS)
    release(rows.sparkSession)
    found = evidence(rows, ratios, apart)
    for path in (apart_path, grams_path):
        drop_path(rows.sparkSession, path)
    release(rows.sparkSession)
    w = [float(x) for x in score_weights(found)]
    margin = sum((F.lit(a) * x for a, x in zip(w[1:], score_inputs(), strict=True)), F.lit(w[0]))
    others = [c for c in rows.columns if c != "text"]
    return found.select(*others, F.round(1 / (1 + F.exp(-F.least(F.greatest(margin, F.lit(-30.0)), F.lit(30.0)))), 9).alias("score"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3, calibration_rows: int = 5_000) -> DataFrame:
    """The rows of docs, with all their columns, whose score is below threshold; see score_toxicity().

    Each row is judged by its own text, also where ids repeat.
    """
    # the id spreads copies of a text; what is judged is the text
    own = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("\0"), text_of(text_col)))
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"), own.alias("_own"))
    toxic = with_score(rows, labels, id_col, folds, held_out, calibration_rows).where(F.col("score") >= threshold).select("_own").distinct()
    return docs.join(toxic, own == F.col("_own"), "left_anti")


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, held_out: int = 2, threshold: float = 0.3, calibration_rows: int = 5_000) -> DataFrame:
    """id, held_out, score, predicted for every row of docs.

    The models count all labelled rows outside the held-out fold. At most calibration_rows of them
    (of least hash among a third by another hash) turn log ratios into probabilities; for that, they are
    judged by models that have not counted them. What comes to the driver is the table of the most
    frequent contexts and a filter, both of fixed size, and the calibration rows' figures.

    Defined cases: null text scores as empty text, which has ratio 0; a null id is in the fold of the
    empty text and has no label; repeated rows are scored alike; a very long text is one row of a batch
    of its own; null labels are left out, and of several labels of an id the largest holds. Without
    labels of both classes the score is the share of toxic labels, smoothed. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text"))
    marked = with_score(rows, labels, id_col, folds, held_out, calibration_rows)
    return marked.select(F.col("_id").alias(id_col), in_fold("_id", folds, held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
