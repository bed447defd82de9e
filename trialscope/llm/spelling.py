"""Spelling variants: words one edit apart, found through pivotal grams, and the form that each word comes from.

Of a word's bigrams, in one order for all words (the rarest first, then by letters), the first three and
those equal to the third are its prefix; two disjoint ones of the prefix, cheapest together, are its pivots.
Let r and s be one edit apart, and the last gram of r's prefix not come after that of s's. Of two disjoint
grams an edit hurts one at most, so a pivot of r lies in s, and as no gram of r's prefix comes after s's
last one, it lies in s's prefix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialscope.llm.common import drop_path, kept_table, spread, text_of

#: Letters of a run: the ASCII letters and the upper half of Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
#: Letters beside a pivot by which the places of the edit are told apart.
CONTEXT = 3


def words_of(docs: DataFrame, least: int = 7, damage: int = 31) -> DataFrame:
    """word, n: the words of at least `least` letters in whole texts, with their occurrences.

    Words are the maximal runs of letters with A-Z lower-cased. Let h be the crc32 of "<doc_id>:<run>"; where
    `damage` divides h, the run loses its letter h % length. A null text has no words; a null id counts as
    an empty one; repeated rows count as often as they occur.
    """
    lower = F.translate(text_of("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # A shorter run has no word of that many letters, whether it loses a letter or not.
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    damaged = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % damage == 0, damaged).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def two_pivots(prefix: Column) -> Column:
    """(a, b): the two disjoint grams of a prefix with the least sum of frequencies, a before b.

    prefix is an array of (pos, rank) by position; a rank has the frequency in its upper half. One pass by
    dynamic programming: `far` is the rarest gram that ends before this one starts, `near` the one just before
    it, `best` the cheapest pair so far. Two equal sums are told apart by the grams themselves.
    """
    gram = "struct<rank:bigint,pos:int>"
    none = lambda kind: F.lit(None).cast(kind)
    start = F.struct(none(gram).alias("far"), none(gram).alias("near"), none(f"struct<cost:bigint,a:{gram},b:{gram}>").alias("best"))

    def step(acc: Column, x: Column) -> Column:
        this = F.struct(x["rank"].alias("rank"), x["pos"].alias("pos"))
        far = F.when(acc["near"]["pos"] <= x["pos"] - 2, F.least(acc["far"], acc["near"])).otherwise(acc["far"])
        cost = F.shiftright(far["rank"], 32) + F.shiftright(x["rank"], 32)
        pair = F.when(far.isNotNull(), F.struct(cost.alias("cost"), far.alias("a"), this.alias("b")))
        # The gram before this one ends before the next one starts, wherever that is.
        return F.struct(F.least(acc["far"], acc["near"]).alias("far"), this.alias("near"), F.least(acc["best"], pair).alias("best"))

    return F.aggregate(prefix, start, step, lambda acc: acc["best"])


def gram_index(words: DataFrame) -> DataFrame:
    """word, n, places (of the prefix), last (rank of the third gram), p1, p2 (places of the pivots).

    Words have four letters at least. A gram's rank is its frequency, then its crc32; grams of equal rank
    count as equal, which can only lengthen a prefix. There are as many bigrams as pairs of letters at most.
    """
    starts = F.sequence(F.lit(0), F.length("word") - 2)
    grams = words.select("word", "n", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("word"), i + 1, F.lit(2)))).alias("pos", "gram"))
    rank = F.shiftleft(F.count(F.lit(1)), 32) + F.crc32("gram")
    # Its size is bounded by the alphabet: 90 letters have 8,100 bigrams.
    ranked = grams.join(F.broadcast(grams.groupBy("gram").agg(rank.alias("rank"))), "gram")
    ordered = ranked.groupBy("word", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "pos"))).alias("all"))
    among = F.filter("all", lambda x: x["rank"] <= F.col("last"))
    by_place = F.array_sort(F.transform(among, lambda x: F.struct(x["pos"].alias("pos"), x["rank"].alias("rank"))))
    chosen = ordered.withColumn("last", F.col("all")[2]["rank"]).withColumn("prefix", by_place).withColumn("two", two_pivots(F.col("prefix")))
    return chosen.select("word", "n", F.col("prefix.pos").alias("places"), "last", F.col("two.a.pos").alias("p1"), F.col("two.b.pos").alias("p2"))


def _keys(kinds: list[tuple[int, Column, Column | None, Column, Column]]) -> Column:
    """Hashes of (kind, left text, right text, length); null where the condition of a kind doesn't hold."""
    return F.array(*(F.when(ok, F.xxhash64(F.lit(kind), left, right if right is not None else F.lit(""), n.cast("int"))) for kind, left, right, n, ok in kinds))


def near_words(words: DataFrame, context: int = CONTEXT) -> tuple[DataFrame, str]:
    """(word, near, near_n; the folder that holds them): all ordered pairs of words that differ by one inserted, deleted or replaced letter.

    If the edit comes after the first pivot, the head up to its end is the same in both words, else the tail
    from the second pivot on is. `context` letters beside the pivot are the same too (kinds 0 and 2), or the
    edit lies among them, and the rest beyond them is the same (kinds 1 and 3). So words meet under hashes of
    the texts that an edit leaves alone and of their lengths; the position of a gram is that of the text's end.
    Pairs that meet are verified by their edit distance.
    """
    index, path = kept_table(gram_index(words), "gram-index")
    text, n = F.col("word"), F.length("word")
    head = lambda m: F.substring(text, F.lit(1), m)
    tail = lambda m: F.substring(text, m + 1, n)
    p1, p2 = F.col("p1"), F.col("p2")
    asks = [(0, head(p1 + 2 + context), None, n + d, n >= p1 + 2 + context) for d in (-1, 0, 1)] + [(2, tail(p2 - context), None, n + d, p2 >= context) for d in (-1, 0, 1)]
    asks += [(1, head(p1 + 2), tail(p1 + 2 + context), n, F.lit(True)), (3, head(p2 - context), tail(p2), n, p2 >= context)]
    # A word whose second pivot is nearer to its beginning than the context has no text there to be the same.
    asks += [(4, tail(p2), None, n + d, p2 < context) for d in (-1, 0, 1)]
    r = index.select(text.alias("r"), F.col("n").alias("r_n"), F.col("last").alias("r_last"), F.explode(F.array_compact(_keys(asks))).alias("key"))
    grams = index.select("word", "n", "last", F.explode("places").alias("p"))
    p = F.col("p")
    holds = [(0, head(p + 2 + context), None, n, n >= p + 2 + context), (2, tail(p - context), None, n, p >= context), (4, tail(p), None, n, p <= context)]
    for d in (-1, 0, 1):  # by so many letters this word is longer than the other
        holds += [(1, head(p + 2), tail(p + 2 + context + d), n - d, p + 2 + context + d >= 0), (3, head(p - d - context), tail(p), n - d, p - d >= context)]
    s = grams.select(text.alias("s"), F.col("n").alias("s_n"), F.col("last").alias("s_last"), F.explode(F.array_compact(_keys(holds))).alias("key"))
    met = r.join(spread(s), "key").where((F.col("r_last") <= F.col("s_last")) & (F.levenshtein("r", "s", 1) == 1))
    low = F.col("r") < F.col("s")
    pair = lambda a, b: F.when(low, F.col(a)).otherwise(F.col(b))
    pairs, pairs_path = kept_table(met.select(pair("r", "s").alias("a"), pair("r_n", "s_n").alias("a_n"), pair("s", "r").alias("b"), pair("s_n", "r_n").alias("b_n")).distinct(), "near-words")
    drop_path(words.sparkSession, path)
    return pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(pairs.select("b", "a", "a_n")), pairs_path


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form; neither null): the last word to which forms lead.

    Each round follows twice as many forms as the one before. A form occurs more often than its word, so
    there are no cycles, and rounds are few: the logarithm of the longest chain.
    """
    spark = forms.sparkSession
    at, path = kept_table(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        joined = at.join(spread(further), "root", "left")
        if joined.where("_next is not null").isEmpty():
            return at
        new, new_path = kept_table(joined.select("word", F.coalesce("_next", "root").alias("root")), "roots")
        drop_path(spark, path)
        at, path = new, new_path


def spelling_variants(docs: DataFrame, least: int = 7, damage: int = 31, seen: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of documents (doc_id, text) that occurs `seen` times or more.

    A word's form is its near word that occurs most often (the first in code-point order among equals), if
    that is `times` times as often as the word, else null; its root is the last word to which forms lead,
    the word itself if it has none; form_n is how often the form occurs, n_near the number of near words.
    Words have `least` letters at least (four or more). Null and empty texts have no words, long texts are
    read whole, repeated rows count anew, an empty table gives an empty result, other columns are not looked at.
    """
    if least < 4 or times < 2:
        raise ValueError("words need four letters for three bigrams, and forms must be more frequent than their words")
    words, words_path = kept_table(words_of(docs, least, damage).where(F.col("n") >= seen), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    pairs, pairs_path = near_words(words)
    near = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    said = words.join(spread(near), "word", "left").withColumn("ok", -F.col("best.n") >= times * F.col("n"))
    table, _ = kept_table(said.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("ok"), F.col("best.near")).alias("form"), F.when(F.col("ok"), -F.col("best.n")).alias("form_n")), "forms")
    for done in (words_path, pairs_path):
        drop_path(docs.sparkSession, done)
    ends = roots(table.where("form is not null").select("word", "form"))
    return table.join(spread(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
