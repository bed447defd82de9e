"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialscope.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "x", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")


def plain_words(rows, least=7):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= least:
                n[word] += 1
    return {w: k for w, k in n.items() if k >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def mutated(rnd, word):
    i, c = rnd.randrange(len(word)), rnd.choice("abÀÿcd")
    return rnd.choice((word[:i] + word[i + 1 :], word[:i] + c + word[i:], word[:i] + c + word[i + 1 :]))


def test_variants_equal_brute_force(spark):
    rnd = random.Random(3)
    bases = ["".join(rnd.choices("abÀcdé", k=rnd.randint(7, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa", "aaaaaaab"]
    chain = [bases[0]]
    for _ in range(3):
        chain.append(mutated(rnd, chain[-1]))
    words = [w for k, w in zip((2000, 150, 14, 2), chain) for _ in range(k)]
    words += [rnd.choice(bases) for _ in range(400)] + [mutated(rnd, rnd.choice(bases)) for _ in range(900)]
    rnd.shuffle(words)
    rows = [(i, " ".join(words[i::60]).replace("a", "A", i % 3)) for i in range(60)]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame(spark, rows)).collect()}
    want = plain(plain_words(rows))
    assert got == want and any(f and want[f][0] for f, *_ in want.values())  # some forms have forms


def test_near_words_of_every_length_and_place(spark):
    rnd = random.Random(5)
    n = {}
    for _ in range(300):
        w = "".join(rnd.choices("abc", k=rnd.randint(4, 9)))
        n[w] = n[mutated(rnd, w) if len(w) > 4 else w] = 2
    words = spark.createDataFrame([(w, k) for w, k in n.items()], "word string, n long")
    want = {(a, b) for a in n for b in n if one_edit(a, b)}
    for context in (1, 3):
        rows = spelling.near_words(words, context)[0].collect()
        assert {(r.word, r.near) for r in rows} == want and len(rows) == len(want)


def test_pivots_are_the_cheapest_disjoint_pair(spark):
    rnd = random.Random(7)
    rows = [(k, [(p, rnd.randint(1, 9) << 32) for p in sorted(rnd.sample(range(12), rnd.randint(3, 8)))]) for k in range(200)]
    got = spark.createDataFrame(rows, "k int, prefix array<struct<pos:int,rank:long>>").select("k", spelling.two_pivots(F.col("prefix")).alias("best")).collect()
    by = dict(rows)
    for r in got:
        least = min((x[1] + y[1] for x in by[r.k] for y in by[r.k] if y[0] - x[0] >= 2))
        assert r.best.cost == least >> 32 and r.best.b.pos - r.best.a.pos >= 2


def test_edge_cases(spark):
    long = "variant " * 50_000 + "variunt variunt"
    rows = [(1, None), (2, ""), (5, long), (5, long), (None, "Variant·VARIANT éééÉÉÉé éééÉÉÉé 1234567 short"), (4, "\x00😀")]
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.spelling_variants(frame(spark, rows)).collect()}
    assert got == plain(plain_words(rows)) and got["variunt"][1] == "variant"
    assert spelling.spelling_variants(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(frame(spark, []), least=3)


def test_only_the_bigrams_are_broadcast(spark, monkeypatch):
    """Tables that grow with the input are shuffled, also where their compressed files are below the limit for broadcasts."""
    plans, keep = {}, spelling.kept_table
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def noted(df, name):
        plans.setdefault(name, plan(df))
        return keep(df, name)

    monkeypatch.setattr(spelling, "kept_table", noted)
    words = ["governance"] * 40 + ["governanc"] * 3 + ["governancs"] * 3 + ["candidate", "candidates"] * 5
    out = spelling.spelling_variants(frame(spark, [(i, w) for i, w in enumerate(words)]), damage=1 << 40)
    plans["result"] = plan(out)
    assert {name for name, text in plans.items() if "BroadcastExchange" in text} == {"gram-index"}
    assert {(r["word"], r["root"]) for r in out.collect()} == {(w, "governance" if w.startswith("g") else w) for w in words}
