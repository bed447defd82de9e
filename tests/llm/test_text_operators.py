"""The text operators against plain versions, the public libraries and round trips, with their defined edge cases."""

import base64
import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialscope.llm import chat_format, jaccard_join, licences, merkle, packing, piece_bpe, quality_gam, toxicity_lm, warc
from trialscope.llm.common import new_path, tokenizer_file
from trialscope.llm.components import components
from trialscope.llm.exact_dedup import exact_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
DOCS = "doc_id long, text string, lang string, keep_id string, _text int"


def frame(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "x", 1) for i, t in rows], DOCS)


EDGE = [(1, None), (2, ""), (3, "a b"), (4, "a  b"), (4, "a  b"), (None, "a\tb"), (5, "word " * 5000), (6, "é😀 \x00")]


def test_exact_dedup_edge_cases(spark):
    got = exact_dedup(frame(spark, EDGE)).collect()
    assert len(got) == len(EDGE)
    by = {(r.doc_id): r for r in got}
    assert (by[1].keep_id, by[2].keep_id, by[2].kept, by[1].group_size) == (1, 1, False, 2)
    assert (by[3].keep_id, by[4].keep_id, by[None].keep_id, by[4].group_size) == (3, 3, 3, 4)
    assert by[3].text_sha256 == hashlib.sha256(b"a b").hexdigest() and not by[4].kept and not by[None].kept
    assert exact_dedup(frame(spark, [])).count() == 0


def test_exact_dedup_compares_bytes_under_a_bad_hash(spark):
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choices(WORDS[:3], k=rnd.randint(1, 3)))) for i in range(200)]
    one = lambda sha, text: F.unhex(F.lit("00"))
    first = {}
    for i, t in rows:
        first.setdefault(t, i)
    assert {(r.doc_id, r.keep_id) for r in exact_dedup(frame(spark, rows), content_hash=one).collect()} == {(i, first[t]) for i, t in rows}


def test_gam_learns_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.uniform(size=(4000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    gam = quality_gam.fit_gam(x[:3000], y[:3000])
    assert next(iter(gam.pairs)) == (0, 1) and ((gam.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.8  # single features give a half


def plain_line_tree(place, g, h, size, least):
    """Steps of a tree of at most four leaves over bins, by trying all cuts of the rows' bins."""
    sums = lambda a, b: (sum(x for p, x in zip(place, g) if a <= p < b), sum(x for p, x in zip(place, h) if a <= p < b))
    regions = [(0, size)]
    for _ in range(2):
        new = []
        for a, b in regions:
            best = (sums(a, b)[0] ** 2 / (sums(a, b)[1] + 1), None)
            for c in range(a + 1, b):
                (gl, hl), (gr, hr) = sums(a, c), sums(c, b)
                if hl >= least and hr >= least and gl**2 / (hl + 1) + gr**2 / (hr + 1) > best[0] + 1e-12:
                    best = (gl**2 / (hl + 1) + gr**2 / (hr + 1), c)
            new += [(a, b)] if best[1] is None else [(a, best[1]), (best[1], b)]
        regions = new
    return [next(sums(a, b)[0] / (sums(a, b)[1] + 1) for a, b in regions if a <= p < b) for p in range(size)]


def plain_pair_tree(places, g, h, shape, least):
    """Steps of a tree of at most four leaves over a grid, and its gain; each region is cut once along either axis."""

    def sums(r):
        rows = [i for i, (p, q) in enumerate(places) if r[0] <= p < r[1] and r[2] <= q < r[3]]
        return sum(g[i] for i in rows), sum(h[i] for i in rows)

    def cuts(r):
        for c in range(r[0] + 1, r[1]):
            yield (r[0], c, r[2], r[3]), (c, r[1], r[2], r[3])
        for c in range(r[2] + 1, r[3]):
            yield (r[0], r[1], r[2], c), (r[0], r[1], c, r[3])

    regions = [(0, shape[0], 0, shape[1])]
    for _ in range(2):
        new = []
        for r in regions:
            best = (-1.0, [r])
            for two in cuts(r):
                (gl, hl), (gr, hr) = map(sums, two)
                gain = gl**2 / (hl + 1) + gr**2 / (hr + 1)
                if hl >= least and hr >= least and gain > best[0] + 1e-12:
                    best = (gain, list(two))
            new += best[1]
        regions = new
    step = lambda r: sums(r)[0] / (sums(r)[1] + 1)
    out = [[next(step(r) for r in regions if r[0] <= p < r[1] and r[2] <= q < r[3]) for q in range(shape[1])] for p in range(shape[0])]
    return out, sum(sums(r)[0] ** 2 / (sums(r)[1] + 1) for r in regions)


def plain_gam(x, y, rounds, pair_rounds, n_pairs, bins, pair_bins, rate, least):
    """(margins of the rows, tables, pair tables) of cyclic boosting by plain loops over the rows."""
    features = range(len(x[0]))
    cut = lambda j, k: sorted(set(np.quantile([r[j] for r in x], [i / k for i in range(1, k)]).tolist()))
    cuts, pair_cuts = [cut(j, bins) for j in features], [cut(j, pair_bins) for j in features]
    place = lambda r, j, those: sum(c <= r[j] for c in those[j])
    p = (sum(y) + 1) / (len(y) + 2)
    margin = [math.log(p / (1 - p))] * len(y)
    tables = [[0.0] * (len(c) + 1) for c in cuts]

    def slopes():
        q = [1 / (1 + math.exp(-m)) for m in margin]
        return [a - b for a, b in zip(y, q)], [b * (1 - b) for b in q]

    for _ in range(rounds):
        for j in features:
            at = [place(r, j, cuts) for r in x]
            step = plain_line_tree(at, *slopes(), len(tables[j]), least)
            for b, s in enumerate(step):
                tables[j][b] += rate * s
            for i, b in enumerate(at):
                margin[i] += rate * step[b]
    cells = {(i, j): [(place(r, i, pair_cuts), place(r, j, pair_cuts)) for r in x] for i in features for j in features if i < j}
    shape = {(i, j): (len(pair_cuts[i]) + 1, len(pair_cuts[j]) + 1) for i, j in cells}
    gains = {k: plain_pair_tree(cells[k], *slopes(), shape[k], least)[1] for k in cells}
    pairs = {k: [[0.0] * shape[k][1] for _ in range(shape[k][0])] for k in sorted(gains, key=lambda k: (-gains[k], k))[:n_pairs]}
    for _ in range(pair_rounds):
        for k, table in pairs.items():
            step, _ = plain_pair_tree(cells[k], *slopes(), shape[k], least)
            for a, row in enumerate(step):
                for b, s in enumerate(row):
                    table[a][b] += rate * s
            for i, (a, b) in enumerate(cells[k]):
                margin[i] += rate * step[a][b]
    return margin, tables, pairs


def test_gam_equals_plain_boosting():
    rnd = np.random.default_rng(7)
    x = rnd.uniform(size=(160, 4))
    y = ((x[:, 0] > 0.6) ^ (x[:, 2] > 0.4) | (rnd.uniform(size=160) < 0.1)).astype(float)
    how = dict(rounds=3, pair_rounds=3, n_pairs=2, bins=7, pair_bins=4, rate=0.3, least=1.0)
    gam = quality_gam.fit_gam(x, y, **how)
    margin, tables, pairs = plain_gam(x.tolist(), y.tolist(), **how)
    assert gam.margin(x) == pytest.approx(margin)
    assert all(mine == pytest.approx(np.array(plain)) for mine, plain in zip(gam.tables, tables, strict=True))
    assert list(gam.pairs) == list(pairs) and all(gam.pairs[k] == pytest.approx(np.array(pairs[k])) for k in pairs)


def test_quality_of_an_empty_table_and_long_texts(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality_gam.score_quality(frame(spark, []), labels).count() == 0
    got = quality_gam.score_quality(frame(spark, [(1, "word " * 300_000), (1, None), (None, "x")]), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 3


def test_gam_without_labels_is_the_prior(spark):
    docs = frame(spark, EDGE)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_gam.score_quality(docs, labels).collect()
    assert len(got) == len(EDGE) and {round(r.score, 6) for r in got} == {0.5}
    assert {r.held_out for r in got if r.doc_id == 3} == {zlib.crc32(b"3") % 5 == 0}
    assert quality_gam.keep_quality(docs, labels).columns == docs.columns


def made_up(spark, bad_word, n=400):
    rnd = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        words = rnd.choices(WORDS, k=40)
        if bad:
            for _ in range(4):
                words[rnd.randrange(40)] = bad_word(rnd)
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(bad)))
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held_out_accuracy(scores, labels, col):
    known = {r.doc_id: r[col] for r in labels.collect()}
    held = [(r.predicted, known[r.doc_id]) for r in scores.collect() if r.held_out]
    return sum(p == y for p, y in held) / len(held)


def test_quality_held_out(spark):
    docs, labels = made_up(spark, lambda r: r.choice(("#$%&*", "!!!!", "|||")))
    assert held_out_accuracy(quality_gam.score_quality(docs, labels), labels, "quality") > 0.97


def test_toxicity_held_out_and_filter(spark):
    docs, labels = made_up(spark, lambda r: "vile" + r.choice(("ness", "ly", "st", "")))
    scores = toxicity_lm.score_toxicity(docs, labels)
    assert held_out_accuracy(scores, labels, "toxic") > 0.97
    kept = toxicity_lm.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in scores.where("predicted = 0").collect()}


def test_toxicity_learns_from_few_labels_and_scores_edge_rows(spark):
    """Some hundred labelled rows, null, empty and very long texts among them."""
    rnd = random.Random(11)
    toxic = [rnd.random() < 0.15 for _ in range(400)]
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(5, 60)) + (["clownish"] * rnd.randint(1, 3) if y else [])) for y in toxic]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "alpha beta " * 30_000), (1003, "alpha beta " * 30_000 + "clownish " * 3000), (None, "clownish clownish"), (None, None)]
    labels = spark.createDataFrame([(i, 0, int(y)) for i, y in enumerate(toxic)] + [(1000, 0, 0), (1001, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    assert held_out_accuracy(toxicity_lm.score_toxicity(docs, labels), labels, "toxic") > 0.9
    got = {(r.doc_id, r.predicted) for r in toxicity_lm.score_toxicity(docs, labels).where("doc_id >= 1000 or doc_id is null").collect()}
    assert {i for i, _ in got} == {1000, 1001, 1002, 1003, None} and {(1000, 0), (1001, 0), (1003, 1), (None, 0), (None, 1)} <= got


def test_toxicity_edge_cases(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity_lm.score_toxicity(frame(spark, EDGE), none).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5}
    assert toxicity_lm.score_toxicity(frame(spark, []), none).count() == 0


def plain_grams(words):
    """[n0, n1] of every gram of the words (word: [n0, n1])."""
    top = defaultdict(lambda: [0, 0])
    for w, n in words.items():
        m = "\t" * 5 + w + "\n"
        for i in range(len(w) + 1):
            for cls in (0, 1):
                top[m[i : i + 6]][cls] += n[cls]
    return {g: n for g, n in top.items() if sum(n)}


class PlainModels:
    """Class-conditional Kneser-Ney models with a shared back-off, by plain counts."""

    def __init__(self, top, discount=0.75, backoff=20.0, seen=4):
        self.top, self.d, self.b, self.seen_ = top, discount, backoff, seen
        seen, self.count = {6: set(top)}, {}
        for k in range(5, 0, -1):
            self.count[k] = defaultdict(int)
            for g in seen[k + 1]:
                self.count[k][g[1:]] += 1
            seen[k] = set(self.count[k])
        self.follow = {k: defaultdict(set) for k in range(1, 7)}
        for k, those in self.follow.items():
            for g in seen[k]:
                those[g[:-1]].add(g)

    def shared(self, g):
        if not g:
            return 1 / len(self.count[1])
        of = (lambda x: sum(self.top.get(x, (0, 0)))) if len(g) == 6 else (lambda x: self.count[len(g)].get(x, 0))
        those = self.follow[len(g)][g[:-1]]
        total = sum(map(of, those))
        return (max(of(g) - self.d, 0) + self.d * len(those) * self.shared(g[1:])) / total if total else self.shared(g[1:])

    def probability(self, cls, g):
        counts = [self.top[x][cls] for x in self.follow[6][g[:-1]]]
        own, b = sum(c > 0 for c in counts), self.b * len(counts)
        return (max(self.top.get(g, (0, 0))[cls] - self.d, 0) + (b + self.d * own) * self.shared(g)) / (sum(counts) + b)

    def told(self, g):
        """Whether the context of g has counts of its own."""
        those = self.follow[6][g[:-1]]
        return bool(those) and sum(sum(self.top[x]) for x in those) >= self.seen_ * len(those)

    def ratio(self, g):
        if not self.told(g):
            return 0.0
        counts = [[self.top[x][cls] for x in self.follow[6][g[:-1]]] for cls in (0, 1)]
        base = [math.log((self.b * len(those) + self.d * sum(c > 0 for c in those)) / (self.b * len(those) + sum(those))) for those in counts]
        return math.log(self.probability(1, g) / self.probability(0, g)) if g in self.top else base[1] - base[0]

    def word(self, w):
        return sum(self.ratio(("\t" * 5 + w + "\n")[i : i + 6]) for i in range(len(w) + 1))


def counted_words(rows):
    words = defaultdict(lambda: [0, 0])
    for text, label in rows:
        for w in text.lower().split():
            words[w][label] += 1
    return words


def many_scripts(seed, n):
    rnd = random.Random(seed)
    return ["".join(chr(rnd.randrange(*rnd.choice(((97, 103), (97, 100), (0x4E00, 0x4E08), (0x1F300, 0x1F303))))) for _ in range(rnd.randint(1, 9))) for _ in range(n)]


def labelled_texts(seed=8, n=300):
    rnd, words = random.Random(seed), many_scripts(seed, 200)
    return [(" ".join(rnd.choices(words[: 150 if y else 200], k=30)), y) for y in (rnd.choice((0, 0, 1)) for _ in range(n))] + [("", 1), ("x" * 5000, 0)]


def test_gram_counts_equal_plain_counts(spark, monkeypatch):
    monkeypatch.setattr(toxicity_lm, "GATHERED", 50)
    rows = labelled_texts()
    got = {r.gram: [r.n0, r.n1] for r in toxicity_lm.count_grams(spark.createDataFrame(rows, "text string, label int")).collect()}
    assert got == plain_grams(counted_words(rows))


def test_models_equal_plain_models_and_sum_to_one(spark):
    rows = labelled_texts()
    grams = toxicity_lm.count_grams(spark.createDataFrame(rows, "text string, label int"))
    plain = PlainModels(plain_grams(counted_words(rows)))
    got = toxicity_lm.gram_ratios(grams).collect()
    assert {r.gram for r in got} == {g for g in plain.top if plain.told(g)} and len(got) > 300
    symbols = {g[-1] for g in plain.top}
    for r in got:
        assert r.p0 == pytest.approx(plain.probability(0, r.gram)) and r.p1 == pytest.approx(plain.probability(1, r.gram)) and r.ratio == pytest.approx(plain.ratio(r.gram), abs=1e-9)
    for context in random.Random(1).sample(sorted({r.gram[:-1] for r in got}), 60):
        unseen = next(x for x in symbols if context + x not in plain.top)
        (base,) = {r.base for r in got if r.gram[:-1] == context}
        assert base == pytest.approx(plain.ratio(context + unseen))
        for cls in (0, 1):
            assert sum(plain.probability(cls, context + x) for x in symbols) == pytest.approx(1)


@pytest.mark.parametrize("most", [1 << 18, 400, 0])
def test_evidence_of_whole_texts_equals_plain_models(spark, monkeypatch, most):
    """Means of all words' log ratios and of the parts above the margin, whatever part of the model is in the tasks' table."""
    monkeypatch.setattr(toxicity_lm, "BACKOFF", 0.5)
    monkeypatch.setattr(toxicity_lm, "SEEN", 2)
    rows = labelled_texts()
    plain = PlainModels(plain_grams(counted_words(rows)), backoff=0.5, seen=2)
    grams = toxicity_lm.count_grams(spark.createDataFrame(rows, "text string, label int"))
    ratios = toxicity_lm.ratio_tables(toxicity_lm.gram_ratios(grams), most)
    assert (ratios.rest is None) == (most > 10_000)
    asked = [*(t for t, _ in rows[:60]), "", " ".join(many_scripts(99, 300)), "abc " * 2000]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(asked)], "_id long, text string")
    apart = spark.createDataFrame([], "_id long, label int")
    got = sorted((r.words, r["mean"], r.above) for r in toxicity_lm.evidence(docs, ratios, apart).collect())
    want = []
    for t in asked:
        found = [plain.word(w) for w in t.lower().split()]
        want.append((len(found), sum(found) / max(1, len(found)), sum(max(x - toxicity_lm.MARGIN, 0) for x in found) / max(1, len(found))))
    assert sum(x[2] > 0 for x in want) > 5
    for a, b in zip(got, sorted(want), strict=True):
        assert a == pytest.approx(b, abs=1e-5)


def test_toxic_words_of_calibration_rows_only_are_learnt(spark):
    docs, labels = made_up(spark, lambda r: "vile" + r.choice(("ness", "ly", "st", "")))
    folds = docs.select("doc_id", F.expr("pmod(xxhash64(doc_id), 3) = 0 and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2").alias("tuning"))
    only = folds.where("tuning").join(labels.where("toxic = 1"), "doc_id").select("doc_id")
    ids = {r.doc_id for r in only.collect()}
    rare = docs.withColumn("text", F.when(F.col("doc_id").isin(*ids), F.regexp_replace("text", "vile[a-z]*", "qzxwjk")).otherwise(F.col("text")))
    asked = frame(spark, [(10_000, " ".join(WORDS[:12] + ["qzxwjk"] * 3))])
    score = {r.doc_id: r.predicted for r in toxicity_lm.score_toxicity(rare.union(asked), labels).collect()}
    assert len(ids) > 5 and score[10_000] == 1


ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "\x1c", "é", "!", "<|endoftext|>", "😀", "漢字", "　", "\xa0", "▁", "<s>", "aaaa", "abab", "\x00", "12"]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join) | st.text(max_size=30)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_byte_bpe_equals_the_library(text):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    text = text.encode("utf-8", "replace").decode()
    lib = LIB.setdefault("byte", Tokenizer.from_file(path))
    assert np.frombuffer(packing.tokenizer(path).encode([text])[0], "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids


LIB: dict = {}


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_piece_bpe_equals_the_library(text):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = LIB.setdefault("piece", sentencepiece.SentencePieceProcessor(model_file=path))
    text = text.encode("utf-8", "replace").decode()
    mine = piece_bpe.digester(path)
    ids = mine.encode([text])[0]
    assert ids == lib.encode(text) and mine.decode(ids) == lib.decode(ids)
    again = mine.merge(mine.split(text), one_by_one=True) if text else []
    assert [i for w in again for i in w] == ids


def test_empty_tables_and_long_texts_of_tokenised_operators(spark):
    assert piece_bpe.piece_digests(frame(spark, []), tokenizer_file("piece_bpe_32k.model")).count() == 0
    assert packing.tokenised_pieces(frame(spark, []), tokenizer_file("byte_bpe_50k.json")).count() == 0
    long = frame(spark, [(1, "word " * 200_000), (2, "a")])
    pieces = packing.tokenised_pieces(long, tokenizer_file("byte_bpe_50k.json")).where("doc_id = 1").orderBy("piece").collect()
    assert len(pieces) > 190 and [r.start for r in pieces[1:]] == [r.start + r.length for r in pieces[:-1]] and all(r.length == 1024 for r in pieces[1:])
    assert merkle.edit_likeness(frame(spark, [])).count() == 0 and jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_piece_frames_agree_with_digests(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    docs = frame(spark, EDGE)
    ids = piece_bpe.encode_pieces(docs, path)
    back = sorted((r.text for r in piece_bpe.decode_pieces(ids, path).collect()))
    assert back == sorted(t or "" for _, t in EDGE)
    want = sorted((len(r.ids), hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()) for r in ids.collect())
    digests = piece_bpe.piece_digests(docs, path).collect()
    assert sorted((r.n_tokens, r.ids_sha256) for r in digests) == want
    assert sorted(r.decoded_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t in EDGE)


def test_packing_is_gapless_and_tight(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    rnd = random.Random(5)
    rows = [(i, " ".join(rnd.choices(WORDS, k=rnd.choice((0, 3, 50, 700, 3000))))) for i in range(150)] + [(200, None)]
    pieces = packing.tokenised_pieces(frame(spark, rows), path, longest=256, with_ids=True)
    packed = packing.pack(pieces, pieces.count(), 256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in packed:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    bpe = packing.tokenizer(path)
    for i, t in rows:
        parts = sorted(by_doc[i], key=lambda r: r.piece)
        ids = [x for r in parts for x in r.ids]
        assert ids == [*np.frombuffer(bpe.encode([t or ""])[0], "<u4").tolist(), 2]
        assert all(r.length == 256 for r in parts[1:]) and [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_seq) <= math.ceil(sum(r.length for r in packed) / 256) + 3
    assert packing.pack(pieces.limit(0), 0, 256).count() == 0


def test_packing_of_repeated_rows_null_ids_and_clashing_names(spark):
    path = tokenizer_file("byte_bpe_50k.json")
    long_, short = " ".join(WORDS * 40), "alpha beta"
    docs = frame(spark, [(None, long_), (None, long_), (-1, long_), (7, long_), (7, long_), (None, short), (None, short), (8, None)])
    pieces = packing.tokenised_pieces(docs, path, longest=64)
    marked = pieces.withColumns({"_shard": F.lit("x"), "_row": F.lit(3.5), "offset": F.lit(-5), "sequence_id": F.lit("old")})
    packed = packing.pack(marked, 100_000, 64)
    assert sorted(packed.columns) == sorted(marked.columns)
    rows = packed.collect()
    assert len(rows) == pieces.count() and {(r._shard, r._row) for r in rows} == {("x", 3.5)}
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert sum(r.length == 64 for r in rows) > 20 and len({r.sequence_id for r in rows if r.length == 64}) == sum(r.length == 64 for r in rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 31), max_size=60))
def test_best_fit_equals_a_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    rooms, want = [], []
    for n in lengths:
        fits = [(r, -i) for i, r in enumerate(rooms) if r >= n]
        room = min(fits)[0] if fits else 32
        want.append(room)
        if fits:
            rooms.remove(room)
        if room > n:
            rooms.append(room - n)
    _, offsets = packing.best_fit(lengths, 32)
    assert [32 - o for o in offsets] == want


def test_archives_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "x" * 1500), (2, "u", "x" * 1500), (3, "u", "x" * 1500), (4, "u", "short"), (5, "u", "short"), (6, None, None), (None, "u", "é" * 900), (7, "u", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = new_path(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.read_digests(index, folder).collect()}
    assert len(got) == len(rows)
    assert [(got[i].record_type, got[i].refers_to) for i in (1, 2, 3, 4, 5, None)] == [("revisit", 3), ("revisit", 3), ("response", None), ("response", None), ("response", None), ("revisit", 7)]
    for i, _, html in rows:
        assert (got[i].payload_bytes, got[i].payload_digest) == (len((html or "").encode()), hashlib.sha1((html or "").encode()).hexdigest())
    some = warc.read_archives(index.where("page_id in (3, 4)"), folder).collect()
    assert sorted(bytes(r.payload) for r in some) == sorted([b"x" * 1500, b"short"])
    assert warc.write_archives(pages.limit(0), new_path(spark, "warc-none")).count() == 0


def test_archives_of_long_payloads_repeated_rows_and_clashing_names(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 1 << 12)
    rnd = random.Random(3)
    long_ = "".join(chr(rnd.randrange(0x20, 0x3000)) for _ in range(400_000))
    rows = [(1, "u", long_), (2, "u", long_), (2, "u", long_), (3, "\u2028", "x"), (None, None, long_), *((i, "u", "same " * 400) for i in range(100, 180))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(c) for c in ("bytes", "salt", "file", "newest")})
    folder = new_path(spark, "warc-long")
    index = warc.write_archives(pages, folder)
    back = warc.read_archives(index, folder)
    assert back.rdd.getNumPartitions() > 1
    got = sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in warc.read_digests(index, folder).collect())
    n = len(long_.encode())
    want = [(-1, n, "revisit", 2), (1, n, "revisit", 2), (2, n, "response", -1), (2, n, "response", -1), (3, 1, "response", -1), *((i, 2000, "revisit", 179) for i in range(100, 179)), (179, 2000, "response", -1)]
    assert got == want


def test_close_ranges_are_read_together():
    assert [(a, b) for a, b, _ in warc.coalesced([0, 10, 500, 2000], [10, 5, 10, 9], gap=600, most=1000)] == [(0, 510), (2000, 2009)]


def test_base32_digest_in_hex(spark):
    raw = hashlib.sha1(b"q").digest()
    df = spark.createDataFrame([(base64.b32encode(raw).decode(),)], "s string")
    assert df.select(warc.hex_of_base32(F.col("s"))).first()[0] == raw.hex()


def test_licence_rules_and_wrapped_sentences():
    mit = licences.SENTENCES["mit.grant"] + ".\n\n" + licences.SENTENCES["mit.asis"].replace(", ", ",\n") + ". " + licences.SENTENCES["mit.liability"] + "."
    assert [x[0] for x in licences.recognise("intro.\n" + mit)] == ["MIT"]
    text = "foo | bar\nLicensed under CC BY-NC 4.0.\nbaz. Released under the MIT License. more"
    found = licences.recognise(text)
    assert [x[0] for x in found] == ["CC-BY-NC-4.0", "MIT"] and text[found[0][1] : found[0][2]] == "Licensed under CC BY-NC 4.0"
    assert licences.recognise("Released under the MIT Licence agreement of others.") == []


MIT_TEXT = """MIT License

Copyright (c) 2024 Some One

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at
"""


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "> ", "; ", "<!-- ", "-- ", "%% ", "*" * 45 + " "])
def test_real_licence_texts_with_comment_prefixes(prefix):
    (found,) = licences.recognise("".join(prefix + line if line.strip() else prefix.rstrip() + line for line in MIT_TEXT.splitlines(True)))
    assert found[0] == "MIT"
    one = f"code\n{prefix}[Released under the MIT License.] -->\ncode"
    assert [x[0] for x in licences.recognise(one.replace(".]", "]"))] == ["MIT"]


def test_whole_mit_text_is_one_licence():
    ((name, start, end),) = licences.recognise(MIT_TEXT)
    assert name == "MIT" and MIT_TEXT[start:].startswith("Permission") and MIT_TEXT[start:end].endswith("IN THE\nSOFTWARE")


def wrapped(text, width=60):
    return "\n".join(textwrap.wrap(text, width))


@pytest.mark.parametrize(("name", "keys"), [(name, rule) for name, rule in licences.RULES if len(rule) > 1])
def test_every_rule_fits_its_wrapped_sentences(name, keys):
    text = "code();\n\n" + "\n\n".join(wrapped(licences.SENTENCES[k] + ".") for k in keys) + "\n\nmore code"
    ((found, start, end),) = licences.recognise(text)
    assert found == name and start == text.index(licences.SENTENCES[keys[0]].split()[0]) and end >= text.rindex(licences.SENTENCES[keys[-1]].split()[-1])


def test_gaps_and_order_of_licence_sentences():
    parts = [wrapped(licences.SENTENCES[k] + ".") for k in ("mit.permission", "mit.condition", "mit.asis", "mit.liability")]
    for filler, whole in ((1, True), (3, True), (4, False), (60, False)):
        text = "\n\n".join([*parts[:2], "\n".join(f"filler line {i}" for i in range(filler)), *parts[2:]])
        ((name, _, end),) = licences.recognise(text)
        assert name == "MIT" and (end == len(text) - 1) == whole
    assert licences.recognise("\n\n".join(parts[2:] + parts[:1])) == []
    assert licences.recognise("\n\n".join(["Licensed under CC BY 4.0."] + parts[2:])) [0][0] == "CC-BY-4.0"
    gaps = [gap for gap, *_ in licences.identifiers("\n\n".join([parts[0], "one. two. three.\nfour\n----", parts[1]]))]
    assert gaps == [0, 4]


def test_own_licence_rules(spark):
    docs = frame(spark, [(1, "Use freely.\nNo warranty!"), (2, "No warranty. Use freely."), (3, "Released under the MIT License.")])
    got = licences.scan_licences(docs, sentences={"a": "use freely", "b": "no warranty"}, rules=[("Own-1.0", ("a", "b"))]).collect()
    assert {r.doc_id: [x.licence for x in r.found] for r in got} == {1: ["Own-1.0"], 2: [], 3: []}


def test_licence_scan_of_an_empty_table_and_a_long_text(spark):
    assert licences.scan_licences(frame(spark, [])).count() == 0
    (row,) = licences.scan_licences(frame(spark, [(1, "word. " * 100_000 + MIT_TEXT + "more text " * 100_000)])).collect()
    assert [x.licence for x in row.found] == ["MIT"]


def test_licence_scan_edge_cases(spark):
    got = licences.scan_licences(frame(spark, [*EDGE, (9, "Released under the MIT License.")])).collect()
    assert [(r.doc_id, len(r.found)) for r in got if r.found] == [(9, 1)] and len(got) == len(EDGE) + 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="#\\<>/turn: as\n", max_size=40))
def test_template_escapes_are_reversible(text):
    escaped = chat_format.escape(text)
    assert chat_format.unescape(escaped) == text and "###" not in escaped and "</turn>" not in escaped


def test_chat_events_fold_and_read_back(spark):
    log = [(1, 0, 1, 0, "start", "user", None), (1, 0, 1, 1, "delta", None, "he"), (1, 0, 1, 2, "delta", None, "llo"), (1, 1, 1, 0, "start", "assistant", None), (1, 1, 1, 1, "delta", None, "bad"), (1, 1, 1, 2, "regenerate", None, None), (1, 1, 1, 3, "delta", None, "good"), (1, 2, 1, 0, "start", "assistant", "x"), (1, 2, 1, 1, "edit", None, "### y</turn>\n")]
    events = spark.createDataFrame(log, "conv_id long, turn long, tie int, seq long, kind string, role string, text string")
    formatted = chat_format.format_chat(events)
    whole = "".join(r.formatted for r in formatted.orderBy("position").collect())
    assert whole.startswith("### user: hello</turn>\n### assistant: good</turn>\n")
    row = chat_format.read_back(formatted).first()
    assert row.loss_sha256 == hashlib.sha256(b"good### y</turn>\n").hexdigest() and row.n_turns == 3 and row.formatted_chars == len(whole)
    for r in formatted.collect():
        if r.loss_start is not None:
            assert chat_format.unescape(whole[r.loss_start : r.loss_end]) in ("good", "### y</turn>\n")


def test_chat_edge_cases(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, 5, "assistant", "a:b"), (2, None, "us:er\\", "")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("seq", F.lit(1))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chat(chat_format.conversation_events(conv))).collect()}
    assert got[1].n_turns == 2 and got[None].loss_chars == 3
    assert got[2].turns_sha256 == hashlib.sha256(b"us:er\\\n\n").hexdigest()
    assert chat_format.read_back(chat_format.format_chat(chat_format.conversation_events(conv.limit(0)))).count() == 0


def test_chat_of_a_very_long_text_and_clashing_names(spark):
    text = "### é</turn>\\" * 60_000
    conv = spark.createDataFrame([(1, 0, "assistant", text), (1, 1, "user", "q")], "conv_id long, turn long, role string, text string").withColumns({"position": F.lit(9), "end": F.lit("x")})
    events = chat_format.conversation_events(conv).withColumns({"formatted": F.lit(1), "loss_start": F.lit("y")})
    (row,) = chat_format.read_back(chat_format.format_chat(events)).collect()
    assert (row.n_turns, row.loss_chars, row.loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def plain_components(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "group", "large"), [(4, 85, 64, 32), (2, 60, 3, 2)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, k, percent, group, large):
    monkeypatch.setattr(jaccard_join, "GROUP", group)
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    if group < 64:  # hot tokens and lists in parts, too
        monkeypatch.setattr(jaccard_join, "HOT_LIST", 1)
        monkeypatch.setattr(jaccard_join, "HELD", 2)
        monkeypatch.setattr(jaccard_join, "ASKERS", 2)
    rnd = random.Random(11)
    rows = [(0, None), (1, ""), (2, "one two"), (3, "ONE  two"), (4, "\x1cone two")]
    shared = rnd.choices(WORDS, k=30)
    for base in range(12):
        words = rnd.choices([w + str(base % 4) for w in WORDS], k=rnd.choice((6, 40, 90)))
        for copy in range(rnd.choice((1, 4, 12))):
            w = list(words)
            for _ in range(copy % 5):
                w[rnd.randrange(len(w))] = rnd.choice(WORDS)
            if rnd.random() < 0.3:
                w += shared
            rows.append((len(rows) * 3, " ".join(w)))
    rnd.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(frame(spark, rows), k=k, percent=percent).collect()}
    assert got == plain_components(rows, k, percent)


def test_jaccard_join_edge_cases(spark):
    got = jaccard_join.jaccard_components(frame(spark, EDGE), k=5, percent=80).collect()
    assert len(got) == len(EDGE) and {r.component_id for r in got if r.doc_id in (3, 4)} == {3}
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard_join.jaccard_components(frame(spark, [])).count() == 0


def test_components_of_a_long_path(spark):
    rnd = random.Random(2)
    names = rnd.sample(range(1000), 60)
    links = [(a, b) for a, b in zip(names, names[1:])] + [(2000, 2001), (5, 5), (None, 1)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{n: min(names) for n in names}, 2000: 2000, 2001: 2000}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aes. ,\nxé", max_size=120))
def test_leaves_are_the_text(text):
    raw = text.encode()
    assert b"".join(merkle.leaves(raw)) == raw
    assert merkle.fingerprint(text) == merkle.fingerprint(text) and merkle.fingerprint(text) != merkle.fingerprint(text + "x")


def plain_leaves(raw):
    """The leaf rule by a plain loop: a rolling sum of table values over the last eight bytes, never over a line's start."""
    gear = [xxhash.xxh32_intdigest(bytes([i])) for i in range(256)]
    out, start, line, last = [], 0, 0, -8
    for i, x in enumerate(raw):
        h = sum(gear[raw[i - j]] << j for j in range(min(8, i + 1))) % 2**32
        mark = h >> 28 == 0 and i + 1 - line >= 8
        if mark:
            near, last = i + 1 - last < 8, i + 1
        if x == 10 or (mark and not near):
            out.append(raw[start : i + 1])
            start = i + 1
        if x == 10:
            line = i + 1
    if start < len(raw):
        out.append(raw[start:])
    return [x[i : i + 256] for x in out for i in range(0, len(x), 256)]


def plain_tree(text):
    """(root, {section: {paragraph: leaves}} as nested lists of (digest, ...)) by plain hashing."""
    raw = text.encode()
    parts = plain_leaves(raw)
    lines, now = [], []
    for x in parts:
        now.append(xxhash.xxh3_64_intdigest(x))
        if x.endswith(b"\n"):
            lines.append(now)
            now = []
    if now or not lines:
        lines.append(now)
    sections, of, digests = [], [], b""
    for i, leaves in enumerate(lines):
        digest = hashlib.blake2b(b"".join(d.to_bytes(8, "little") for d in leaves), digest_size=16).digest()
        of.append((digest, leaves))
        digests += digest
        if digest[0] % 4 == 0 or i == len(lines) - 1:
            sections.append((hashlib.blake2b(digests, digest_size=16).digest(), of))
            of, digests = [], b""
    root = hashlib.blake2b(b"".join(d for d, _ in sections) + xxhash.xxh3_128_digest(raw), digest_size=16).hexdigest()
    return root, sections


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = (Counter(d % 2**24 for _, of in plain_tree(t)[1] for _, leaves in of for d in leaves) for t in (a, b))
    total = x.total() + y.total()
    return min(2 * (x & y).total() / total, 0.999999) if total else 0.0


def plain_print(text):
    root, sections = plain_tree(text)
    code = lambda raw: base64.urlsafe_b64encode(raw).decode()
    return root + "|" + ";".join(code(d[:6]) + ":" + ",".join(code(p[:6]) + code(b"".join((x % 2**24).to_bytes(3, "little") for x in leaves)) for p, leaves in of) for d, of in sections)


def test_fingerprints_against_a_plain_version(spark):
    rnd = random.Random(4)
    rows = [(i * 2, "\n".join(" ".join(rnd.choices(WORDS, k=rnd.randint(0, 60))) for _ in range(rnd.randint(1, 9)))) for i in range(40)] + [(1, None), (3, "é" * 700), (None, "last one")]
    got = {r.doc_id: r for r in merkle.edit_likeness(frame(spark, rows)).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + [r for r in rows if r[0] is None]
    opened = 0
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited))
        assert got[i].near_edited == pytest.approx(plain_likeness(t, edited)) and got[i].near_next == pytest.approx(plain_likeness(t, nxt))
        assert merkle.likeness(got[i].fingerprint, got[i].edited_fingerprint) == got[i].near_edited
        mine, theirs = ([(i_, k, p) for i_, (_, of) in enumerate(plain_tree(x)[1]) for k, (p, _) in enumerate(of)] for x in (t, edited))
        gone = Counter(p for *_, p in mine) - Counter(p for *_, p in theirs)
        assert got[i].edited_branches == gone.total()
        opened += got[i].edited_branches > 0
    assert opened > 20
    assert merkle.edit_likeness(frame(spark, [(1, "alone here")])).first().near_next == 1.0
    assert merkle.edit_likeness(frame(spark, [])).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark):
    """Every row once, each followed by the next in one order of all rows, though an id and null hold a third of the rows each."""
    rows = [(5, f"hot {i} " * 9) for i in range(30)] + [(None, f"none {i} " * 9) for i in range(30)] + [(i, f"own {i} " * 9) for i in range(100, 130)] + [(7, "same")] * 3
    got = merkle.edit_likeness(frame(spark, rows)).collect()
    plain = {plain_print(t) for _, t in rows}
    assert len(got) == len(rows) and {r.fingerprint for r in got} == plain
    edited = Counter(r.edited_sha256 for r in got if r.doc_id is None)
    assert len(edited) == 30
    buckets = Counter(r._bucket for r in merkle.followed(frame(spark, rows), "doc_id", "text").where("_extra = 0").collect())
    assert max(buckets.values()) < 45 and len(buckets) > 3


def letters(rnd, first, last, n):
    return "".join(chr(rnd.randrange(first, last)) for _ in range(n))


def scripts():
    rnd = random.Random(6)
    spaced = lambda a, b: " ".join(letters(rnd, a, b, rnd.randint(2, 9)) for _ in range(600))
    return {
        "han": letters(rnd, 0x4E00, 0x9FA5, 3000), "thai": letters(rnd, 0xE01, 0xE2F, 3000), "tabs": "\t".join(letters(rnd, 97, 123, 5) for _ in range(1500)),
        "base64": base64.b64encode(rnd.randbytes(3000)).decode(), "cyrillic": spaced(0x430, 0x450), "upper": spaced(65, 91),
    }


@pytest.mark.parametrize("script", list(scripts()))
def test_likeness_in_every_script(script):
    text, other = scripts()[script], scripts()[script][::-1]
    n, own = len(text), merkle.fingerprint(text)
    assert max(map(len, merkle.leaves(text.encode()))) <= merkle.LONGEST
    half = merkle.likeness(own, merkle.fingerprint(text[: n - n // 2] + other[: n // 2]))
    assert 0.4 < half < 0.6
    for changed in (text[: n // 3] + "x" + text[n // 3 + 1 :], text[: n // 3] + " x " + text[n // 3 :]):
        assert 0.97 < merkle.likeness(own, merkle.fingerprint(changed)) < 1


def test_periodic_text_has_bounded_leaves():
    for text in ("a" * 5000, "漢" * 5000, "ab\n" * 1000):
        parts = merkle.leaves(text.encode())
        assert b"".join(parts) == text.encode() and max(map(len, parts)) <= merkle.LONGEST
    assert len(merkle.leaves(("漢" * 5000).encode())) < 100


def test_edits_are_located():
    lines = [" ".join(random.Random(i).choices(WORDS, k=12)) for i in range(40)]
    a, b = "\n".join(lines), "\n".join(lines[:20] + ["changed entirely"] + lines[21:])
    places = merkle.edits(merkle.fingerprint(a), merkle.fingerprint(b))
    assert len(places) == 1 and merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) > 0.9


def test_frequent_tokens_make_only_rows_that_reach_the_overlap(spark, monkeypatch):
    rnd, plans = random.Random(7), {}
    monkeypatch.setattr(jaccard_join, "GROUP", 4)
    monkeypatch.setattr(jaccard_join, "ASKERS", 2)
    monkeypatch.setattr(jaccard_join, "kept_table", lambda df, name, real=jaccard_join.kept_table: (plans.setdefault(name, df), real(df, name))[1])
    passage = [f"common{i}" for i in range(30)]
    texts = [passage + [f"own{d}x{i}" for i in range(rnd.randint(4, 12))] for d in range(60)]
    texts += [[*t[:-1], "other"] for t in texts[:20]] + [[*t[:-2], "more", "edits"] for t in texts[10:40]]
    grams = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    part = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(grams[i] & grams[j]) >= 80 * len(grams[i] | grams[j]) and part[i] != part[j]:
                low, high = sorted((part[i], part[j]))
                part = [low if p == high else p for p in part]
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    assert got == dict(enumerate(part)) and len(set(part)) > 5
    joins = [line for line in plans["met"]._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line and "token" in line]
    assert joins and any("q_rest" in line and "g_rest" in line for line in joins)
