"""The pipeline's stages against plain versions of what they keep."""

import random
import re
from collections import Counter

import corpus_pipeline
from trialscope.llm.exact_dedup import exact_dedup
from trialscope.llm.jaccard_join import jaccard_components
from trialscope.llm.quality_gam import score_quality
from trialscope.llm.toxicity_lm import score_toxicity

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma".split()


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_each_stage_keeps_what_its_operator_says(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "toxicity", "exact_dedup", "near_dedup", "packing"]
    assert ids(stages["quality"](spark, docs, SF)) == ids(score_quality(docs, labels).where("predicted = 1"))
    assert ids(stages["toxicity"](spark, docs, SF)) == ids(score_toxicity(docs, labels).where("predicted = 0"))
    assert ids(stages["exact_dedup"](spark, docs.union(docs.limit(5)), SF)) == ids(exact_dedup(docs).where("kept"))
    near = stages["near_dedup"](spark, docs, SF)
    assert ids(near) == ids(jaccard_components(docs).where("doc_id = component_id")) and near.columns == docs.columns
    assert set(ids(stages["packing"](spark, near, SF))) == set(ids(near))


LABELS = "doc_id long, quality int, toxic int"


def test_dedup_stages_against_plain_versions(spark):
    """Exact and near dedup by plain loops, with null and repeated ids, empty texts, ties and columns of clashing names."""
    rnd = random.Random(9)
    base = [" ".join(rnd.choices(WORDS, k=40)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, t.replace(" ", "  \t")) for i, t in enumerate(base[:5])]  # equal after white space is one space
    rows += [(200 + i, t + " end") for i, t in enumerate(base[3:9])]  # near copies
    rows += [(300, None), (301, ""), (302, " "), (None, base[0]), (None, "none has me"), (7, base[7]), (303, "two words"), (304, "two words")]
    docs = spark.createDataFrame([(i, t, "x", i, "a", {"k": "v"}) for i, t in rows], "doc_id long, text string, _sha string, _n long, id string, keep_id map<string,string>")
    exact = dict(corpus_pipeline.STAGES)["exact_dedup"](spark, docs, "")
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    last = lambda i: (i is None, i or 0)
    stay = {}
    for i, t in rows:
        if norm(t) not in stay or last(i) < last(stay[norm(t)]):
            stay[norm(t)] = i
    assert exact.columns == docs.columns
    assert Counter((r.doc_id, norm(r.text)) for r in exact.collect()) == Counter((i, t) for t, i in stay.items())
    near = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    least = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                alike = any(x and y and len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b])
                if alike and least[a] > least[b]:
                    least[a], changed = least[b], True
    assert near.columns == docs.columns
    want = Counter((i, t) for i, t in rows if i is None or least[i] == i)
    assert Counter((r.doc_id, r.text) for r in near.collect()) == want and sum(want.values()) < len(rows) - 8


def test_filtering_stages_reject_what_is_planted(spark, tmp_path):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(500):
        words, kind = rnd.choices(WORDS, k=60), i % 4
        for k in range(8):
            if kind in (1, 2):
                words[rnd.randrange(60)] = rnd.choice(("#$%&*", "!!!!")) if kind == 1 else "vile" + rnd.choice(("ness", "ly", "st"))
        rows.append((i, " ".join(words), kind))
        if i % 3:
            labels.append((i, int(kind != 1), int(kind == 2)))
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind int")
    stages = dict(corpus_pipeline.STAGES)
    for name, bad in (("quality", 1), ("toxicity", 2)):
        kept = Counter(r.kind for r in stages[name](spark, docs, str(tmp_path)).collect())
        assert kept[bad] < 10 and all(kept[k] > 115 for k in range(4) if k != bad)
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, str(tmp_path))
        assert none.count() == 0


def test_filtering_stages_on_held_out_rows_of_the_given_tables(spark):
    """What the quality and toxicity stages drop of the held-out labelled rows, by the labels themselves."""
    docs, labels = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet"), spark.read.parquet(f"{SF.replace('0.001', '0.01')}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, column, folds, fold, good in (("quality", "quality", 5, 0, 1), ("toxicity", "toxic", 4, 2, 0)):
        held = labels.where(f"crc32(cast(doc_id as string)) % {folds} = {fold} and {column} is not null").select("doc_id", column).collect()
        kept = set(ids(stages[name](spark, docs, SF.replace("0.001", "0.01"))))
        caught = [r.doc_id not in kept for r in held if r[column] != good]
        spared = [r.doc_id in kept for r in held if r[column] == good]
        # Of the fourteen held-out toxic documents five have no word that marks any other toxic one.
        assert sum(caught) / len(caught) >= 0.6 and sum(spared) / len(spared) >= 0.85
