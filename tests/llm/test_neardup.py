"""The near-dedup stage of the pipeline against all pairs."""

import random
import re

import numpy as np

import corpus_pipeline
from lexweave.llm import neardup
from lexweave.llm.simhash import fingerprint


def planted(seed=3):
    """Texts of five sizes, each with copies in which some words are changed, cut or added."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(5))
    texts = []
    for size in (8, 40, 120, 400, 1500):
        for _ in range(12):
            base = [word() for _ in range(size)]
            texts.append(" ".join(base))
            for changes in (0, 1, size // 100, size // 60, size // 45, size // 20):
                copy = list(base)
                for _ in range(changes):
                    copy[rnd.randrange(len(copy))] = word()
                texts.append(" ".join(copy + [word() for _ in range(rnd.randrange(2))]).upper())
    return texts


def groups(texts, least=0.8):
    """The least index of each text's group by comparing all pairs, and the pairs."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root, pairs = list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if common >= least * (len(a) + len(sets[j]) - common):
                pairs.append((j, i))
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root, pairs


def test_stage_keeps_one_of_each_group_and_all_others(spark):
    texts = planted() + [None, "", " \n", "one two", "One  TWO", "two one"]
    want, pairs = groups(texts)
    far = sum((fingerprint(texts[i]) ^ fingerprint(texts[j])).bit_count() > 2 for i, j in pairs)
    assert far > len(pairs) // 4  # what SimHashes of two bits miss is there
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs).collect()}
    assert found == dict(enumerate(want))
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert {r["doc_id"]: r["text"] for r in kept} == {i: texts[i] for i in set(want)} and len(kept) == len(set(want))


def test_two_bits_are_no_reason_to_drop(spark):
    """A word repeated often outvotes all others in a SimHash, yet the rest of the texts has nothing in common."""
    one, other = ("same " * 200 + " ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    assert (fingerprint(one) ^ fingerprint(other)).bit_count() <= 2 and groups([one, other])[0] == [0, 1]
    docs = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == {1, 2}


def test_pairs_that_the_least_of_a_bucket_leaves_apart(spark, monkeypatch):
    """With one large bucket for all texts the finer buckets find nearly all links, and make none of their own."""
    monkeypatch.setattr(neardup, "band_hashes", lambda found: np.zeros(1, np.int64))
    texts = planted(4)[:168]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = groups(texts)[0]
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs).collect()}
    assert sum(found[i] != w for i, w in enumerate(want)) <= 0.02 * len(texts)
    assert all(want[c] == want[i] for i, c in found.items())


def test_recall_of_the_bands():
    rng, hits, n = np.random.default_rng(1), 0, 1000
    for _ in range(n):  # 80 of 100 shingles in common
        pool = rng.integers(0, 1 << 63, 100).astype(np.uint64)
        hits += bool((neardup.band_hashes(np.sort(pool[:90])) == neardup.band_hashes(np.sort(pool[10:]))).any())
    assert hits / n >= 0.99


def test_texts_are_cut_into_shingles_once_a_pass(spark, monkeypatch):
    """A filter on the columns of the function that makes the sets would move below it: two Python workers a task."""
    plans, write = {}, neardup.stage
    monkeypatch.setattr(neardup, "stage", lambda df, name: write(plans.setdefault(name, df), name))
    texts = planted(5)[:84] + [None, "", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in neardup.near_components(docs).collect()}
    assert found == dict(enumerate(groups(texts)[0]))
    for name in ("sketches", "shingle-sets"):
        plan = plans[name]._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"\b(ArrowEvalPython|MapInPandas)\b", plan)) == 1, plan


def test_shingle_sets_of_other_texts_are_left_out(spark):
    """A row whose text has not the set of its key, as with equal hashes of two texts, gives no set."""
    key = neardup.set_key(neardup.shingle_set("a b c d e f"))
    rows = [(key, "a b c d e f"), (key + 1, "a b c d e f"), (key, None), (neardup.set_key(neardup.shingle_set(None)), None)]
    found = neardup._sets(spark.createDataFrame(rows, "key long, text string"), 5).collect()
    assert sorted((r["key"], len(r["items"])) for r in found) == sorted([(key, 2), (rows[3][0], 0)])
