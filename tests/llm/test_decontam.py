"""Posting lists of the decontamination index: only those of phrases' words move."""

import os
import random
from collections import Counter

from quarry.llm import common, decontam

from .conftest import prose


def test_lists_of_other_words_stay(spark, monkeypatch):
    rng = random.Random(17)
    texts = [prose(rng, 60) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(1, " ".join(texts[3].split()[5:20])), (2, " ".join(texts[4].split()[:3])), (3, "none of these"), (4, None)], "item_id long, text string")
    phrases = decontam.phrases_of(items)
    index = decontam.build_index(decontam.indexed_rows(docs, ["doc_id"]))
    words = {w for r in phrases.collect() for w in r["terms"]}
    lists = decontam.asked_lists(index, phrases)
    assert {r["term"] for r in lists.collect()} == words & {w for t in texts for w in t.split()}
    assert "Exchange hashpartitioning" not in lists._jdf.queryExecution().toString()
    columns = ["doc_id", *decontam.OWN]
    few = sorted(decontam.contamination(docs, items).select(*columns).collect())
    assert [r["doc_id"] for r in few if r["n_items"]] == sorted({3, 4} | {i for i, t in enumerate(texts) if " ".join(texts[4].split()[:3]) in " ".join(t.split())})
    monkeypatch.setattr(decontam, "MOST_TERMS", 0)
    assert sorted(decontam.contamination(docs, items).select(*columns).collect()) == few


def test_stage_writes_no_texts(spark, texts, monkeypatch):
    """Only the digests of contaminated texts stay written, and no text is exchanged; repeated rows go or stay together."""
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(texts)], "doc_id long, text string, n_hit int").repartition(3)
    items = spark.createDataFrame([(1, " ".join(texts[3][1].split()[4:20])), (2, texts[0][1]), (3, None)], "item_id long, text string")
    folder = os.path.dirname(common.work_path(spark, "any")).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    left = decontam.drop_contaminated(docs, items)
    assert [t.rpartition("-")[0] for t in set(os.listdir(folder)) - before] == ["contaminated-texts"]
    assert "SortMergeJoin" not in left._jdf.queryExecution().executedPlan().toString()
    judged = decontam.contamination(docs.select("doc_id", "text"), items).where("not contaminated")
    want = Counter((r["doc_id"], r["text"]) for r in judged.collect())
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want and left.columns == docs.columns
    assert 0 < sum(want.values()) < len(texts) and (70, None) in want
    monkeypatch.setattr(common, "MOST_KEYS", 0)
    assert Counter((r["doc_id"], r["text"]) for r in decontam.drop_contaminated(docs, items).collect()) == want
