"""The pipeline's near-copy stage against brute force."""

import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quarry.llm import common, components, neardup

from .conftest import prose


def survivors(rows):
    """Of each component of similar texts the row with the smallest doc_id, null ids last."""

    def grams(text):
        words = (text or "").encode().lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    distinct = list({grams(t) for _, t in rows})
    parent = list(range(len(distinct)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    linked = 0
    for i, a in enumerate(distinct):
        for j, b in enumerate(distinct[:i]):
            if a and b and 5 * len(a & b) >= 4 * len(a | b):
                parent[root(i)] = root(j)
                linked += 1
    at, best = {g: i for i, g in enumerate(distinct)}, {}
    for i, t in rows:
        k = root(at[grams(t)])
        best[k] = min(best.get(k, (True, 0)), (i is None, i or 0))
    return Counter(None if no else i for no, i in best.values()), linked


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


def test_stage_links_word_edited_copies(spark):
    rng = random.Random(9)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(30)]
    texts += [edited(rng, texts[k % 30], rng.randint(1, 4)) for k in range(120)]
    rows = list(enumerate(texts))
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    want, linked = survivors(rows)
    assert linked > 100
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_components_of_a_bucket_equal_all_pairs():
    rng = random.Random(4)
    texts = [prose(rng, 80) for _ in range(4)]
    for _ in range(60):
        texts.append(edited(rng, rng.choice(texts), rng.randint(1, 3)))
    sets = [neardup.shingles(t.encode()) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in neardup.tree_edges(sets):
        both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
        assert 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b)
        parent[root(a)] = root(b)
    want, _ = survivors(list(enumerate(texts)))
    assert len({root(i) for i in range(len(sets))}) == len(want)


def test_stage_keeps_one_row_of_each_component(spark, texts):
    """Repeated and null doc_ids: rows are told apart, and groups of one id don't vanish."""
    rows = [*texts, *((500, t) for _, t in texts[10:16]), (500, "all alone here"), (None, "all alone here"), (None, "a null id alone"), (None, "a null id alone")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, n int").repartition(3)
    kept = corpus_pipeline.simhash_dedup(spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in kept) == survivors(rows)[0]
    assert all((r["doc_id"], r["text"]) == rows[r["n"]] for r in kept)
    texts_kept = [r["text"] for r in kept]
    assert texts_kept.count("all alone here") == texts_kept.count("a null id alone") == 1
    assert neardup.drop_near_copies(docs.limit(0)).count() == 0


def test_fingerprints_meet_at_similarity_four_fifths(spark):
    """Pairs at the least linked similarity share a variant of a SimHash fingerprint; unrelated texts are no candidates."""
    rng = np.random.default_rng(6)
    rows, pairs = [], []
    for size in [5, 9, 18, 45, 90, 180] * 40:
        both = size if size == 5 else size * 8 // 9
        codes = rng.integers(0, 2**63, 2 * size - both, dtype=np.uint64)
        two = [neardup.fingerprint(c) for c in (codes[:size], codes[:4] if size == 5 else codes[size - both :])]
        rows += two
        pairs.append({bytes(name) for name, _ in two})
    assert len({name for name, _ in rows}) == 2 * len(pairs)
    found = neardup.links(spark.createDataFrame(rows, "k_name binary, k_margins binary")).distinct().collect()
    assert sorted(map(sorted, ({bytes(r["a"]), bytes(r["b"])} for r in found))) == sorted(map(sorted, pairs))


def test_large_components_by_blocks(spark, monkeypatch):
    """Components over the bound are compared in blocks: chains of texts, of which the ends aren't similar to the centre."""
    rng = random.Random(13)
    texts = []
    for _ in range(2):
        words = prose(rng, 150).split()
        for k in range(40):
            texts.append(" ".join(words))
            words[3 * k + 5] = prose(rng, 1)
    rows = list(enumerate([*texts, *(prose(rng, 80) for _ in range(5))]))
    monkeypatch.setattr(neardup, "MEMBERS", 8)
    kept = corpus_pipeline.simhash_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter(r["doc_id"] for r in kept.collect()) == survivors(rows)[0]


def test_links_of_a_large_group_are_few(spark):
    """Members of a large group meet in very many buckets, but have hardly more links than the group needs; none is lost."""
    rng = random.Random(21)
    groups = [prose(rng, 150) for _ in range(2)]
    texts = {edited(rng, groups[k % 2], rng.randint(1, 6)) for k in range(800)}
    named = dict(neardup.fingerprint(neardup.shingles(t.encode())) for t in texts)
    emitted = spark.createDataFrame(list(named.items()), "k_name binary, k_margins binary").repartition(3)
    links = [(bytes(r["a"]), bytes(r["b"])) for r in neardup.links(emitted).collect()]
    root = {n: n for n in named}

    def of(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        root[of(a)] = of(b)
    assert len({of(n) for n in named}) == 2
    assert len(links) < 8 * len(named)


def met(named, groups, first):
    """What buckets of the tables from ``first`` on link, in one batch; ``groups``: what is joined already."""
    rows = pa.RecordBatch.from_arrays([pa.array(list(named), pa.binary()), pa.array(list(named.values()), pa.binary()), pa.array(groups, pa.int64())], names=["k_name", "k_margins", "k_group"])
    keys = pa.Table.from_batches(list(neardup._emitted(iter([rows]), first))).sort_by("k_deal").combine_chunks()
    found = pa.Table.from_batches(list(neardup._met(iter(keys.to_batches()))))
    return list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))


def test_buckets_link_no_group_anew():
    """A batch of buckets has fewer links than names, and none within a group; two groups and a name without one are still joined."""
    rng = random.Random(23)
    text = prose(rng, 150)
    named = dict(neardup.fingerprint(neardup.shingles(edited(rng, text, rng.randint(1, 6)).encode())) for _ in range(300))
    n = len(named)
    assert 0.9 * n < len(met(named, [None] * n, 0)) < n
    assert met(named, [5] * n, 4) == []
    assert len(met(named, [5 + k % 2 for k in range(n - 1)] + [None], 4)) == 2


def test_small_tables_are_in_few_files(spark):
    """Components of few links are written in one file, not in one for each shuffle partition."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for name, value in zip(names, ("12", "false"), strict=True):
        spark.conf.set(name, value)
    try:
        stars = components.connected(spark.range(600).where("id % 20 > 0").selectExpr("id a", "id - 1 b"))
        assert len(stars.inputFiles()) == 1
        assert sorted((r["a"], r["b"]) for r in stars.collect()) == [(i, i - i % 20) for i in range(600) if i % 20]
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.set(name, value)


def test_least_linked_equals_components():
    rng = random.Random(22)
    for _ in range(20):
        n = rng.randint(1, 40)
        pairs = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(0, n))]
        least = list(range(n))
        for _ in range(n):
            for a, b in pairs:
                least[a] = least[b] = min(least[a], least[b])
        ends = np.array(pairs, np.int64).reshape(-1, 2)
        assert neardup.least_linked(n, ends[:, 0], ends[:, 1]).tolist() == least


def test_stage_leaves_its_keyed_rows_alone(spark, texts, monkeypatch):
    """Of the tables written on the way only those that the result reads are left; texts are the same with keys exchanged."""
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    before = tables(spark)
    kept = neardup.drop_near_copies(docs)
    assert sorted(t.rpartition("-")[0] for t in tables(spark) - before) == ["copies", "keyed-rows"]
    few = Counter(r["doc_id"] for r in kept.collect())
    monkeypatch.setattr(common, "MOST_KEYS", 0)
    assert Counter(r["doc_id"] for r in neardup.drop_near_copies(docs).collect()) == few


def tables(spark):
    folder = os.path.dirname(common.work_path(spark, "any")).removeprefix("file://")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_only_written_tables_are_kept(spark):
    one = common.condensed(lambda: common.written(common.written(spark.range(5), "first").where("id > 2"), "second"))
    assert sorted(r["id"] for r in one.collect()) == [3, 4]
    outer = common.condensed(lambda: common.written(common.condensed(lambda: common.written(one, "inner")), "outer"))
    assert outer.count() == 2 and not any(t.startswith(("first-", "inner-")) for t in tables(spark))
    with pytest.raises(ValueError):
        common.condensed(lambda: common.written(spark.range(5), "third").where("id > 2"))
