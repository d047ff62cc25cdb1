"""Operators whose results have a short brute-force version."""

import hashlib
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pyarrow.fs as pafs
import pytest
import xxhash
from tokenizers import Tokenizer

from quarry.llm import packing, sharding, simhash, sstable, substring, tokens
from quarry.llm.automaton import SuffixAutomaton

SMALL = -(2**63)


@cache
def fresh(name):
    """The library's own tokenizer, untouched by the code under test."""
    return Tokenizer.from_file(tokens.tokenizer_path(name))


def ids_of(name, text, end):
    return [*fresh(name).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_encode_as_whole_texts(texts, name):
    odd = ["a  b", "a\n\nb\n", "It's we'll DON'T", "Ωσσος ΣΑΣ. İstanbul", "<|endoftext|> x<|endoftext|>", "é á̀ ño", "a\tb c", "a\u00a0b", "a\x1cb", "a\x85b", " lead", "trail ", "x\0y z", "ab.,cd .,x", "12,345.6", "don't, we're."]
    for t in fresh(name).get_added_tokens_decoder().values():
        odd += [t.content, f"{t.content} x{t.content}", f"word {t.content.upper()} here", f"one {t.content}. two"]
    code = tokens.Encoder(tokens.tokenizer_path(name))
    every = odd + [t or "" for _, t in texts]
    want = [np.array(ids_of(name, t, 0)[:-1], "<u4").tobytes() for t in every]
    for _ in range(2):  # the second time from the cache
        assert code.encode(every) == want


def test_sstable_round_trip(spark, docs, texts, tmp_path):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    files = sstable.write_tables(docs, path, 2, f"file://{tmp_path}/t")
    got = sorted((r["start"], r["doc_id"], bytes(r["ids"])) for r in sstable.read_tables(files).collect())
    want = Counter((SMALL if i is None else i, np.array(ids_of("word_bpe_49k.json", t, 2), "<u4").tobytes()) for i, t in texts)
    assert Counter((i, v) for _, i, v in got) == want
    assert [i for _, i, _ in got] == sorted(i for _, i, _ in got)
    at = 0
    for start, _, value in got:
        assert start == at
        at += len(value) // 4
    name = files.first()["file"]
    with pafs.LocalFileSystem().open_input_file(name) as source:
        table = sstable.Reader(source)
        assert [len(x) for x in table.get(0)] == [len(ids_of("word_bpe_49k.json", texts[0][1], 2))] * 3
        assert table.get(999) == [] and table.get(70)[0].tolist() == [2]


def test_sstable_blocks_and_repeated_keys(tmp_path):
    with open(tmp_path / "x.sst", "wb") as out:
        writer = sstable.Writer(out, 2)
        for k in range(-300, 300):
            for _ in range(3 if k == 7 else 1):
                writer.add(sstable.key_of(k), np.arange(400 + k, dtype="<u2").tobytes())
        writer.close()
    with pafs.LocalFileSystem().open_input_file(str(tmp_path / "x.sst")) as source:
        table = sstable.Reader(source)
        assert len(table.index) > 3 and len(table.get(7)) == 3 and len(table.get(-300)[0]) == 100 and table.get(300) == []
        assert sum(table.may_have(sstable.key_of(k)) for k in range(1000, 3000)) < 100


def test_sstable_of_nothing(none):
    assert sstable.read_tables(sstable.write_tables(none, tokens.tokenizer_path("word_bpe_49k.json"), 2)).count() == 0


def test_packing(docs, none, texts):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    rows = packing.pack(packing.token_pieces(docs, path, 1)).collect()
    held, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], bytes(r["ids"])))
        assert len(r["ids"]) == 4 * r["length"] <= 4 * 2048
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    want = Counter((i, crc(ids_of("byte_bpe_50k.json", t, 1))) for i, t in texts)
    got = Counter()
    for (i, n), pieces in by_doc.items():
        by_start = defaultdict(list)
        for s, v in pieces:
            by_start[s].append(v)
        for k in range(len(by_start[0])):  # repeated rows have equal pieces
            joined = b"".join(by_start[s][k] for s in sorted(by_start))
            assert len(joined) == 4 * n
            got[i, zlib.crc32(joined)] += 1
    assert sum(got.values()) == sum(want.values()) and {i for i, _ in got} == {i for i, _ in want}
    assert packing.pack(packing.token_pieces(none, path, 1)).count() == 0


def test_patterns_hold_every_length_once():
    histogram = {2047: 3, 1500: 2, 1024: 9, 700: 40, 33: 500, 1: 77}
    packs = packing.patterns(histogram)
    assert all(sum(held) <= 2048 for _, held in packs)
    assert Counter({k: sum(n * held.count(k) for n, held in packs) for k in histogram}) == Counter(histogram)
    rows = packing.places(packs)
    assert {k: len(v) for k, v in rows.items()} == {k: sum(held.count(k) for _, held in packs) for k in histogram}


def test_simhash(docs, none, texts):
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(texts) and rows[0].asDict().keys() >= {"source", "shard", "fingerprint", "component_id"}

    def slow(text):
        words = (text or "").encode().lower().split()
        if not words:
            return 0
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
        hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = {t: slow(t) for _, t in texts if len(t or "") < 30_000}
    for r in rows:
        if r["text"] in prints:
            assert r["fingerprint"] == f"{prints[r['text']]:016x}"
    check_components([(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows])
    assert simhash.near_duplicates(none).count() == 0


def check_components(rows):
    prints = sorted({f for _, f, _ in rows})
    parent = {f: f for f in prints}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    least = {}
    for i, f, _ in rows:
        if i is not None:
            least[root(f)] = min(i, least.get(root(f), i))
    assert all(c == least.get(root(f)) for _, f, c in rows)


def test_simhash_links_at_every_distance(spark):
    rng = np.random.default_rng(1)
    prints = []
    for f in rng.integers(0, 2**63, 40).tolist():
        prints.append(f)
        for d in (1, 2, 3, 4, 5):
            g = f
            for b in rng.choice(64, d, replace=False).tolist():
                g ^= 1 << b
            prints.append(g)
    signed = [(int(np.uint64(f).view(np.int64)),) for f in sorted(set(prints))]
    fps = spark.createDataFrame(signed, "k_fp long")
    from quarry.llm.components import connected

    to = {r["a"]: r["b"] for r in connected(simhash.links(fps)).collect()}
    least = defaultdict(list)
    for i, (f,) in enumerate(signed):
        least[to.get(f, f)].append(i)
    check_components([(i, int(np.int64(signed[i][0]).view(np.uint64)), min(m)) for m in least.values() for i in m])


def test_near_duplicate_stage_keeps_one(docs, texts):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    component = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect() if r["doc_id"] is not None}
    ids = [r["doc_id"] for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and set(named) <= set(component) and len(ids) - len(named) == 2
    assert set(component.values()) >= set(named)


def test_substring_dedup(docs, none, texts):
    found = substring.remove_repeats(docs).collect()
    assert len(found) == len(texts)
    rows = sorted({(SMALL if i is None else i, t or "") for i, t in texts}, key=lambda r: r[0])
    order = {}
    for r in docs.selectExpr("coalesce(doc_id, -9223372036854775808L) i", "coalesce(text, '') t", "hash(coalesce(text, '')) h").distinct().collect():
        order[r["i"], r["t"]] = (r["i"], r["h"])
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: order[r]):
        words = t.encode().split()
        cut = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        want[i, t] = (len(words), sum(cut), b" ".join(w for w, c in zip(words, cut, strict=True) if not c).decode())
    assert any(w[1] for w in want.values())
    for r in found:
        assert (r["n_words"], r["n_removed"], r["kept"]) == want[SMALL if r["doc_id"] is None else r["doc_id"], r["text"] or ""]
    digests = {r["doc_id"]: r["kept"] for r in substring.remove_repeats(docs.where("doc_id = 60"), ["doc_id"], digest=True).collect()}
    assert len(digests[60]) == 64
    assert substring.remove_repeats(none).count() == 0


def test_substring_dedup_of_long_texts_and_null_ids(spark, monkeypatch):
    """Texts over many shards, passages that repeat within and across them, and rows without an id."""
    import random

    from .conftest import prose

    monkeypatch.setattr(substring, "CHUNK", 64)
    monkeypatch.setattr(substring, "ASKED", 4)
    rng = random.Random(4)
    passages = [prose(rng, rng.randint(25, 150)) for _ in range(6)]
    rows = [(i if i % 3 else None, " ".join(x for _ in range(rng.randint(1, 6)) for x in (prose(rng, rng.randint(5, 90)), rng.choice(passages)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = {(r["i"], r["t"]): (r["i"], r["h"]) for r in docs.selectExpr("coalesce(doc_id, -9223372036854775808L) i", "text t", "hash(text) h").collect()}
    seen, want = set(), {}
    for i, t in sorted(order, key=order.get):
        words = t.encode().split()
        cut = [False] * len(words)
        for s in range(len(words) - 19):
            key = tuple(words[s : s + 20])
            if key in seen:
                cut[s : s + 20] = [True] * 20
            seen.add(key)
        want[i, t] = b" ".join(w for w, c in zip(words, cut, strict=True) if not c).decode()
    found = substring.remove_repeats(docs).collect()
    assert len(found) == 60 and sum(r["n_removed"] for r in found) > 2000
    for r in found:
        assert r["kept"] == want[SMALL if r["doc_id"] is None else r["doc_id"], r["text"]]


def test_suffix_automaton_statistics():
    import random

    rng = random.Random(5)
    reference = [rng.choice("abc") for _ in range(200)]
    query = [rng.choice("abc") for _ in range(200)]
    automaton = SuffixAutomaton()
    for x in reference:
        automaton.add(x)
    for i, end in enumerate(automaton.matches(query, 5)):
        part = query[max(0, i - 4) : i + 1]
        first = next((j + 4 for j in range(196) if reference[j : j + 5] == part), -1) if len(part) == 5 else -1
        assert end == first


def test_sharding(docs, none, texts):
    rows = sharding.shard_documents(docs, 5).collect()
    assert len(rows) == len(texts) and {r["law"] for r in rows} == {"bytes"}
    for r in rows:
        raw = (r["text"] or "").encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["grown_shard"] is None
    for s in range(5):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    key = lambda r: (hashlib.md5((r["text"] or "").encode()).hexdigest()[:15], SMALL if r["doc_id"] is None else r["doc_id"])
    total, size, group = sum(r["size"] for r in rows), Counter(), Counter()
    for r in rows:
        size[key(r)] += r["size"]
        group[key(r)[0]] += r["size"]
    before, of_group, at = {}, {}, 0
    for k in sorted(size):
        of_group.setdefault(k[0], at)
        before[k] = at
        at += size[k]
    for r in rows:
        k = key(r)
        whole = group[k[0]] * 5 <= 0.02 * total
        assert r["shard"] == min(4, (of_group[k[0]] if whole else before[k]) * 5 // total)
    assert sharding.shard_documents(none).count() == 0


def test_sharding_cuts_a_group_that_fills_shards(spark):
    docs = spark.range(3000).selectExpr("id - 1500 as doc_id", "if(id % 3 > 0, 'same text', concat('t', id)) as text")
    sizes = Counter()
    for r in sharding.shard_documents(docs, 8).select("shard", "size").collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 40


def test_segments_of_many_shards():
    """Runs of windows by shard and part, as grouping one shard after another gives them."""
    rng = np.random.default_rng(8)
    words = [b"w%d" % i for i in range(3000)]
    for many in (1, 3, 400):
        at = np.flatnonzero(rng.random(2900) < 0.4)
        shards, query = rng.integers(-many, many, len(at)), rng.random(len(at)) < 0.7
        want = []
        for shard, asks in sorted(set(zip(shards.tolist(), query.tolist(), strict=True))):
            run: list[int] = []
            for x in [*at[(shards == shard) & (query == asks)].tolist(), None]:
                if run and (x is None or x - run[-1] > 20):
                    want.append({"shard": shard, "query": asks, "start": run[0], "asked": [y - run[0] for y in run], "words": b" ".join(words[run[0] : run[-1] + 20])})
                    run = []
                run.append(x)
        assert substring._segments(words, at, shards, query, 20) == want
    assert substring._segments(words, at[:0], shards[:0], query[:0], 20) == []
