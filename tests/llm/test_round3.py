"""Conversation repair, Merkle manifest and lattice scores against short brute-force versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations, lattice, merkle
from quarry.llm.tokens import tokenizer_path

BLANKS = " \t\n\v\f\r"
PATH = "piece_bpe_32k.model"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- conversation repair


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(key.encode()) % 20
        out[conv] += []
        if kind == 0:
            continue
        if kind in (1, 2):
            text = "" if kind == 1 else re.sub("[.!?]", "", text)
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        rest = text.rstrip(BLANKS)
        out.append("blank" if not rest.strip(BLANKS) else "duplicate" if (role, text) in seen else "truncated" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (rows read, initials written), all edits of all rows; the grammar as a pattern of whole strings."""
    ok = re.compile(r"(s?(ua)+)?")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, label, i, made, out = heapq.heappop(heap)
        if i == len(rows) and ok.fullmatch(made):
            return cost, label, "\n".join(f"{r}:{t}" for r, t in out)
        if (i, made) in seen:
            continue
        seen.add((i, made))

        def push(more, letter, to, initial="", turn=()):
            if re.fullmatch(r"(s?(ua)*u?)?", made + initial):
                heapq.heappush(heap, (cost + more, label + letter, to, made + initial, out + turn))

        if len(made) < len(rows) * 2 + 2:
            for name in ("user", "assistant"):
                push(2, "I", i, name[0], ((name, ""),))
        if i < len(rows):
            _, role, text = rows[i]
            push(3, "D", i + 1)
            if found[i] not in ("blank", "duplicate"):
                extra = int(found[i] == "truncated")
                if role[:1]:
                    push(extra, "K", i + 1, role[:1], ((role, text),))
                for name in ("user", "assistant"):
                    push(2 + extra, "R", i + 1, name[0], ((name, text),))


def audit(rows):
    out = {}
    for conv, kept in damage(rows).items():
        found, turns = faults(kept), [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:], strict=False))
        cost, label, text = cheapest(kept, found)
        out[conv] = (gaps, *(found.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, label, sha(text))
    return out


def odd_conversations():
    rng = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"])
            text = rng.choice(["Yes.", "no", " \t", "", None, f"Say {turn}!", f"Say {turn}", "Yes.\n", "é漢😀?"])
            rows.append((conv, rng.choice([turn, turn, None, turn * 3]), role, text))
    rows += [(None, 0, "user", "Hi."), (None, 1, "assistant", "So."), (None, None, "system", "Be."), (70, None, "user", "a."), (70, None, "user", "a."), (71, -(2**62), "user", "x" * 5000 + ".")]
    return rows + rows[:5]


SCHEMA = "conv_id long, turn long, role string, text string"


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("bits", [12, 1])
def test_repair_equals_all_edits(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "BLOCK_BITS", bits)
    rows = odd_conversations()
    given = spark.createDataFrame(rows, SCHEMA).withColumn("cost", F.lit("mine")).repartition(3)
    found = conversations.repair(given)
    assert result(found) == audit(rows) and found.count() == len({r[0] for r in rows})


def test_repaired_turns_make_the_digest(spark):
    rows = odd_conversations()
    ordered = conversations.ordered(conversations.damaged(spark.createDataFrame(rows, SCHEMA)))
    turns = defaultdict(list)
    for r in conversations.repaired_turns(ordered, conversations.choices(ordered)).orderBy("k_conv", "position").collect():
        turns[r["k_conv"]].append(f"{r['role']}:{r['text']}")
    want = audit(rows)
    assert {k: sha("\n".join(v)) for k, v in turns.items()} == {("" if c is None else f"={c}"): v[-1] for c, v in want.items() if v[-1] != conversations.EMPTY_HASH}


def test_one_long_conversation(spark):
    """Many rows of one conversation, and many equal ones, over several blocks."""
    rows = [(1, i, ("user", "assistant")[i % 2], f"Turn {i}.") for i in range(9000)] + [(1, 7, "user", "again.")] * 3000
    got = result(conversations.repair(spark.createDataFrame(rows, SCHEMA)))[1]
    kept = damage(rows)[1]
    found = faults(kept)
    assert got[1:4] == tuple(found.count(x) for x in ("blank", "duplicate", "truncated")) and got[2] >= 2999
    letters = Counter(got[6])
    assert sum(letters[x] for x in "KRD") == len(kept) and letters["D"] * 3 + letters["R"] * 2 + letters["I"] * 2 + sum(f == "truncated" for f, e in zip(found, got[6].replace("I", ""), strict=True) if e != "D") == got[5]


def test_repair_of_nothing(spark):
    assert conversations.repair(spark.createDataFrame([], SCHEMA)).count() == 0


# --- Merkle manifest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def siblings(tree, at):
    out = []
    for level in tree[:-1]:
        other = at ^ 1
        out.append((level[other], bool(at & 1)) if other < len(level) else (None, bool(at & 1)))
        at >>= 1
    return out


def proofs(rows):
    langs = defaultdict(list)
    for doc, source, lang, n, text in rows:
        leaf = sha("".join(map(field, (doc, source, lang, n, text))))
        changed = doc is not None and n is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        langs[lang].append(((doc is not None, doc or 0, leaf), doc, leaf, sha("".join(map(field, (doc, source, lang, n + 1, text)))) if changed else leaf))
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: levels([r[2] for r in sorted(langs[x], key=lambda r: r[0])]) for x in order}
    top = levels([trees[x][-1][0] for x in order])
    out = []
    for i, lang in enumerate(order):
        for at, (_, doc, leaf, used) in enumerate(sorted(langs[lang], key=lambda r: r[0])):
            path, node = siblings(trees[lang], at) + siblings(top, i), used
            for other, left in path:
                node = sha(node if other is None else other + node if left else node + other)
            out.append((doc, leaf, trees[lang][-1][0], top[-1][0], sha("".join(x for x, _ in path if x)), node, node == top[-1][0]))
    return sorted(out, key=str)


def test_manifest_equals_whole_trees(spark, texts, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK_BITS", 2)
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", None, ""]), rng.choice(["en", "en", "en", "de", None, "", "é", "zz"]), rng.choice([0, None, 2**63 - 1, len(t or "")]), t) for i, t in texts]
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    given = spark.createDataFrame(rows, schema).withColumns({"leaf": F.lit(1), "root": F.lit(2)}).repartition(3)
    found = merkle.tampered_proofs(given, keep=["doc_id"]).select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("p"), "folded_root", "verified")
    got = sorted((tuple(r) for r in found.collect()), key=str)
    assert got == proofs(rows) and {v for *_, v in got} == {True, False}
    assert merkle.tampered_proofs(given).columns == ["doc_id", "source", "lang", "n_chars", "text", "leaf", "proof", "subroot", "root", "folded_root", "verified"]
    assert merkle.tampered_proofs(given.limit(0)).count() == 0


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 11, 16, 63, 64, 65, 200, 256])
def test_traversal_holds_few_nodes(monkeypatch, count):
    leaves = [sha(str(i)).encode() for i in range(count)]
    height = (count - 1).bit_length()
    tree = levels([x.decode() for x in leaves])
    held = []
    step = merkle.Treehash.step
    monkeypatch.setattr(merkle.Treehash, "step", lambda self: (step(self), held.append(len(self.stack))))
    got = [[x and x.decode() for x in own] for own in merkle.traversal(leaves, height)]
    assert got == [[x for x, _ in siblings(tree, i)] for i in range(count)]
    assert merkle.block_root(leaves, height).decode() == tree[-1][0]
    assert max(held, default=0) <= height + 1


def test_tampered_rows_fail(spark):
    rows = [(i, "s", "en", i, f"text {i}") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    bad = {r["doc_id"] for r in merkle.tampered_proofs(df).where("not verified").collect()}
    assert bad == {i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 0}


# --- lattice scores


def brute(word, vocab, probability):
    """Sum over all segmentations, by recursion over prefixes, in plain floats."""
    pieces = {p: i for i, p in enumerate(vocab.pieces)}
    text, sums = b" " + word, [1.0]
    for end in range(1, len(text) + 1):
        total = sums[end - 1] * probability[vocab.bytes_at + text[end - 1]]
        for start in range(end):
            if (i := pieces.get(text[start:end])) is not None:
                total += sums[start] * probability[i]
        sums.append(total)
    return sums[-1]


def test_lattice_sums_all_segmentations():
    vocab = lattice.vocabulary(tokenizer_path(PATH))
    score = np.log(vocab.prior)
    assert abs(vocab.prior.sum() - 1) < 1e-9 and b" the" in vocab.pieces
    for word in (b"the", b"a", b"international,", "é漢字😀".encode(), b"zq\x00\xffx", b"aaaaaaaaaaaa"):
        raw = np.frombuffer(b" " + word, np.uint8)[None, :].repeat(2, 0)
        found = vocab.forward(raw, score)[-1]
        assert np.allclose(found, math.log(brute(word, vocab, vocab.prior)))
        total = np.zeros(len(score))
        vocab.expected(raw, np.array([1.0, 2.0]), score, total)
        sizes = np.array([len(p) for p in vocab.pieces] + [1] * 256 + [0])
        assert np.isclose((total * sizes).sum(), 3 * raw.shape[1])  # every byte lies in one piece of each segmentation


@pytest.mark.parametrize("frequent", [20, 200_000])
def test_scores_equal_plain_sums(spark, docs, texts, monkeypatch, frequent):
    monkeypatch.setattr(lattice, "FREQUENT", frequent)
    monkeypatch.setattr(lattice, "HELD_COUNT", 50)
    path = tokenizer_path(PATH)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    split = [(i, (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()) for i, t in texts]
    count, trained = Counter(w for i, ws in split if not held(i) for w in ws), sum(not held(i) for i, _ in split)
    total, distinct = sum(count.values()) + trained, len(count) + 1
    vocab = lattice.vocabulary(path)
    score = np.log(vocab.prior)
    likelihoods = []
    for _ in range(2):
        expected = np.zeros(len(score))
        for w, c in count.items():
            vocab.expected(np.frombuffer(b" " + w, np.uint8)[None, :], np.array([float(c)]), score, expected)
        expected[vocab.end] = trained
        score = np.log((expected + lattice.PRIOR * vocab.prior) / (expected.sum() + lattice.PRIOR))
        likelihoods.append(sum(c * vocab.forward(np.frombuffer(b" " + w, np.uint8)[None, :], score)[-1][0] for w, c in count.items()))
    assert likelihoods[0] < likelihoods[1]
    want = []
    for i, ws in split:
        base = sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws) + math.log10((trained + 1) / (total + distinct + 1))
        own = (sum(vocab.forward(np.frombuffer(b" " + w, np.uint8)[None, :], score)[-1][0] for w in ws) + score[vocab.end]) / math.log(10)
        want.append((str(i), held(i), len(ws) + 1, sum(w in count for w in ws) + 1, total, base, own))
    got = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lattice.score_texts(docs.withColumn("score", F.lit("mine")), path, rounds=2).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_scores_without_training_rows(spark, none):
    path = tokenizer_path(PATH)
    assert lattice.score_texts(none, path).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row = lattice.score_texts(spark.createDataFrame([(only, "the end")], "doc_id long, text string"), path).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (3, 0, 0, 0.0) and row["score"] < 0


# --- keys of rows


def test_texts_of_one_id_with_one_hash_are_told_apart(spark):
    """(1, A), (5, A), (5, B) with hash(A) = hash(B): B repeats nowhere and loses nothing."""
    from quarry.llm.substring import remove_repeats

    each = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.hex(F.col("id") * 31 + i), F.lit("w"))), " ")
    made = spark.range(200_000).select(each.alias("t")).withColumn("h", F.hash("t"))
    a, b = made.groupBy("h").agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first()["ts"][:2]
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (5, b), (None, a), (None, b)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"], r["kept"]) for r in remove_repeats(rows).collect())
    assert got == Counter([(1, 30, ""), (5, 30, ""), (5, 30, ""), (5, 30, ""), (None, 0, a), (None, 0, b)])


def test_pieces_of_null_ids_use_all_buckets(spark, monkeypatch):
    from quarry.llm import packing

    counted = []
    keep = packing.written
    monkeypatch.setattr(packing, "written", lambda df, name: (counted.append((name, out := keep(df, name))), out)[1])
    rows = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(7).cast("long").alias("length"))
    assert packing.pack(rows).select("sequence_id", "offset").distinct().count() == 20_000
    assert dict(counted)["piece-counts"].count() == packing.LEAST_BUCKETS
