"""Secret scans: base patterns, and a conditional random field that adds spans.

Lines are sequences of white-space tokens, tagged secret begin, inside or outside. Features are a
token's shape, length, changes of character class and key words, those of both neighbours, and
classes of the whole text (share of tokens with digits, words a line). The field learns from whole
documents of a bounded sample: the MAX_DOCS with a base pattern's lead and the MAX_DOCS others with
the smallest hash of their id. So that it finds what no base pattern fits, lines with a base value
also enter with the value masked by made-up secrets of other styles, its cue changed or gone, and
harmless tokens such as addresses, dates and numbers beside it. It then tags all lines of all texts by Viterbi; a line is skipped only
where no token can outweigh what leaving the outside tag costs, so its decoding is known. Tagged
runs that don't overlap a base span are added as kind ``model``.

Null text: empty. Without base spans to learn from nothing is added. Repeated rows get the same
answer. Spans are in code points, end exclusive. Other columns pass through; the operator's own
columns replace input columns of the same names.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import crf
from .common import written
from .texts import texts_of, with_columns

#: The base patterns.
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")  # maximal runs of 32 or more
LEADS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAD_PATTERN = r"""(?:[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[A-Za-z"']*\x20*[:=]|AKIA|[0-9a-f]{32}"""
KINDS = ("assign", "access", "hex", "model")
MAX_DOCS = 200  # of either kind, that the field learns from
STEPS = 24  # tokens in a training sequence
VARIANTS = 12  # perturbed copies of a training line with a value
LOWER, DIGITS, HEX_DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
UPPER = LOWER.upper()
ALNUM = LOWER + UPPER + DIGITS
FILE_CLASSES = 16
MASK = "[REDACTED]"

_EDGE = b"\"'.,;:!?()[]{}<>|*$%&#-`"


def base_spans(text: bytes, value: int = 0) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind as listed; with value=2 of assigned values alone."""
    low = text.lower()
    found = []
    if any(x in low for x in LEADS):
        found += [(*m.span(value), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def word_key(word: bytes) -> tuple[str, ...]:
    """The features of a token."""
    core = word.strip(_EDGE)
    if not core:
        return ("mark", f"mark:{'=' if b'=' in word else ':' if b':' in word else '-'}")
    if core.isalpha():
        shape = "low" if core.islower() else "UP" if core.isupper() else "Title" if core.istitle() else "miXed"
    else:
        has = lambda test: any(map(test, core))
        shape = ("a" if has(lambda c: 97 <= c <= 122) else "") + ("A" if has(lambda c: 65 <= c <= 90) else "") + ("0" if has(lambda c: 48 <= c <= 57) else "") + ("u" if core[0] >= 128 or not core.isascii() else "") + ("/" if has(lambda c: c in b"+/=_-") else "") + ("@" if b"@" in core or b"://" in core else "")
    length = f"len:{min(len(core) // 8, 5)}"
    out = ["shape:" + shape, length, shape + length]
    low = core.lower()
    if any(x in low for x in LEADS):
        out.append("lead")
    if len(core) >= 16 and not low.strip(b"0123456789abcdef"):
        out.append("hexes")
    if word[:1] in b"\"'":
        out.append("quoted")
    if word[-1:] in b"=:":
        out.append("assigns")
    if b"=" in core or b":" in core:
        out.append("joins")
    if b"." in core:
        out.append("dots")
    kinds = [0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 3 if c < 128 and not 97 <= c <= 122 else 2 for c in core]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False))
    out += [f"turns:{min(turns, 12) // 3}", f"turns:{min(turns, 12) // 3}{length}", f"rate:{min(3, 8 * turns // len(core))}{length}"]
    return tuple(out)


class Keys(dict):
    """Token to the number of its key; keys are few, remembered tokens bounded."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.keys_of: list[tuple[str, ...]] = []
        self.number: dict[tuple[str, ...], int] = {}
        self.most = most

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        got = self.number.get(key)
        if got is None:
            got = self.number[key] = len(self.keys_of)
            self.keys_of.append(key)
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = got
        return got


def file_class(n_tokens: int, n_lines: int, n_digits: int) -> int:
    share = n_digits / max(n_tokens, 1)
    return 4 * int(np.searchsorted([0.002, 0.02, 0.2], share)) + int(np.searchsorted([4, 20, 60], n_tokens / max(n_lines, 1)))


def _lines(text: bytes) -> list[list[bytes]]:
    return [x.split() for x in text.split(b"\n")]


def _places(line: bytes) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", line)]


#: Words before a made-up secret, besides the base patterns' own.
CUES = ("key", "pwd", "auth", "credential", "bearer", "access", "private", "login")


def made_up(rng: random.Random) -> list[str]:
    """The tokens of a secret of a random style, longer or shorter than any the base patterns know."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    style = rng.randrange(8)
    if style == 0:
        return [some(HEX_DIGITS.upper(), rng.choice((16, 24, 32, 40)))]
    if style == 1:
        return [some(ALNUM + "+/", rng.randint(20, 60)) + "=" * rng.randrange(3)]
    if style == 2:
        return [some(LOWER + DIGITS, rng.randint(14, 40))]
    if style == 3:
        mark = rng.choice("_-")
        return [mark.join([some(LOWER, rng.randint(2, 5)) for _ in range(rng.randint(1, 2))] + [some(ALNUM, rng.randint(16, 48))])]
    if style == 4:
        mark = rng.choice("-_.")
        return [mark.join(some(ALNUM, rng.randint(6, 24)) for _ in range(rng.randint(2, 4)))]
    if style == 5:
        return [some(UPPER + DIGITS, 4) + some(DIGITS, 1) for _ in range(rng.randint(3, 5))]
    return [some(ALNUM + rng.choice(("", "-_")), rng.randint(10, 16) if style == 6 else rng.randint(12, 40))]


def harmless(rng: random.Random) -> str:
    """A token with digits or marks that is no secret."""
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    word, number = some(LOWER, rng.randint(3, 9)), some(DIGITS, rng.randint(1, 4))
    return rng.choice((
        f"{word}.{number}@{some(LOWER, 5)}.com", f"https://{word}.org/{some(LOWER, 6)}/{number}", some(DIGITS, rng.randint(1, 16)),
        f"20{some(DIGITS, 2)}-0{some('123456789', 1)}-1{some(DIGITS, 1)}", f"v{number}.{some(DIGITS, 1)}.{some(DIGITS, 1)}", f"{word}_{number}.png", f"{word}-{some(LOWER, 7)}",
        f"+{some(DIGITS, 2)}-{some(DIGITS, 3)}-{some(DIGITS, 7)}", f"{word}{some(DIGITS, 2)}", f"{some(UPPER, 2)}-{number}", f"/{word}/{some(LOWER, 5)}/{number}.txt", f"{number}.{some(DIGITS, 2)}%",
    ))


def perturbed(rng: random.Random, words: list[bytes], tags: list[int]) -> tuple[list[bytes], list[int]]:
    """A line with each value masked by a made-up secret, its cue changed or gone, and harmless tokens."""
    out: list[tuple[bytes, int]] = []
    for word, tag in zip(words, tags, strict=True):
        if tag != crf.OUT:
            new = made_up(rng)
            quote, cue = rng.choice(("", "", '"', "'")), rng.choice(CUES)
            if rng.random() < 0.3:
                new[0] = f"{cue}{rng.choice('=:')}{quote}{new[0]}"
            else:
                new[0] = quote + new[0]
                if rng.random() < 0.5:
                    out.append((f"{cue}{rng.choice(('', '=', ':', ' ='))}".encode(), crf.OUT))
            new[-1] += quote + rng.choice(("", "", ",", "."))
            out += [(x.encode(), crf.BEGIN if k == 0 else crf.INSIDE) for k, x in enumerate(new)]
        elif not any(x in word.lower() for x in LEADS) and word.strip(b"=:"):
            out.append((word, crf.OUT))
        if rng.random() < 0.1:
            out.append((harmless(rng).encode(), crf.OUT))
    return [w for x, _ in out for w in x.split()], [t for x, t in out for _ in x.split()]


def training_rows(text: bytes, variants: int = 0) -> list[tuple[list[bytes], list[int]]]:
    """All lines of a text (tokens, tags), cut to STEPS; lines with a value also perturbed, ``variants`` times."""
    spans = base_spans(text, 2)
    rng, lines, at, k = random.Random(zlib.crc32(text)), [], 0, 0
    for line in text.split(b"\n"):
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        own = []
        for a, b, _ in spans[k:]:
            if a >= at + len(line):
                break
            own.append((a - at, b - at))
        tags, last = [], None
        places = _places(line)
        for a, b in places:
            hits = [i for i, (s, e) in enumerate(own) if s < b and e > a]
            tags.append(crf.OUT if not hits else crf.INSIDE if hits[0] == last else crf.BEGIN)
            last = hits[-1] if hits else None
        words = [line[a:b] for a, b in places]
        lines.append((words, tags))
        lines += [perturbed(rng, words, tags) for _ in range(variants if any(tags) else 0)]
        at += len(line) + 1
    out = []
    for words, tags in lines:
        k = 0
        while k < len(words):
            end = min(k + STEPS, len(words))
            while end < len(words) and tags[end] == crf.INSIDE and end > k + 1:
                end -= 1  # a secret isn't cut
            out.append((words[k:end], tags[k:end]))
            k = end
    return [x for x in out if x[1][0] != crf.INSIDE]


def fit_secrets(docs: DataFrame, max_docs: int = MAX_DOCS) -> crf.Chain | None:
    """A field fitted on a bounded sample of whole documents; None without base spans in it."""
    named = docs.where("doc_id is not null").select("doc_id", F.coalesce(F.col("text").rlike(LEAD_PATTERN), F.lit(False)).alias("k_lead"))
    named = written(named, "leads")  # texts are searched once for both choices
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = [named.where(F.col("k_lead") == kind).select("doc_id").distinct().orderBy(*order).limit(max_docs) for kind in (True, False)]
    rows = docs.select("doc_id", "text").join(F.broadcast(ids[0].union(ids[1]).distinct()), "doc_id")  # at most 2 * max_docs ids

    def make():
        def work(part: pa.RecordBatch) -> list:
            out: list[list] = [[], [], [], [], []]
            for text in texts_of(part):
                lines = _lines(text)
                found = training_rows(text, VARIANTS)
                keys: dict[tuple, int] = {}
                ids = [keys.setdefault(word_key(w), len(keys)) for words, _ in found for w in words]
                made = (
                    file_class(sum(map(len, lines)), len(lines), sum(any(48 <= c <= 57 for c in w) for x in lines for w in x)),
                    ["\t".join(k) for k in keys], np.array(ids, "<u4").tobytes(), bytes(t for _, tags in found for t in tags), bytes(len(tags) for _, tags in found),
                )
                for column, x in zip(out, made, strict=True):
                    column.append(x)
            return out

        return work

    fields = [T.StructField("k_file", T.IntegerType()), T.StructField("k_keys", T.ArrayType(T.StringType())), *(T.StructField(c, T.BinaryType()) for c in ("k_ids", "k_tags", "k_sizes"))]
    got = with_columns(rows, make, fields, keep=["doc_id"]).dropDuplicates(["doc_id"]).orderBy("doc_id").limit(2 * max_docs).collect()
    keys = sorted({tuple(k.split("\t")) for r in got for k in r["k_keys"]})
    number = {k: i for i, k in enumerate(keys)}
    sizes = np.concatenate([np.frombuffer(r["k_sizes"], np.uint8) for r in got] or [np.zeros(0, np.uint8)]).astype(np.int64)
    tags = np.zeros((len(sizes), STEPS), np.int64)
    if not any(any(r["k_tags"]) for r in got):
        return None
    tokens, there = np.zeros_like(tags), np.arange(STEPS) < sizes[:, None]
    tokens[there] = np.concatenate([np.array([number[tuple(k.split("\t"))] for k in r["k_keys"]], np.int64)[np.frombuffer(r["k_ids"], "<u4")] for r in got if r["k_keys"]])
    tags[there] = np.concatenate([np.frombuffer(r["k_tags"], np.uint8) for r in got])
    files = np.repeat([r["k_file"] for r in got], [len(r["k_sizes"]) for r in got])
    return crf.fit(keys, tokens, files, tags, sizes, FILE_CLASSES)


class Tagger:
    """Tags whole texts; scores of keys are kept in tables that grow as keys are met."""

    def __init__(self, chain: crf.Chain):
        self.chain, self.keys = chain, Keys()
        self.tables = [np.zeros((0, crf.TAGS))] * 3
        self.digits = np.zeros(0, bool)

    def _grow(self) -> None:
        have = len(self.digits)
        if have < len(self.keys.keys_of):
            new = self.keys.keys_of[have:]
            self.tables = [np.r_[a, b] for a, b in zip(self.tables, self.chain.rows(new), strict=True)]
            self.digits = np.r_[self.digits, [any(f.startswith("shape:") and "0" in f for f in k) for k in new]]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """Byte spans of tagged runs in each text."""
        lines = [_lines(t) for t in texts]
        words = [w for x in lines for y in x for w in y]
        ids = np.fromiter(map(self.keys.__getitem__, words), np.int64, len(words))
        self._grow()
        per_line = np.array([len(y) for x in lines for y in x], np.int64)
        n_lines = np.array([len(x) for x in lines], np.int64)
        line_text = np.repeat(np.arange(len(texts)), n_lines)
        token_line = np.repeat(np.arange(len(per_line)), per_line)
        n_tokens = np.bincount(line_text, per_line, len(texts)).astype(np.int64)
        n_digits = np.bincount(line_text[token_line], self.digits[ids], len(texts)).astype(np.int64) if len(ids) else n_tokens
        files = np.array([file_class(*x) for x in zip(n_tokens.tolist(), n_lines.tolist(), n_digits.tolist(), strict=True)], np.int64)
        own, left, right = self.tables
        score = own[ids] + self.chain.file[files[line_text[token_line]]]
        same = token_line[1:] == token_line[:-1]
        score[1:] += left[ids[:-1]] * same[:, None]
        score[:-1] += right[ids[1:]] * same[:, None]
        gain = score[:, 1:].max(1) - score[:, crf.OUT] + self.chain.slack if len(ids) else np.zeros(0)
        open_ = np.unique(token_line[gain >= 0])
        starts = np.r_[0, np.cumsum(per_line)]
        first_line = np.r_[0, np.cumsum(n_lines)]
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        for k in open_:
            tags = crf.viterbi(score[starts[k] : starts[k + 1]], self.chain.moves)
            if not tags.any():
                continue
            text = int(line_text[k])
            raw = texts[text].split(b"\n")
            at = sum(map(len, raw[: k - first_line[text]])) + int(k - first_line[text])
            places = _places(raw[k - first_line[text]])
            for i in np.flatnonzero(tags == crf.BEGIN):
                j = i + 1
                while j < len(tags) and tags[j] == crf.INSIDE:
                    j += 1
                out[text].append((at + places[i][0], at + places[j - 1][1]))
        return out


def _rest(text: bytes, run: tuple[int, int], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What a tagged run adds: its tokens that no base span overlaps, neighbours as one span."""
    at, end = run
    base = [(a, b) for a, b, _ in base if a < end and b > at]
    if not base:
        return [(at, end, "model")]
    out, last = [], None
    for k, (a, b) in enumerate(_places(text[at:end])):
        if any(s < at + b and e > at + a for s, e in base):
            continue
        if out and last == k - 1:
            out[-1] = (out[-1][0], at + b, "model")
        else:
            out.append((at + a, at + b, "model"))
        last = k
    return out


def _points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Byte spans as spans of code points."""
    if not spans or text.isascii():
        return spans
    count = np.r_[0, np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)]
    return [(int(count[a]), int(count[b]), k) for a, b, k in spans]


def _named(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def masked(text: bytes, spans: list[tuple[int, int, str]], mask: str = MASK) -> bytes:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mask.encode()]
        elif b <= at:
            continue
        at = max(at, b)
    return b"".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, model: crf.Chain | None = None, redact: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, more) with n_assign, n_access, n_hex, base_sha256 and spans.

    With ``redact``, text holds MASK in place of every span.
    """
    chain = model or fit_secrets(docs)

    def make():
        tagger = Tagger(chain) if chain else None

        def work(part: pa.RecordBatch) -> list:
            texts = texts_of(part)
            added = tagger.spans(texts) if tagger else [[] for _ in texts]
            counts, digests, named, new = [], [], [], []
            for text, more in zip(texts, added, strict=True):
                base = base_spans(text)
                spans = sorted(base + [x for run in more for x in _rest(text, run, base)], key=lambda x: (x[0], KINDS.index(x[2])))
                counts.append([sum(k == kind for _, _, k in base) for kind in KINDS[:3]])
                digests.append(hashlib.sha256(_named(_points(text, base)).encode()).hexdigest())
                named.append(_named(_points(text, spans)))
                if redact:
                    new.append(masked(text, spans).decode() if spans else text.decode())
            columns = [*np.array(counts, np.int64).reshape(-1, 3).T, digests, named]
            if redact:
                nulls = part.column(part.schema.get_field_index("text")).is_null().to_pylist()
                columns.append([None if z else t for z, t in zip(nulls, new, strict=True)])
            return columns

        return work

    fields = [*(T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())]
    return with_columns(docs, make, fields + [T.StructField("text", T.StringType())] * redact)
