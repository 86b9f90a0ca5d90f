"""Secrets in texts: fixed patterns, and tokens that a battery of randomness tests takes for encoded random bytes.

A token's alphabet is the smallest encoding that holds its characters. Against uniform draws from it stand chi-squared
(by coinciding characters), the runs above and below the alphabet's middle, and the serial correlation of neighbours; a token that one of
them rejects isn't random. What passes must also be unlike ordinary text, whose character counts and changes between letters and
digits come from all documents: its coincidences are too few and its changes too many, which gives a p-value for each
token. As many tokens are tested, and short ones prove little, the bar is set for each class of lengths
by Benjamini and Hochberg's rule over all tokens of that class.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from terrachron.llm.common import materialise, texts_in

# The patterns of the base, in the order in which kinds are listed, and the least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE, LEAST_ACCESS = 12, 18

#: A token to test: a whole run, or a stretch of letters and digits within it.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}")
STRETCH = re.compile(r"[A-Za-z0-9]{16,}")

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Encodings of bytes by size of alphabet; the first that holds a token's characters is taken. Decimal numbers are no such encoding.
ENCODINGS = (DIGITS + "abcdef", DIGITS + "ABCDEF", UPPER + "234567", DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_")
SYMBOLS = DIGITS + LOWER + UPPER + "+/-_"
#: Below this a token isn't random (the least of three p-values, times three).
NOT_RANDOM = 0.001
#: Share of ordinary tokens among those reported, and the classes of lengths within which it is held.
FALSE_DISCOVERIES = 0.01
LENGTH_CLASSES = (16, 20, 24, 32, 44, 64)
#: p-values are compared as tenths of their negative decimal logarithm, up to this many.
GRADES = 600

_symbol = np.full(256, -1, np.int16)
_symbol[np.frombuffer(SYMBOLS.encode(), np.uint8)] = np.arange(len(SYMBOLS))
_kind = np.full(256, -1, np.int8)
for _i, _chars in enumerate((DIGITS, LOWER, UPPER, "+/-_")):
    _kind[np.frombuffer(_chars.encode(), np.uint8)] = _i

CANDIDATE = "start int, end int, whole boolean, encoding int, coincidences long, changes int"
FIELDS = f"n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start int, kind int, end int>>, tokens array<struct<{CANDIDATE}>>, ordinary array<long>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches, by start and then by kind. Matches of a kind don't overlap; a match that is too short is used up."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE] if "=" in text or ":" in text else []
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def encoding_of(token: str) -> int:
    """The number of the smallest encoding that holds the token; -1 for none, and for decimal numbers."""
    chars = set(token)
    return -1 if chars <= set(DIGITS) else next((i for i, e in enumerate(ENCODINGS) if chars <= set(e)), -1)


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str, encoding: int) -> tuple[float, float, float]:
    """p-values of a token under uniform draws from its alphabet: chi-squared, runs, serial correlation."""
    alphabet = ENCODINGS[encoding]
    k, n = len(alphabet), len(token)
    rank = np.zeros(128, np.int64)
    rank[np.frombuffer(alphabet.encode(), np.uint8)] = np.arange(k)
    x = rank[np.frombuffer(token.encode(), np.uint8)]
    counts = np.bincount(x, minlength=k).astype(float)
    chi = ((counts - n / k) ** 2).sum() * k / n
    upper = x >= k // 2
    changes = int((upper[1:] != upper[:-1]).sum())
    centred = x - (k - 1) / 2
    serial = float((centred[1:] * centred[:-1]).sum()) / (math.sqrt(n - 1) * (k * k - 1) / 12)
    return (
        _two_sided((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n))),
        _two_sided((changes - (n - 1) / 2) / math.sqrt((n - 1) / 4)),
        _two_sided(serial),
    )


def _shape(data: np.ndarray) -> np.ndarray:
    """Of ASCII bytes: how often each symbol occurs, then the changes of kind between neighbouring symbols and the number of such neighbours."""
    of, kinds = _symbol[data], _kind[data]
    both = (kinds[1:] >= 0) & (kinds[:-1] >= 0)
    return np.r_[np.bincount(of[of >= 0], minlength=len(SYMBOLS)), (both & (kinds[1:] != kinds[:-1])).sum(), both.sum()].astype(np.int64)


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple], np.ndarray]:
    """Tokens clear of the base that the battery doesn't reject, and the shape of all whole runs of the text."""
    found, runs = [], np.zeros(len(SYMBOLS) + 2, np.int64)
    for m in TOKEN.finditer(text):
        run, at = m[0], m.start()
        runs += _shape(np.frombuffer(run.encode(), np.uint8))
        parts = [(at, m.end(), True)]
        if not run.isalnum():
            parts += [(at + s.start(), at + s.end(), False) for s in STRETCH.finditer(run)]
        for start, end, whole in parts:
            token = text[start:end]
            encoding = encoding_of(token)
            if encoding < 0 or any(s < end and start < e for s, _, e in base) or 3 * min(randomness(token, encoding)) < NOT_RANDOM:
                continue
            shape = _shape(np.frombuffer(token.encode(), np.uint8))
            counts = shape[: len(SYMBOLS)]
            found.append((start, end, whole, encoding, int((counts * (counts - 1) // 2).sum()), int(shape[-2])))
    return found, runs


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    token_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("whole", pa.bool_()), ("encoding", pa.int32()), ("coincidences", pa.int64()), ("changes", pa.int32())]))
    for batch in batches:
        for start, texts in texts_in(batch, "text"):
            bases, tokens, ordinary = [], [], np.zeros(len(SYMBOLS) + 2, np.int64)
            for text in texts:
                base, found = [], []
                if text:
                    base = base_spans(text)
                    found, runs = candidates(text, base)
                    ordinary += _shape(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)) - runs
                bases.append(base)
                tokens.append(found)
            counts = [[sum(k == kind for _, k, _ in b) for b in bases] for kind in range(3)]
            digests = [hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in b).encode()).hexdigest() for b in bases]
            columns = [pa.array(c, pa.int64()) for c in counts] + [pa.array(digests, pa.string())]
            columns.append(pa.array([[dict(zip(("start", "kind", "end"), x, strict=True)) for x in b] for b in bases], base_type))
            columns.append(pa.array([[dict(zip(("start", "end", "whole", "encoding", "coincidences", "changes"), x, strict=True)) for x in t] for t in tokens], token_type))
            columns.append(pa.array([ordinary.tolist()] + [None] * (len(texts) - 1), pa.list_(pa.int64())))
            own = batch.column(batch.schema.get_field_index("doc_id")).slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([own, *columns], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "tokens", "ordinary"])


def ordinary_moments(shape: list[int]) -> tuple[list[tuple[float, float]], float]:
    """Of ordinary text: for each encoding the chances that two, and three, characters coincide; how often neighbours change their kind."""
    counts = dict(zip(SYMBOLS, shape, strict=False))
    moments = []
    for alphabet in ENCODINGS:
        q = np.array([counts[c] for c in alphabet], float) + 1e-9
        q /= q.sum()
        moments.append((float((q**2).sum()), float((q**3).sum())))
    return moments, (shape[-2] + 1) / (shape[-1] + 2)


def ordinary_p(length: int, encoding: int, coincidences: int, changes: int, moments: list[tuple[float, float]], change: float) -> float:
    """How likely ordinary text of this length is to have so few coincidences and so many changes: Fisher's combination of both."""
    s2, s3 = moments[encoding]
    pairs, triples = length * (length - 1) / 2, length * (length - 1) * (length - 2) / 6
    spread = math.sqrt(max(pairs * (s2 - s2 * s2) + 6 * triples * max(s3 - s2 * s2, 0), 1e-9))
    few = max(math.erfc((pairs * s2 - coincidences - 0.5) / spread / math.sqrt(2)) / 2, 1e-300)
    rate, many = changes / (length - 1), 1.0
    if rate > change:
        inverse = 0.0 if rate >= 1 else (1 - rate) * math.log((1 - rate) / (1 - change))
        many = max(math.exp(-(length - 1) * (rate * math.log(rate / change) + inverse)), 1e-300)
    half = -(math.log(few) + math.log(many))
    return min(1.0, math.exp(-half) * (1 + half))


def length_class(length: int) -> int:
    return max(i for i, least in enumerate(LENGTH_CLASSES) if length >= least)


def bars(histogram: list[tuple[int, int, int]], rate: float = FALSE_DISCOVERIES) -> list[int]:
    """For each class of lengths the least grade that is reported, from (class, grade, tokens): Benjamini and Hochberg's rule over grades."""
    out = []
    for c in range(len(LENGTH_CLASSES)):
        n = np.zeros(GRADES + 1)
        for own, grade, count in histogram:
            if own == c:
                n[grade] += count
        above = np.cumsum(n[::-1])[::-1]
        good = [g for g in range(GRADES + 1) if above[g] and n.sum() * 10 ** (-g / 10) <= rate * above[g]]
        out.append(min(good, default=GRADES + 1))
    return out


def find_secrets(docs: DataFrame, rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of each row of docs (doc_id, text); spans are `kind:start:end` in code points.

    A null or empty text has no spans. Rows that repeat are reported each for itself. The bar for random tokens depends on
    all rows: where there is no ordinary text to compare with, only the fixed patterns are reported. An empty table gives an empty result.
    """
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(FIELDS).fields])
    scanned = materialise(docs.select("doc_id", "text").mapInArrow(_scan, schema))
    width = len(SYMBOLS) + 2
    totals = scanned.where("ordinary is not null").agg(*(F.sum(F.get("ordinary", F.lit(i))) for i in range(width))).first()
    moments, change = ordinary_moments([x or 0 for x in totals])

    def grade(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = batch.column("tokens").to_pylist(), []
            for tokens in of:
                p = [ordinary_p(t["end"] - t["start"], t["encoding"], t["coincidences"], t["changes"], moments, change) for t in tokens]
                found.append([{"start": t["start"], "end": t["end"], "whole": t["whole"], "class": length_class(t["end"] - t["start"]), "grade": min(GRADES, int(-10 * math.log10(max(x, 1e-300))))} for t, x in zip(tokens, p, strict=True)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("whole", pa.bool_()), ("class", pa.int32()), ("grade", pa.int32())]))
            keep = [n for n in batch.schema.names if n != "tokens"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(found, kind)], [*keep, "graded"])

    columns = [f for f in scanned.schema.fields if f.name not in ("tokens", "ordinary")]
    schema = T.StructType([*columns, *T._parse_datatype_string("graded array<struct<start int, end int, whole boolean, class int, grade int>>").fields])
    graded = scanned.select(*(f.name for f in columns), "tokens").mapInArrow(grade, schema)
    tokens = graded.select(F.explode("graded").alias("t")).groupBy(F.col("t.class").alias("c"), F.col("t.grade").alias("g")).count()
    bar = F.array(*(F.lit(b) for b in bars([tuple(r) for r in tokens.collect()], rate)))  # classes times grades at most
    passed = F.filter("graded", lambda t: t["grade"] >= F.get(bar, t["class"]))
    wholes = F.filter(passed, lambda t: t["whole"])
    alone = F.filter(passed, lambda t: t["whole"] | ~F.exists(wholes, lambda w: (w["start"] <= t["start"]) & (t["end"] <= w["end"])))
    added = F.transform(alone, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    names = F.array(*(F.lit(k) for k in KINDS))
    every = F.transform(F.array_sort(F.concat("base", added)), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]))
    return graded.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(every, ",").alias("spans"))
