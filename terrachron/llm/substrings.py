"""Substring deduplication by content-defined chunking with a gear rolling hash.

A text is cut behind white space where the gear hash of the bytes before is below a threshold, so cuts depend on the
content nearby alone and fall in the same places of a passage wherever it stands. In scripts without white space, where
none lies within DENSE bytes before, the cut is between characters, by the same hash. Chunks are compared by digest over
the whole corpus; every occurrence but the first (by doc_id, then position) is a repeat. A run of repeated chunks is
removed if it has at least `min_words` words or `min_bytes` bytes; shorter ones are ordinary language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from terrachron.llm.common import document_key, materialise, mix, texts_in, with_text

#: The gear table: a random 32-bit word for each byte.
GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A chunk has this many bytes at most (then it is cut anywhere between characters) and so many at least.
MOST, LEAST = 1024, 16
#: Behind so many bytes without white space a text is cut between characters, behind one of DENSE_CHUNK on average.
DENSE, DENSE_CHUNK = 64, 16
#: A run of so many bytes is long enough, however few words it has.
RUN_BYTES = 192


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash h = (h << 1) + GEAR[byte] at each byte; in 32 bits it depends on the last 32 bytes."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):  # sums over 2, 4, ... 32 bytes
        h[step:] += h[:-step] << np.uint32(step)
    return h


def cuts(data: bytes, words: int) -> list[int]:
    """The ends of the chunks, the last at len(data). On average `words` words lie between two cuts."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return []
    space = SPACE[raw]
    after = space.copy()
    after[:-1] &= ~space[1:]  # behind the last of several white bytes
    hashes = gear_hashes(raw)
    found = np.flatnonzero(after & (hashes < np.uint32(0xFFFFFFFF // words))) + 1
    # How long ago the last white byte was; the start of the text counts as none, so cuts don't depend on it.
    place = np.arange(len(raw))
    since = place - np.maximum.accumulate(np.where(space, place, -1))
    dense = (since >= DENSE) & (hashes < np.uint32(0xFFFFFFFF // DENSE_CHUNK))
    if dense.any():
        ends = np.append(raw[1:] & 0xC0 != 0x80, True)  # the last byte of a character
        found = np.union1d(found, np.flatnonzero(dense & ends) + 1)
    out, last = [], 0
    for end in [*found.tolist(), len(data)]:
        if end - last < LEAST and end < len(data):
            continue
        while end - last > MOST:
            at = last + MOST
            while at > last + 1 and data[at] & 0xC0 == 0x80:
                at -= 1
            out.append(at)
            last = at
        if end > last:
            out.append(end)
            last = end
    return out


def _digests(data: bytes, ends: list[int]) -> list[int]:
    """A signed 64-bit digest of each chunk."""
    out = [xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip([0, *ends], ends)]
    return np.array(out, np.uint64).view(np.int64).tolist()


def _chunks(words: int):
    """Rows (doc, th, text) to a row (digest, doc, th) for each distinct chunk of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for first, texts in texts_in(batch, "text", 512):
                found = []
                for text in texts:
                    data = (text or "").encode("utf-8", "surrogatepass")
                    found.append(list(set(_digests(data, cuts(data, words)))))
                sizes = [len(f) for f in found]
                owners = [pa.array(np.repeat(x[first : first + len(found)], sizes), pa.int64()) for x in ids]
                yield pa.RecordBatch.from_arrays([pa.array([d for f in found for d in f], pa.int64()), *owners], names=["digest", "doc", "th"])

    return run


def _rewrite(words: int, min_words: int, min_bytes: int):
    """A text and its digests that stand in an earlier document to the text without long runs of repeats (null if it stays), and the runs."""

    def repeats(data: bytes, earlier: list[int] | None) -> list[list[int]]:
        ends = cuts(data, words)
        seen, runs = set(earlier or ()), []
        for a, b, d in zip([0, *ends], ends, _digests(data, ends)):
            if d in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(d)
        return [r for r in runs if r[1] - r[0] >= min_bytes or len(data[r[0] : r[1]].split()) >= min_words]

    def run(every: pa.Array, every_earlier: pa.Array) -> pa.Array:
        left, spans, sizes, removed = [], [], [], []
        for start in range(0, len(every), 256):
            for text, earlier in zip(every.slice(start, 256).to_pylist(), every_earlier.slice(start, 256).to_pylist()):
                data = (text or "").encode("utf-8", "surrogatepass")
                runs = repeats(data, earlier)
                bounds = [0, *(x for r in runs for x in r), len(data)]
                left.append(b"".join(data[a:b] for a, b in zip(bounds[::2], bounds[1::2])).decode("utf-8", "surrogatepass") if runs else None)
                spans.append([x for r in runs for x in r])
                sizes.append(len(data))
                removed.append(sum(b - a for a, b in runs))
        return pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(spans, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=["left", "spans", "bytes", "removed"])

    return run


def remove_repeats(docs: DataFrame, min_words: int = 16, words: int = 4, min_bytes: int = RUN_BYTES) -> DataFrame:
    """docs with _tc_left (the text that is left), _tc_spans (removed bytes: from, to, from, ...), _tc_bytes and _tc_removed.

    `words`: so many words lie between two possible cuts on average. A null text stays null, an empty one empty. Rows
    with one doc_id are one document: what they have in common is kept. A row without doc_id is a document by its text,
    as `document_key` says. An empty table gives no rows.
    Digests have 64 bits; a run needs several equal digests in a row, so a chance collision removes nothing.
    """
    doc, th = document_key(F.col("doc_id"), F.col("text"))
    chunks = materialise(docs.select(doc.alias("doc"), th.alias("th"), "text").mapInArrow(_chunks(words), "digest long, doc long, th long"))
    shared = chunks.groupBy("digest").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 <> d1")
    # The list of a text has that text's own digests.
    earlier = chunks.join(shared.select("digest", "d0").hint("merge"), "digest").where("doc <> d0").groupBy(F.col("doc").alias("_tc_doc"), F.col("th").alias("_tc_th")).agg(F.collect_set("digest").alias("_tc_earlier"))
    rows = docs.withColumns({"_tc_doc": doc, "_tc_th": th}).join(earlier, ["_tc_doc", "_tc_th"], "left")
    rewritten = F.arrow_udf(_rewrite(words, min_words, min_bytes), T.StructType.fromDDL("left string, spans array<long>, bytes long, removed long")).asNondeterministic()
    out = rows.withColumn("_tc_new", rewritten("text", "_tc_earlier"))
    found = {"_tc_left": F.coalesce("_tc_new.left", "text"), **{f"_tc_{c}": F.col(f"_tc_new.{c}") for c in ("spans", "bytes", "removed")}}
    return out.withColumns(found).drop("_tc_doc", "_tc_th", "_tc_earlier", "_tc_new")


def without_repeats(docs: DataFrame, min_words: int = 16, words: int = 4) -> DataFrame:
    """docs with repeated passages cut out of the text; all rows and columns stay, n_chars follows the text where it changes.

    Null and empty texts stay as they are; what counts as one document is said at `remove_repeats`. An empty table
    gives no rows.
    """
    return with_text(remove_repeats(docs, min_words, words), F.col("_tc_left")).drop("_tc_left", "_tc_spans", "_tc_bytes", "_tc_removed")


def repeat_report(docs: DataFrame, min_words: int = 16, words: int = 4) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, spans (from, to, ...), text_crc32 of what is left, changed."""
    found = remove_repeats(docs.select("doc_id", "text"), min_words, words)
    return found.select(
        "doc_id", F.col("_tc_bytes").alias("n_bytes"), F.col("_tc_removed").alias("n_removed"),
        F.col("_tc_spans").alias("spans"), F.crc32("_tc_left").alias("text_crc32"), (F.col("_tc_removed") > 0).alias("changed"),
    )
