"""Fuzzy line deduplication: pigeonhole blocks of normalised lines, a join on them, edit similarity, components.

Lines are normalised (A-Z lower-cased, digits to 0, other ASCII to single spaces). Equal normalised lines are one
node. A line's words are dealt by their place into four blocks, each with a 32-bit fingerprint. Lines of equally many
words whose differences lie in two blocks have, by the pigeonhole principle, the two others in common: each two blocks
are a key. Lines of up to SHORT words are keyed without each one word instead. A word more or less moves all blocks
behind it, so the first and the last half are keys whatever the number of words. A key holds half of a line or more,
so a phrase that many lines share makes no bucket.

Candidates within exact bounds of length and letter counts are confirmed by their edit similarity. Of a connected group
of lines the occurrence in the document with the least doc_id, and there the first, stays.

Votes of words in one 64-bit SimHash aren't used for the blocks: one word of ten flips 8 bits of 64 on average, so
blocks of bits that are selective enough to join on lose nearly all near copies of ordinary lines (see the README).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrachron.llm.buckets import linked_components
from terrachron.llm.common import document_key, materialise, mix, small_side, texts_in, with_text

#: Digits to 0, A-Z to a-z, other ASCII to a space, but line feeds stay.
NORMAL = bytes(48 if 0x30 <= b < 0x3A else b + 32 if 0x41 <= b < 0x5B else b if b >= 0x80 or 0x61 <= b < 0x7B or b == 10 else 32 for b in range(256))
#: Words are hashed in blocks of so many bytes, texts are taken together up to so many.
BLOCK = 1 << 18
#: A random word for each byte, an odd base and its inverse: a word's hash is a polynomial of its bytes, mixed.
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
BASE = 0x9E3779B97F4A7C15
#: Blocks of a line; the most words of a line that is keyed word by word; and the least words of a half that is a key.
BLOCKS, SHORT, HALF = 4, 7, 3
#: Members of a crowded key in a tile; each two tiles are compared in one task.
TILE = 128
#: Letters to 16 classes, whose counts bound the edit distance; 16 isn't counted.
CLASSES = np.full(256, 16, np.int8)
for _i, _c in enumerate(b"etaoinshrdlucmfwypvbgkjqxz0"):
    CLASSES[_c] = _i if _i < 12 else 12 + _i % 4


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, base ** 1, ... modulo 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BASE, BLOCK), _powers(pow(BASE, -1, 1 << 64), BLOCK)


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and 64-bit hashes of the words in normalised bytes. A word longer than BLOCK is summed piece by piece."""
    powers, inverse = _tables()
    letter = np.concatenate([[False], data > 32, [False]])
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    hashes = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        if ends[at] - low > BLOCK:
            pieces = [data[k : min(k + BLOCK, int(ends[at]))] for k in range(int(low), int(ends[at]), BLOCK)]
            total = sum(int((BYTES[p] * powers[: len(p)]).sum()) * pow(BASE, i * BLOCK, 1 << 64) for i, p in enumerate(pieces))
            hashes[at] = total % (1 << 64)
            at += 1
            continue
        last = max(at + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
        high = min(int(ends[last - 1]), int(low) + BLOCK)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTES[data[low:high]] * powers[: high - low], out=sums[1:])
        a, b = starts[at:last] - low, np.minimum(ends[at:last], high) - low
        hashes[at:last] = (sums[b] - sums[a]) * inverse[a]
        at = last
    return starts, mix(hashes + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def _features(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """What line_features returns, and the normalised bytes and where in them words start."""
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    data = np.frombuffer(b"\n".join(texts).translate(NORMAL), np.uint8)
    starts, hashes = _word_hashes(data)
    line = np.searchsorted(np.flatnonzero(data == 10), starts)
    n = np.bincount(line, minlength=int(lines.sum()))
    first = np.cumsum(n) - n
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        place = np.arange(len(line)) - first[line]
        out[some] = np.add.reduceat(mix(hashes, 99) * _powers(BASE, int(n.max()))[place], first[some])
    return n, mix(out).view(np.int64), hashes, line, lines, data, starts


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all lines of the texts, one after the other: words, hash; and of all words: hash, line; and the number of lines of each text."""
    return _features(texts)[:5]


def _bounds(data: np.ndarray, starts: np.ndarray, line: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters of each line, its words joined by one space; letter counts of each line, 16 bytes that stop at 255."""
    if not len(starts):
        return np.zeros(len(n), np.int64), np.zeros((len(n), 2), np.int64)
    size = np.add.reduceat((data > 32) & (data & 0xC0 != 0x80), starts, dtype=np.int32)
    length = np.bincount(line, size, len(n)).astype(np.int64) + np.maximum(n - 1, 0)
    # Seventeen counters for each line; the last one takes what isn't counted.
    counter = np.cumsum(data == 10, dtype=np.int64)
    counter *= 17
    counter += CLASSES[data]
    counts = np.bincount(counter, minlength=17 * len(n)).reshape(-1, 17)[:, :16]
    return length, np.ascontiguousarray(np.minimum(counts, 255).astype(np.uint8)).view("<i8")


def _sums(values: np.ndarray) -> np.ndarray:
    """0 and the running sums, modulo 2 ** 64."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=out[1:])
    return out


def line_blocks(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many blocks each line has, their fingerprints; the keys of halves, and the line of each of these."""
    words = mix(hashes, 7)
    first = np.cumsum(n) - n
    place = np.arange(len(words)) - np.repeat(first, n)
    powers = _powers(BASE, max(1, int(n.max(initial=0))))
    sums = _sums(words * powers[place])
    parts = np.where(n <= SHORT, n, BLOCKS)
    j = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    at, size, of = np.repeat(first, parts), np.repeat(n, parts), np.repeat(parts, parts)
    blocks = mix(sums[at + size * (j + 1) // of] - sums[at + size * j // of] + j.astype(np.uint64), 11) >> np.uint64(32)
    # Halves of h words: lines of n and n + 1 words have one h in common.
    back = _sums(words * powers[np.repeat(n, n) - 1 - place])
    keys, owners = [], []
    for half, use in ((n // 2, n // 2 >= HALF), ((n - 1) // 2, (n % 2 == 0) & ((n - 1) // 2 >= HALF))):
        of = np.flatnonzero(use)
        h, a, b = half[of], first[of], (first + n)[of]
        keys += [mix(sums[a + h] - sums[a] + h.astype(np.uint64), 21), mix(back[b] - back[b - h] + h.astype(np.uint64), 22)]
        owners += [of, of]
    keys, owners = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return parts, blocks.astype(np.uint32).view(np.int32), keys[order].view(np.int64), owners[order]


def keys_of(n: Column, blocks: Column, halves: Column) -> Column:
    """The keys of a line: of up to SHORT words all but each one; of more, one block of either half; and the halves. None with fewer than three words."""

    def each(kept: list[tuple[int, ...]]) -> Column:
        return F.array(*(F.xxhash64(F.lit(i), n, *(blocks[j] for j in some)) for i, some in enumerate(kept)))

    own = F.when(n > SHORT, each([(0, 2), (0, 3), (1, 2), (1, 3)]))
    for k in range(3, SHORT + 1):
        own = own.when(n == k, each(list(itertools.combinations(range(k), k - 1))))
    return F.concat(F.coalesce(own, F.array().cast("array<long>")), halves)


def _list_of(sizes: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))


def _together(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of BLOCK bytes at most together (or one longer text): (first, texts as bytes)."""
    first, now, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if now and size + len(data) > BLOCK:
            yield first, now
            first, now, size = i, [], 0
        now.append(data)
        size += len(data) + 1
    if now:
        yield first, now


def _common(a: str, b: str) -> int:
    """Characters that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return low


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """What is left without a common beginning and end: as far apart as before."""
    start = _common(a, b)
    end = _common(a[start:][::-1], b[start:][::-1])
    return a[start : len(a) - end], b[start : len(b) - end]


def _table(a: str, b: str, most: float, since: int) -> tuple[int, float]:
    """The distance of a and b, and the least one of a and of what b begins with, from `since` characters on. Bit-parallel: one column of the table is two integers."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, least = full, 0, len(a), float("inf")
    for left_over, c in zip(range(len(b), 0, -1), b):
        # A column more lowers the distance by one at most.
        if score - left_over > most:
            return score - left_over, min(least, score - left_over)
        eq = at.get(c, 0)
        flat = (((eq & up) + up) ^ up) | eq | down
        right, left = down | ~(flat | up) & full, up & flat
        score += bool(right & top) - bool(left & top)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = left | ~(flat | right) & full, right & flat
        if score < least and len(b) - left_over + 1 >= since:
            least = score
    return score, least


def edit_distance(a: str, b: str, most: float = float("inf")) -> int:
    """Levenshtein distance. Some number above `most` where it is more than that."""
    a, b = _trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    # Within `most` edits the first characters of a are as near to as many of b, give or take `most`: those of other texts are not.
    if 4 * most + 16 < min(len(a), len(b)):
        k = int(most)
        head = 2 * k + 16
        least = _table(a[:head], b[: head + k], float("inf"), head - k)[1]
        if least > most:
            return least
    return _table(a, b, most, len(b))[0]


def _ascii(text: str) -> np.ndarray:
    return np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)[:128]


def _triples(text: str) -> np.ndarray:
    """How often each class of three characters in a row occurs."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(x) < 3:
        return np.zeros(4096, np.int64)
    return np.bincount((x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(20), minlength=4096)


def similar(a: str, b: str, share: float) -> bool:
    """Whether an edit distance leaves `share` of the longer text.

    An edit adds one character at most and removes one, and three runs of three characters at most, so the counts of either bound it from below.
    """
    longest = max(len(a), len(b))
    most = (1 - share) * longest
    if longest - min(len(a), len(b)) > most:
        return False
    a, b = _trimmed(a, b)
    if max(len(a), len(b)) <= most:
        return True
    for counts, each in ((_ascii, 1), (_triples, 3)):
        more = counts(a) - counts(b)
        if max(int(more[more > 0].sum()), -int(more[more < 0].sum())) > each * most:
            return False
    return edit_distance(a, b, most) <= most


LINES = "doc long, th long, h long, n int, size long, c0 long, c1 long, blocks array<int>, halves array<long>"


def _lines(min_words: int):
    """Rows (doc, th, text) to LINES: each long enough line of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)]
            for start, texts in texts_in(batch, "text", 512):
                for first, group in _together(texts):
                    n, h, words, line, lines, data, starts = _features(group)
                    owner = np.repeat(np.arange(start + first, start + first + len(group)), lines)
                    length, counts = _bounds(data, starts, line, n)
                    long_enough = n >= min_words
                    use = np.flatnonzero(long_enough)
                    parts, blocks, halves, of = line_blocks(words, n)
                    blocks = _list_of(parts[use], blocks[np.repeat(long_enough, parts)])
                    halves = _list_of(np.bincount(of, minlength=len(n))[use], halves[long_enough[of]])
                    columns = [*(pa.array(x[owner[use]], pa.int64()) for x in ids), pa.array(h[use]), pa.array(n[use], pa.int32()), pa.array(length[use]), *(pa.array(np.ascontiguousarray(counts[use, i])) for i in (0, 1)), blocks, halves]
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in LINES.split(", ")])

    return run


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, hashes) to (h, line): the normalised lines asked for."""
    for batch in batches:
        out: dict[int, str] = {}
        asked = batch.column(1).to_pylist()
        for first, group in _together(batch.column(0).to_pylist()):
            # Hashes of a run of texts are made at once.
            _, h, _, _, lines = line_features(group)
            h, at = h.tolist(), 0
            for i, (data, size) in enumerate(zip(group, lines.tolist()), first):
                wanted = set(asked[i])
                found = [k for k in range(size) if h[at + k] in wanted]
                if found:
                    of = data.split(b"\n")
                    out.update((h[at + k], b" ".join(of[k].translate(NORMAL).split()).decode("utf-8", "surrogatepass")) for k in found)
                at += size
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.string())], names=["h", "line"])


def _met(share: float):
    """Two tiles of a key's members (key, id, c, size, c0, c1, line, tile) to the links (a, b) that join their components c: who is joined already isn't compared.

    The bounds of `similar` are taken for a member and all others at once.
    """

    def differs(counts: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
        # The larger one of what is added and what is removed.
        apart = counts[j] - counts[i]
        return (np.abs(apart).sum(axis=1) + np.abs(apart.sum(axis=1))) / 2

    def run(key: tuple, group: pa.Table) -> pa.Table:
        ids, c, size, tile = (group.column(n).to_numpy() for n in ("id", "c", "size", "tile"))
        counts = np.stack([group.column(n).to_numpy() for n in ("c0", "c1")], axis=1).astype("<i8").view(np.uint8).astype(np.int16)
        lines, root = group.column("line").to_pylist(), np.unique(c, return_inverse=True)[1]
        one, other = key[1].as_py(), key[2].as_py()
        right = np.flatnonzero(tile == other)
        letters, triples = (np.array([f(x) for x in lines], np.int32) for f in (_ascii, _triples))
        links = []
        for i in np.flatnonzero(tile == one):
            j = right[right > i] if one == other else right
            most = np.maximum(size[i], size[j]) * (1 - share) + 1e-6
            apart = counts[i] - counts[j]
            fits = (np.abs(size[i] - size[j]) <= most) & (np.maximum(apart, 0).sum(axis=1) <= most) & (np.maximum(-apart, 0).sum(axis=1) <= most)
            fits &= root[j] != root[i]
            for counts_of, each in ((letters, 1), (triples, 3)):
                j, most = j[fits], most[fits]
                fits = differs(counts_of, i, j) <= each * most
            for k in j[fits].tolist():
                least = (1 - share) * max(len(lines[i]), len(lines[k]))
                if root[i] != root[k] and edit_distance(lines[i], lines[k], least) <= least:
                    root[root == root[k]] = root[i]
                    links.append((i, k))
        at = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": ids[at].min(axis=1), "b": ids[at].max(axis=1)})

    return run


def _compare(share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(x, y, share) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _rewrite(min_words: int):
    """A text and the groups of its lines to the text without the lines that stand elsewhere or above (null if it stays), its lines and those removed."""

    def kept_lines(n: list[int], h: list[int], group: dict[int, tuple[int, bool]]) -> list[int]:
        seen, kept = set(), []
        for i, (words, x) in enumerate(zip(n, h)):
            if words >= min_words:
                of, gone = group.get(x, (x, False))
                if gone or of in seen:
                    continue
                seen.add(of)
            kept.append(i)
        return kept

    def run(every: pa.Array, every_groups: pa.Array) -> pa.Array:
        out, total, removed = [], [], []
        for start in range(0, len(every), 512):
            rows, groups = every.slice(start, 512), every_groups.slice(start, 512)
            ends = np.cumsum(groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
            known = [groups.flatten().field(c).to_pylist() for c in ("h", "group", "gone")]
            sizes = pc.add(pc.count_substring(rows, "\n"), 1).fill_null(0).to_pylist()
            # A text without groups has no line that occurs twice, here or elsewhere.
            some = [i for i, (a, b) in enumerate(zip([0, *ends], ends)) if b > a and rows[i].is_valid]
            texts = rows.take(pa.array(some, pa.int64())).to_pylist()
            left: dict[int, tuple[str, int]] = {}
            for first, data in _together(texts):
                n, h, _, _, lines = line_features(data)
                n, h, at = n.tolist(), h.tolist(), 0
                for k, size in enumerate(lines.tolist(), first):
                    i = some[k]
                    a, b = ends[i - 1] if i else 0, ends[i]
                    kept = kept_lines(n[at : at + size], h[at : at + size], dict(zip(known[0][a:b], zip(known[1][a:b], known[2][a:b]))))
                    if len(kept) < size:
                        of = texts[k].split("\n")
                        left[i] = "\n".join([of[j] for j in kept]), size - len(kept)
                    at += size
            for i, size in enumerate(sizes):
                text, gone = left.get(i, (None, 0))
                out.append(text)
                total.append(size)
                removed.append(gone)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["left", "lines", "removed"])

    return run


def remove_lines(docs: DataFrame, min_words: int = 3, share: float = 0.9) -> DataFrame:
    """docs with _tc_left (the text that is left), _tc_lines and _tc_removed.

    Lines end at line feeds. Lines of fewer than `min_words` normalised words always stay. A null text stays null, an
    empty one empty. Rows with one doc_id are one document: a line that they share stays in each. A row without doc_id
    is a document by its text, as `document_key` says. An empty table gives no rows.
    """
    doc, th = document_key(F.col("doc_id"), F.col("text"))
    lines = materialise(docs.select(doc.alias("doc"), th.alias("th"), "text").mapInArrow(_lines(min_words), LINES))
    # A line is read again from one text of the least document that has it.
    nodes = materialise(lines.groupBy("h").agg(*(F.min(c).alias(c) for c in ("size", "c0", "c1")), F.min("doc").alias("d0"), F.min_by("th", "doc").alias("t0"), F.count("*").alias("n")))
    keys = lines.select(F.explode(keys_of(F.col("n"), F.col("blocks"), F.col("halves"))).alias("key"), F.col("h").alias("id"))

    candidates: list[DataFrame] = []

    def facts_of(ids: DataFrame) -> DataFrame:
        # What shares a key is looked up among all lines once, and its lines are read again once.
        facts = materialise(nodes.select(F.col("h").alias("id"), "size", "c0", "c1", "d0", "t0").join(ids, "id", "left_semi"))
        # The list of a text has that text's own lines.
        asked = facts.groupBy("d0", "t0").agg(F.collect_list("id").alias("wanted"))
        found = docs.select(doc.alias("d0"), th.alias("t0"), "text").join(small_side(asked), ["d0", "t0"]).select("text", "wanted").mapInArrow(_wanted, "h long, line string")
        candidates.append(materialise(found.dropDuplicates(["h"])))
        return facts.select("id", "size", "c0", "c1")

    def near(a: str, b: str) -> Column:
        # An edit changes the length by one at most, and adds one letter at most and removes one.
        most = F.greatest(f"size{a}", f"size{b}") * (1 - share) + 1e-6
        count = lambda c, i: F.shiftrightunsigned(c, 8 * i).bitwiseAND(F.lit(255))
        apart = [count(F.col(f"{c}{a}"), i) - count(F.col(f"{c}{b}"), i) for c in ("c0", "c1") for i in range(8)]
        zero = F.lit(0).cast("long")
        added, removed = (reduce(lambda x, y: x + y, (F.greatest(zero, sign * d) for d in apart)) for sign in (1, -1))
        return (F.abs(F.col(f"size{a}") - F.col(f"size{b}")) <= most) & (added <= most) & (removed <= most)

    def meet(crowded: DataFrame) -> DataFrame:
        # Each two tiles of a key meet in one task, to which a member's line goes once, not once for each pair.
        tiles = crowded.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
        rows = crowded.join(tiles, "key").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
        rows = rows.join(candidates[0].select(F.col("h").alias("id"), "line"), "id").withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        rows = rows.select("key", F.least("tile", "_t").alias("one"), F.greatest("tile", "_t").alias("other"), "id", "c", "size", "c0", "c1", "line", "tile")
        # Few bytes are long to compare: they go to all tasks.
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(tasks, "key", "one", "other").groupBy("key", "one", "other").applyInArrow(_met(share), "a long, b long")

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = (candidates[0].select(F.col("h").alias(s), F.col("line").alias(f"x{s}")) for s in "ab")
        # Pairs are small and their comparison is long: they go to all tasks, also those of one line.
        tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        both = pairs.join(x, "a").join(y, "b").select("a", "b", "xa", "xb").repartition(tasks, "a", "b")
        return both.mapInArrow(_compare(share), "a long, b long")

    found = linked_components(keys, facts_of, near, confirm, rounds=6, meet=meet)
    named = nodes.join(found, F.col("h") == F.col("node"), "left").select("h", "d0", "n", F.coalesce("component", "h").alias("group"))
    fuzzy = found.select(F.col("component").alias("group")).distinct().withColumn("fuzzy", F.lit(True))
    named = named.join(fuzzy, "group", "left").where("n > 1 or fuzzy")
    least = named.where("fuzzy").groupBy("group").agg(F.min("d0").alias("g0"))
    named = named.join(least, "group", "left").select("h", "group", F.coalesce("g0", "d0").alias("stays"))
    per_text = lines.select("doc", "th", "h").join(named, "h").select(F.col("doc").alias("_tc_doc"), F.col("th").alias("_tc_th"), F.struct("h", "group", (F.col("doc") != F.col("stays")).alias("gone")).alias("g"))
    # Rows with one text have its lines several times: they are gathered once.
    per_text = per_text.groupBy("_tc_doc", "_tc_th").agg(F.collect_set("g").alias("_tc_groups"))
    rows = docs.withColumns({"_tc_doc": doc, "_tc_th": th}).join(per_text, ["_tc_doc", "_tc_th"], "left")
    rewritten = F.arrow_udf(_rewrite(min_words), T.StructType.fromDDL("left string, lines long, removed long")).asNondeterministic()
    out = rows.withColumn("_tc_new", rewritten("text", "_tc_groups"))
    found = {"_tc_left": F.coalesce("_tc_new.left", "text"), "_tc_lines": F.col("_tc_new.lines"), "_tc_removed": F.col("_tc_new.removed")}
    return out.withColumns(found).drop("_tc_doc", "_tc_th", "_tc_groups", "_tc_new")


def line_report(docs: DataFrame, min_words: int = 3, share: float = 0.9) -> DataFrame:
    """One row for each row of docs: doc_id, n_lines, n_removed, n_chars and text_crc32 of what is left."""
    found = remove_lines(docs.select("doc_id", "text"), min_words, share)
    return found.select(
        "doc_id", F.col("_tc_lines").alias("n_lines"), F.col("_tc_removed").alias("n_removed"),
        F.length("_tc_left").cast("long").alias("n_chars"), F.crc32("_tc_left").alias("text_crc32"),
    )


def without_repeated_lines(docs: DataFrame, min_words: int = 3, share: float = 0.9) -> DataFrame:
    """docs with repeated lines cut out of the text. A document that lost lines and has only white space left goes.

    Null and empty texts lose nothing and stay; what counts as one document is said at `remove_lines`. All columns
    stay; n_chars follows the text where it changes. An empty table gives no rows.
    """
    found = remove_lines(docs, min_words, share)
    left = (F.col("_tc_removed") == 0) | (F.trim(F.regexp_replace("_tc_left", "\\s+", " ")) != "")
    return with_text(found.where(left), F.col("_tc_left")).drop("_tc_left", "_tc_lines", "_tc_removed")
