"""Spelling variants: pairs of words at distance one, by a self-join of tries that are cut at prefixes.

Two words that differ by one character share all that stands before it and all behind. So each word is written as
(what is shared, a window that holds the change), once with the change in its first half and once in its last: words
that meet share the first part as a prefix, and the windows of those words form a trie below that prefix. A prefix with too many
words below it is cut again, by halving its windows, until few are left or a window is one character; nothing is dropped.

Inside a task the tries of many prefixes are walked at once, level by level: the active set holds the pairs of nodes
whose paths are at distance one, begins wherever two paths part, and goes on only along equal characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm.common import ascii_lower, materialise, small_side

LETTERS = "A-Za-zÀ-ÿ"
#: A run loses a character if its checksum is a multiple of this.
NOISE = 199
#: Words below one prefix that a task takes at once; prefixes with more are cut again.
GROUP_WORDS = 4_096
#: Bits of a code point in a node's key.
BITS = np.int64(21)
MASK = np.int64((1 << 21) - 1)

GROUP = ["l", "lo", "hi", "shared"]
ENTRY = "key long, l int, lo int, hi int, shared string, extra int, middle string, n long"
FOUND = "word string, n_near long, best_n long, best string"


def word_counts(docs: DataFrame, min_chars: int = 6, min_count: int = 5) -> DataFrame:
    """(word, n): letter runs of at least min_chars code points and min_count occurrences, A-Z lower-cased.

    A run whose checksum with its doc_id is a multiple of NOISE loses one code point. A null text has no runs, a null
    doc_id counts as an empty string. Rows that repeat count each time.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", ascii_lower(F.col("run")).alias("run"))
    sum_ = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    runs = runs.select("run", sum_.alias("h")).withColumn("at", F.pmod(F.col("h"), F.length("run")).cast("int"))
    cut = F.concat(F.col("run").substr(F.lit(1), F.col("at")), F.col("run").substr(F.col("at") + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % NOISE == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= min_chars)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _cut(words: DataFrame, windows: Column) -> DataFrame:
    """An entry for each window (lo, hi) of words (word, n, l, extra): what the change leaves alone, and the window itself."""
    e = words.select("word", "n", "l", "extra", F.explode(windows).alias("w")).select("*", "w.lo", "w.hi")
    behind = F.col("word").substr(F.col("hi") + F.col("extra") + 1, F.length("word"))
    shared = F.concat(F.col("word").substr(F.lit(1), F.col("lo")), behind)
    middle = F.col("word").substr(F.col("lo") + 1, F.col("hi") - F.col("lo") + F.col("extra"))
    e = e.select("l", "lo", "hi", shared.alias("shared"), "extra", middle.alias("middle"), "n")
    return e.select(F.xxhash64(*GROUP).alias("key"), *GROUP, "extra", "middle", "n")


def _halves(lo: Column, hi: Column) -> Column:
    """The two halves of a window, as (lo, hi); a window of one position stays whole."""
    mid = F.floor((lo + hi) / 2).cast("int")
    pair = F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))
    return F.filter(pair, lambda w: w["hi"] > w["lo"])


def prefix_entries(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """Entries (key, l, lo, hi, shared, extra, middle, n) of distinct words (word, n) without empty ones.

    A word of l characters meets those of l and, as the longer one of a pair (extra = 1), those of l - 1. (l, lo, hi, shared) is the
    group: the change lies at one of the positions lo to hi - 1 of the shorter word (or at its end, where hi = l).
    Groups of more than `limit` entries are split by halving their windows, in rounds, until windows hold one position.
    """
    size = F.length("word")
    sides = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra")).select("*", (size - F.col("extra")).alias("l")).where("l > 0")
    entries = _cut(sides, _halves(F.lit(0), F.col("l")))
    while True:
        hot = materialise(entries.where("hi - lo > 1").groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"))
        if not hot.take(1):
            return entries
        hot = small_side(hot)
        # Only windows of several positions can be cut; one that shares a hash with a hot group by chance is cut as well.
        wide = F.col("hi") - F.col("lo") > 1
        marked = entries.join(hot.withColumn("hot", F.lit(True)), "key", "left")
        word = F.concat(F.col("shared").substr(F.lit(1), F.col("lo")), F.col("middle"), F.col("shared").substr(F.col("lo") + 1, F.length("shared")))
        again = marked.where(F.col("hot") & wide).select(word.alias("word"), "n", "l", "extra", "lo", "hi")
        halved = _cut(again, _halves(F.col("lo"), F.col("hi")))
        entries = materialise(marked.where(F.col("hot").isNull() | ~wide).drop("hot").unionByName(halved))


def _levels(groups: np.ndarray, code: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tries of many groups at once: of each depth from 1, the sorted keys (parent, character) of its nodes, and the word that ends there (-1: none)."""
    node, left, found = groups.astype(np.int64), np.arange(len(groups)), []
    for depth in range(int(lengths.max(initial=0))):
        left = left[lengths[left] > depth]
        keys, at = np.unique(node[left] << BITS | code[offsets[left] + depth], return_inverse=True)
        node[left] = at
        ends = np.full(len(keys), -1)
        done = left[lengths[left] == depth + 1]
        ends[node[done]] = done
        found.append((keys, ends))
    return found


def _children(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All children of nodes: (which of the nodes, the child)."""
    first = np.searchsorted(keys, nodes << BITS)
    n = np.searchsorted(keys, (nodes + 1) << BITS) - first
    which = np.repeat(np.arange(len(nodes)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n - first, n)


def _child(keys: np.ndarray, nodes: np.ndarray, char: np.ndarray) -> np.ndarray:
    """The child of each node by a character, -1: none."""
    if not len(keys):
        return np.full(len(nodes), -1)
    want = nodes << BITS | char
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where((keys[at] == want) & (nodes >= 0), at, -1)


def _siblings(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of one node."""
    parents = keys >> BITS
    n = np.arange(len(keys)) - np.searchsorted(parents, parents)
    y = np.repeat(np.arange(len(keys)), n)
    return np.arange(len(y)) - np.repeat(np.cumsum(n) - n - np.searchsorted(parents, parents), n), y


def trie_pairs(groups: np.ndarray, longer: np.ndarray, last: np.ndarray, code: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of strings of one group at distance one, each pair once.

    Strings that aren't `longer` have one length within a group, and those that are have one more; pairs of two longer ones are not
    looked for. last: whether a character may be added behind a group's shorter strings. code[offsets[i]:][:lengths[i]]: string i.
    """
    at = [np.flatnonzero(~longer), np.flatnonzero(longer)]
    short, long_ = (_levels(groups[x], code, offsets[x], lengths[x]) for x in at)
    none = np.empty(0, np.int64)
    out, ends = [], np.full(int(groups.max(initial=-1)) + 1, -1)
    twin = np.arange(len(ends))  # of each node of the shorter strings, the longer ones' node with the same path
    x = y = none  # nodes of shorter strings, their paths differ in one character
    u, v, extra = none, none, none  # a longer string's node and a shorter one's, one level up; the additional character, -1 if not the last one
    for depth in range(len(short) + 1):
        keys, longer_ends = long_[depth] if depth < len(long_) else (none, none)
        which, child = _children(keys, twin)
        ok = twin[which] >= 0
        u, v, extra = np.concatenate([u, child[ok]]), np.concatenate([v, which[ok]]), np.concatenate([np.full(len(u), -1), keys[child[ok]] & MASK])
        if depth:
            a, b = ends[x], ends[y]
            ok = (a >= 0) & (b >= 0)
            out.append((at[0][a[ok]], at[0][b[ok]]))
        if len(u):
            a, b = longer_ends[u], ends[v]
            ok = (a >= 0) & (b >= 0)
            ok[ok] = (extra[ok] < 0) | last[at[0][b[ok]]]
            out.append((at[1][a[ok]], at[0][b[ok]]))
        if depth == len(short):
            break
        below, ends = short[depth]
        further = long_[depth + 1][0] if depth + 1 < len(long_) else none
        which, child = _children(below, v)
        char = below[child] & MASK
        found = _child(further, u[which], char)
        ok = (found >= 0) & (char != extra[which])  # where the next character equals the added one, the change counts as behind it
        u, v = found[ok], child[ok]
        which, child = _children(below, x)
        found = _child(below, y[which], below[child] & MASK)
        ok = found >= 0
        new = _siblings(below)
        x, y = np.concatenate([child[ok], new[0]]), np.concatenate([found[ok], new[1]])
        twin = _child(keys, twin[below >> BITS], below & MASK)
    if not out:
        return none, none
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _group_starts(t: pa.Table) -> np.ndarray:
    """Whether each row begins a group."""
    new = np.ones(len(t), bool)
    if len(t) > 1:
        differs = [t.column(c).to_numpy() for c in GROUP[:3]]
        new[1:] = np.logical_or.reduce([d[1:] != d[:-1] for d in differs])
        shared = t.column("shared").combine_chunks()
        new[1:] |= pc.not_equal(shared.slice(1), shared.slice(0, len(shared) - 1)).to_numpy(zero_copy_only=False)
    return new


def _near_of(t: pa.Table) -> pa.RecordBatch | None:
    """Of whole groups: each word that has near words, how many there are, and the most frequent one."""
    groups = np.cumsum(_group_starts(t)) - 1
    lo, hi, l, extra, n = (t.column(c).to_numpy().astype(np.int64) for c in ("lo", "hi", "l", "extra", "n"))
    middles = t.column("middle").to_pylist()
    lengths = hi - lo + extra
    code = np.frombuffer("".join(middles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    i, j = trie_pairs(groups, extra > 0, hi == l, code, np.cumsum(lengths) - lengths, lengths)
    if not len(i):
        return None
    i, j = np.concatenate([i, j]), np.concatenate([j, i])
    used = np.unique(i)
    shared = t.column("shared").take(pa.array(used)).to_pylist()
    words = [s[: lo[k]] + middles[k] + s[lo[k] :] for k, s in zip(used, shared, strict=True)]
    order = np.argsort(np.array(words, object), kind="stable")
    rank = np.empty(len(used), np.int64)
    rank[order] = np.arange(len(used))
    i, j = np.searchsorted(used, i), np.searchsorted(used, j)
    freq = n[used]
    by = np.lexsort((rank[j], -freq[j], i))
    i, j = i[by], j[by]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    best = j[first]
    columns = [words, np.diff(np.r_[first, len(i)]), freq[best], [words[k] for k in best]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["word", "n_near", "best_n", "best"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole groups at a time: the last group of a batch waits for the next one."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        cut = int(np.flatnonzero(_group_starts(t))[-1])
        held = t.slice(cut)
        if cut and (found := _near_of(t.slice(0, cut))) is not None:
            yield found
    if held is not None and (found := _near_of(held)) is not None:
        yield found


def near_words(words: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """(word, n_near, best_n, best) of the distinct words (word, n) that have near ones: at distance one, by one inserted, deleted or replaced code point.

    best is the near word with the largest n; ties go to the smallest in code-point order. Null and empty words have no near ones.
    """
    entries = prefix_entries(words.select("word", F.col("n").cast("long").alias("n")).where("word <> ''"), limit)
    dealt = entries.repartition("key").sortWithinPartitions("key", *GROUP)
    found = dealt.mapInArrow(_walk, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w")))
    found = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
    return found.select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form): the end of each chain, by doubling. Chains rise in n by a factor, so they are short and without cycles."""
    now = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        up = now.select(F.col("word").alias("root"), F.col("root").alias("up"))
        nxt = materialise(now.join(up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        now = nxt.select("word", "root")
        if not nxt.where("moved").take(1):
            return now


def spelling_groups(words: DataFrame, factor: int = 5, limit: int = GROUP_WORDS) -> DataFrame:
    """Each word (word, n) with its form, the root that its forms lead to, and its near words.

    form: the near word of largest n, if that n is at least `factor` times the word's. Words are distinct; other columns of
    `words` are left out. An empty table gives an empty result.
    """
    words = materialise(words.select("word", "n"))
    near = near_words(words, limit)
    has = F.col("best_n") >= factor * F.col("n")
    joined = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    joined = materialise(joined)
    roots = _roots(joined.where("form is not null").select("word", "form"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
