"""Benchmark decontamination with a generalised suffix automaton over the words of normalised test items.

Training texts are streamed through the automaton word by word; the longest match that ends at each word tells which
windows (n consecutive item words, or a whole shorter item) end there. The words inside matched windows are hit.

The automaton is built on the driver from one block of items at a time and broadcast. A block holds at most
`block_words` words (70 MB for each 100,000), so what is broadcast is bounded; a larger benchmark takes several blocks, each a pass over what the
pass before it has written.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from terrachron.llm.common import materialise, with_text

#: Bytes that end a word: all ASCII but digits and letters. A-Z become a-z first.
NORMAL = bytes(32 if b < 0x30 or 0x3A <= b < 0x41 or 0x5B <= b < 0x61 or 0x7B <= b < 0x80 else b + 32 if 0x41 <= b < 0x5B else b for b in range(256))


#: Item words of one block: its automaton takes about 70 MB for each 100,000 in a Python worker.
BLOCK_WORDS = 200_000


def item_words(text: str | None) -> list[bytes]:
    return [] if not text else text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


class Automaton:
    """Suffix automaton of several word sequences; after `close`, each state knows the windows that end in it."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _extend(self, last: int, word: int) -> int:
        def split(p: int, q: int) -> int:
            clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
            self.link[q] = clone
            while p >= 0 and self.next[p].get(word) == q:
                self.next[p][word] = clone
                p = self.link[p]
            return clone

        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else split(last, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q)
        return new

    def add(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, self.ids.setdefault(w, len(self.ids)))

    def close(self, items: dict) -> None:
        """items: id to words. A window's items are kept at the state that holds it, by the window's length."""
        n = self.window
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: The state that holds the last n words of a state's matches, if it has as many.
        self.cut = [-1] * len(self.length)
        for v in order:
            self.cut[v] = self.cut[self.link[v]] if self.length[self.link[v]] >= n else v if self.length[v] >= n else -1
        self.owners: dict[int, set] = {}
        whole: dict[int, dict[int, set]] = {}
        for key, words in items.items():
            v = 0
            for i, w in enumerate(words):  # each prefix of an item is the longest match there
                v = self.next[v][self.ids[w]]
                if i + 1 >= n:
                    self.owners.setdefault(self.cut[v], set()).add(key)
            if 0 < len(words) < n:
                whole.setdefault(v, {}).setdefault(len(words), set()).add(key)
        #: Short items that end in a state, from the longest: (length, owners).
        self.short: list[tuple] = [()] * len(self.length)
        for v in order:
            own = tuple(sorted(whole.get(v, {}).items(), reverse=True))
            self.short[v] = own + self.short[self.link[v]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """The hit spans (from, to), in order and apart, and the items whose windows occur."""
        n, link, length, nxt, cut, short, owners = self.window, self.link, self.length, self.next, self.cut, self.short, self.owners
        spans: list[tuple[int, int]] = []
        found: set = set()
        at: set[int] = set()  # states that hold matched windows; their items are joined once, at the end
        state = size = 0
        for i, w in enumerate(map(self.ids.get, words)):
            if w is None:
                state = size = 0
                continue
            while (to := nxt[state].get(w)) is None and state:
                state = link[state]
                size = length[state]
            if to is None:
                continue
            state, size = to, size + 1
            reach = 0
            if size >= n:
                reach = size
                # The last n words lie in the state or, if the match is longer there, on its suffix path.
                at.add(cut[state])
            if short[state]:
                for m, keys in short[state]:
                    if m <= size:
                        found |= keys
                        reach = max(reach, m)
            if reach:
                a = i + 1 - reach
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append((a, i + 1))
        return spans, found.union(*(owners[v] for v in at))


def build(items: dict, window: int) -> Automaton:
    automaton = Automaton(window)
    for words in items.values():
        automaton.add(words)
    automaton.close(items)
    return automaton


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[dict]:
    """The items by id, streamed to the driver a partition at a time, in blocks of at most block_words words."""
    now: dict = {}
    held = 0
    rows = benchmark.where("item_id is not null and text is not null").select("item_id", "text")
    for k, row in enumerate(rows.toLocalIterator()):
        words = item_words(row.text)
        if not words:
            continue
        if now and held + len(words) > block_words:
            yield now
            now, held = {}, 0
        now[(row.item_id, k)] = words
        held += len(words)
    if now:
        yield now


def _merged(spans: list[tuple[int, int]], more: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans + more):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


FOUND = "words long, hit long, spans binary, items array<long>"


def _scan(shared):
    """Texts, and the spans and items found by blocks before, to what FOUND has."""

    def run(texts: pa.Array, spans_before: pa.Array, items_before: pa.Array) -> pa.Array:
        automaton = shared.value
        words_in, hits, spans, items = [], [], [], []
        for start in range(0, len(texts), 1024):
            before = zip(*(x.slice(start, 1024).to_pylist() for x in (texts, spans_before, items_before)))
            for text, old_spans, old_items in before:
                words = item_words(text)
                hit, keys = automaton.scan(words)
                if old_spans:
                    hit = _merged(hit, np.frombuffer(old_spans, "<i8").reshape(-1, 2).tolist())
                words_in.append(len(words))
                hits.append(sum(b - a for a, b in hit))
                spans.append(np.array(hit, "<i8").tobytes())
                items.append(sorted({*(old_items or ()), *(k for k, _ in keys)}))
        out = [pa.array(words_in, pa.int64()), pa.array(hits, pa.int64()), pa.array(spans, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
        return pa.StructArray.from_arrays(out, names=[c.split()[0] for c in FOUND.split(", ")])

    return run


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the struct _tc_found: words, hit, spans (from and to of each hit span, as int64), items (ids).

    Only the text goes to Python. A null or empty text has no words and no hits; repeated rows get equal results; an
    empty table gives no rows; all columns stay.
    """
    out = docs.withColumn("_tc_found", F.lit(None).cast(T.StructType.fromDDL(FOUND)))
    blocks = blocks_of(benchmark, block_words)
    block = next(blocks, {})
    while block is not None:
        after = next(blocks, None)
        shared = docs.sparkSession.sparkContext.broadcast(build(block, window))
        scan = F.arrow_udf(_scan(shared), T.StructType.fromDDL(FOUND)).asNondeterministic()
        out = out.withColumn("_tc_found", scan("text", "_tc_found.spans", "_tc_found.items"))
        if after is not None:
            out = materialise(out)
        block = after
    return out


def _digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.transform(F.array_distinct(items), lambda x: x.cast("string"))), ","), 256)


def _contaminated(coverage: tuple[int, int]) -> Column:
    hit, words = F.col("_tc_found.hit"), F.col("_tc_found.words")
    return (hit > 0) & (coverage[1] * hit >= coverage[0] * words)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs (doc_id, text) judged against benchmark (item_id, text); one row for each row of docs.

    n_words, n_hit (words inside matched windows), n_items, items_sha256, contaminated: n_hit > 0 and
    coverage[1] * n_hit >= coverage[0] * n_words. A null text has no words; an item without id, text or words is
    no item; repeated items with one id count once. Other columns of docs are ignored.
    """
    found = scan_documents(docs.select("doc_id", "text"), benchmark, window, block_words)
    return found.select(
        "doc_id", F.col("_tc_found.words").alias("n_words"), F.col("_tc_found.hit").alias("n_hit"),
        F.size("_tc_found.items").cast("long").alias("n_items"), _digest(F.col("_tc_found.items")).alias("items_sha256"), _contaminated(coverage).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, coverage: tuple[int, int] = (1, 20), block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the documents that `contamination` finds contaminated; the others stay as they are.

    A null or empty text is never contaminated. Repeated rows go or stay together, a null doc_id makes no difference,
    an empty table gives no rows, an empty benchmark takes nothing out.
    """
    return scan_documents(docs, benchmark, window, block_words).where(~_contaminated(coverage)).drop("_tc_found")


def _cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
    word = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        if found:
            data = text.encode("utf-8", "surrogatepass")
            at = [m.span() for m in word.finditer(data)]
            for a, b in reversed(np.frombuffer(found, "<i8").reshape(-1, 2).tolist()):
                data = data[: at[a][0]] + data[at[b - 1][1] :]
            text = data.decode("utf-8", "surrogatepass")
        out.append(text)
    return pa.array(out, pa.string())


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the words of every matched window cut out of the text (from the first word's start to the last one's end).

    What stands between words (white space, punctuation) before and behind a span stays. Null and empty texts stay as
    they are; n_chars follows the text where it changes; all rows and columns stay; an empty table gives no rows.
    """
    found = scan_documents(docs, benchmark, window, block_words)
    cut = F.arrow_udf(_cut, "string").asNondeterministic()
    return with_text(found.withColumn("_tc_left", cut("text", "_tc_found.spans")), F.col("_tc_left")).drop("_tc_left", "_tc_found")
