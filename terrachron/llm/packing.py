"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task streams the documents of its own scan partition; nothing is shuffled. A document gives full windows
first and one remainder. The remainder goes to the fill level that leaves the smallest sum of squared counts of
partly filled windows; a level array holds those counts. When a task's input ends, the windows still open are
poured together, cut where a window is full, so a task leaves at most one window short.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from terrachron.llm.common import texts_in

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: What a text may hold to be encoded by word: settled Latin characters (their classes are the same in every Unicode
#: version) and no white space beside a space.
SETTLED = bytes([10, *range(0x20, 0x7F), *range(0xA1, 0x100)])
UNSETTLED = re.compile("[^\\n\\x20-\\x7e\\xa1-\\u024f]")
#: A word of letters and the punctuation behind it: two parts to the pre-tokenizer.
PUNCTUATED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)").fullmatch
#: A Python worker remembers the last so many words, and twice as many at most (about 65 MB each time).
REMEMBERED = 400_000


class ByteBpe:
    """Token ids as `tokenizers` gives them, with each distinct word encoded once.

    The pre-tokenizer of this kind of vocabulary starts a new part at each single space and encodes every part by
    itself, so the ids of a word with its space can be remembered. Any other text (other scripts, runs of white
    space, the text of a special token) goes to the tokenizer whole.
    """

    def __init__(self, vocabulary: str, as_text: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.tokenizer.encode_special_tokens = as_text
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token: a character stands for one
        self.lengths[list(vocab.values())] = list(map(len, vocab))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before `known` was full
        self.heads: dict[str, bytes] = {}  # without a space before

    def _by_word(self, text: str) -> bool:
        try:
            settled = not text.encode("latin-1").translate(None, SETTLED)
        except UnicodeEncodeError:
            settled = not UNSETTLED.search(text)
        spaced = "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " "
        return settled and not spaced and not any(s in text for s in self.special)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: list[str]) -> None:
        """Encodes new words in one text, each after a space, and shares the ids out by their bytes."""
        found = self.tokenizer.encode_batch_fast([" " + " ".join(words)], add_special_tokens=False)[0]
        ids = np.array(found.ids, "<u4")
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 4).tolist()
        data = ids.tobytes()
        self.known.update(zip(words, [data[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _head(self, word: str) -> bytes:
        if word not in self.heads:
            self.heads[word] = self._ids(word).tobytes()
        return self.heads[word]

    def _add(self, words: list[str]) -> None:
        """Learns new words: those with punctuation behind from their two parts."""
        known, whole, parts = self.known, [], []
        for w in words:
            if not w[-1:].isalnum() and (m := PUNCTUATED(w)):
                parts.append((w, m[1], m[2]))
            else:
                whole.append(w)
        whole = list({*whole, *(a for _, a, _ in parts if a not in known)})
        for start in range(0, len(whole), 20_000):
            self._learn(whole[start : start + 20_000])
        behind = {b: self._head(b) for b in {b for _, _, b in parts}}
        known.update([(w, known[a] + behind[b]) for w, a, b in parts])

    def forget(self) -> None:
        """Lets go of what was known before: a worker that is done with a task may hold memory for other work next."""
        self.older = {}

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.known, self.older, self.heads = {}, self.known, {}
        words = [t.split(" ") if self._by_word(t) else [] for t in texts]
        heads = [w.pop(0) if w else None for w in words]
        new = set().union(*words).difference(self.known)
        if new:
            again = {w: ids for w in new if (ids := self.older.get(w)) is not None}
            self.known.update(again)
            if len(again) < len(new):
                self._add([w for w in new if w not in again])
        ids_of = self.known.__getitem__
        return [np.frombuffer(self._head(head) + b"".join(map(ids_of, w)), "<u4") if w else self._ids(text) for text, head, w in zip(texts, heads, words)]


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str, as_text: bool) -> ByteBpe:
    return ByteBpe(vocabulary, as_text)


class Levels:
    """Partly filled windows by their fill. counts[h] is how many are filled to h."""

    def __init__(self, size: int):
        self.size, self.counts = size, np.zeros(size + 1, np.int64)
        self.open: list[list] = [[] for _ in range(size)]

    def place(self, item) -> list | None:
        """Adds an item (document, start, ids, ...) to a window; returns the window if that fills it."""
        n, counts = len(item[2]), self.counts
        # What the sum of squares gains at each level h: the window leaves h and arrives at h + n.
        at = counts[: self.size - n + 1]
        gain = 2 * (counts[n : self.size + 1] - at) + 2
        gain[at == 0] = np.iinfo(np.int64).max
        gain[0] = 2 * counts[n] + 1
        if len(at) > 1 and at[-1]:  # a full window is no partly filled one
            gain[-1] = 1 - 2 * at[-1]
        h = int(gain.argmin())
        window = self.open[h].pop() if h else []
        if h:
            counts[h] -= 1
        window.append(item)
        if h + n == self.size:
            return window
        counts[h + n] += 1
        self.open[h + n].append(window)
        return None

    def rest(self) -> Iterator[list]:
        """The open windows' items poured one after the other, cut at each full window; fullest windows first."""
        now, fill = [], 0
        for level in reversed(self.open):
            for window in level:
                for doc, start, ids, total in window:
                    while len(ids):
                        part = ids[: self.size - fill]
                        now.append((doc, start, part, total))
                        start, ids, fill = start + len(part), ids[len(part) :], fill + len(part)
                        if fill == self.size:
                            yield now
                            now, fill = [], 0
        if now:
            yield now


def _pack(vocabulary: str, as_text: bool, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, levels = tokenizer(vocabulary, as_text), Levels(size)
        next_id, rows = TaskContext.get().partitionId() << 40, []

        def emit(window: list) -> None:
            nonlocal next_id
            offset = 0
            for doc, start, ids, total in window:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, next_id, offset))
                offset += len(ids)
            next_id += 1

        def out() -> pa.RecordBatch:
            kinds = [f.split() for f in PIECES.split(", ")]
            columns = list(zip(*rows)) or [[]] * len(kinds)
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[k for k, _ in kinds])
            rows.clear()
            return made

        for batch in batches:
            docs = batch.column(0).to_pylist()
            for first, texts in texts_in(batch, "text"):
                for doc, ids in zip(docs[first:], encode([t or "" for t in texts])):
                    ids = np.append(ids, np.uint32(end_id))
                    total, whole = len(ids), len(ids) // size * size
                    for start in range(0, whole, size):
                        emit([(doc, start, ids[start : start + size], total)])
                    if whole < total and (full := levels.place((doc, whole, ids[whole:], total))):
                        emit(full)
            yield out()
        encode.forget()
        for window in levels.rest():
            emit(window)
        yield out()

    return run


def pack_documents(docs: DataFrame, size: int = 2048, vocabulary: str = "byte_bpe_50k.json", end_id: int = 1, special_as_text: bool = False) -> DataFrame:
    """Packs every document of docs (doc_id, text) into sequences of at most `size` tokens; one row for each piece.

    A null or empty text is the end token alone. Repeated rows are packed as often as they occur, a null doc_id stays
    null, an empty table gives no rows, other columns are ignored. `special_as_text`: the strings of special tokens
    in a text are ordinary text; else they are those tokens. A sequence_id holds the task's number and a count within it, so a task that is run
    again gives the same ids.
    """
    return docs.select("doc_id", "text").mapInArrow(_pack(vocabulary, special_as_text, end_id, size), PIECES)
