"""A hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihoods by scaled forward recursion.

A state emits a word class (a hash of the word's last letters); a class emits a word with its smoothed share of the
class's training count. Both are proper distributions, with one unknown word in each class, so a text's score is
the log10 of a probability. What the states hold is bounded by parameters (states x classes); the words' counts are
a table as large as the vocabulary and never leave the executors.

Texts are first turned into chunk records of about a million tokens: each has a dictionary of its own distinct words
and the texts as indexes into it. Counts are asked for by (word, chunk), so a frequent word is one row for each
chunk and not one for each token, and each chunk gets back the counts of its own dictionary.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from terrachron.llm.common import materialise, mix, small_side, texts_in, words_of

STATES, CLASSES, SUFFIX = 8, 8192, 4
#: The end of a text is a word that no text can hold, in a class of its own: the last one.
END = b"\n"
CHUNK_TOKENS = 1_000_000
#: A word that this share of all chunks has is common.
COMMON = 0.25
#: How far the states differ at first: the ratio of their emissions of a class is at most e to this power.
TILT = 3.0


def held_out(doc_id: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold, F.lit(False))


def word_class(word: bytes) -> int:
    return CLASSES - 1 if word == END else xxhash.xxh3_64_intdigest(word[-SUFFIX:]) % (CLASSES - 1)


CHUNK = "chunk long, docs array<long>, held array<boolean>, lengths binary, tokens binary, words array<long>, classes array<int>, counts array<long>"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = itertools.count(TaskContext.get().partitionId() << 32)
    kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in CHUNK.split(", ")]

    def fresh():
        ids: dict[bytes, int] = defaultdict(itertools.count().__next__)
        ids[END]
        return ids, [], [], []

    def record() -> pa.RecordBatch:
        words = list(ids)
        lengths = np.array([len(s) for s in seqs], "<u4")
        flat = np.concatenate(seqs)
        train = np.repeat(~np.array(held, bool), lengths)
        counts = np.bincount(flat[train], minlength=len(words))
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64).view(np.int64)
        row = [next(number), docs, held, lengths.tobytes(), flat.tobytes(), hashes, np.array([word_class(w) for w in words], np.int32), counts]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

    ids, docs, held, seqs = fresh()
    size = 0
    for batch in batches:
        doc_ids, flags = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for first, texts in texts_in(batch, "text", 256):
            for i, text in enumerate(texts, first):
                words = words_of(text)
                words.append(END)
                seqs.append(np.fromiter(map(ids.__getitem__, words), "<u4", len(words)))
                docs.append(doc_ids[i])
                held.append(flags[i])
                size += len(words)
                if size >= CHUNK_TOKENS:
                    yield record()
                    ids, docs, held, seqs = fresh()
                    size = 0
    if docs:
        yield record()


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit  # emit: class x state


def _sequences(row: dict, train_only: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Classes of all tokens; starts and lengths of whole texts, from the longest; their places in the record."""
    classes = np.array(row["classes"], np.int32)[np.frombuffer(row["tokens"], "<u4")]
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    starts, places = np.cumsum(lengths) - lengths, np.arange(len(lengths))
    if train_only:
        places = places[~np.array(row["held"], bool)]
    places = places[np.argsort(-lengths[places], kind="stable")]
    return classes, starts[places], lengths[places], places


def _by_step(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of texts (longest first) in the order of their steps: all first tokens, all second ones, and so on.

    Returns how many texts have each step, where each step begins, each token's place in the record and, for the tokens
    behind the first step, the place of the token before in this order.
    """
    active = np.searchsorted(-lengths, -np.arange(lengths.max(initial=0)), side="left")
    begins = np.cumsum(active) - active
    within = np.arange(active.sum()) - np.repeat(begins, active)
    at = starts[within] + np.repeat(np.arange(len(active)), active)
    before = within[len(lengths) :] + np.repeat(begins[:-1], active[1:])
    return active, begins, at, before


def _forward(active: np.ndarray, begins: np.ndarray, emitted: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward probabilities and scales of all tokens, by step."""
    alpha, scale = np.empty_like(emitted), np.empty(len(emitted), emitted.dtype)
    now = None
    for t, (b, n) in enumerate(zip(begins.tolist(), active.tolist())):
        now = emitted[b : b + n] * (start if t == 0 else now[:n] @ move)
        scale[b : b + n] = total = now.sum(axis=1)
        now /= total[:, None]
        alpha[b : b + n] = now
    return alpha, scale


def expected_counts(row: dict, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (class x state) of a chunk's training texts, each as a whole."""
    classes, starts, lengths, _ = _sequences(row, True)
    k, kind = len(m.start), np.float32
    if not len(lengths):
        return np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k))
    active, begins, at, before = _by_step(starts, lengths)
    classes, move = classes[at], m.move.astype(kind)
    weighed = m.emit.astype(kind)[classes]
    alpha, scale = _forward(active, begins, weighed, m.start.astype(kind), move)
    weighed /= scale[:, None]
    beta = np.ones_like(alpha)
    back = np.ascontiguousarray(move.T)
    for t in range(len(active) - 1, 0, -1):
        b, n, to = begins[t], active[t], begins[t - 1]
        weighed[b : b + n] *= beta[b : b + n]  # what a token and all behind it add to the step that leads to it
        beta[to : to + n] = weighed[b : b + n] @ back
    moves, behind = np.zeros((k, k)), weighed[len(lengths) :]
    for i in range(0, len(before), 65_536):
        moves += alpha[before[i : i + 65_536]].T @ behind[i : i + 65_536]
    alpha *= beta
    alpha /= alpha.sum(axis=1)[:, None]  # each token's share of each state
    found = np.stack([np.bincount(classes, alpha[:, i], CLASSES) for i in range(k)], axis=1)
    return alpha[: len(lengths)].sum(axis=0, dtype=float), moves * m.move, found


def forward(row: dict, m: Model) -> np.ndarray:
    """The natural log likelihood of each text's classes, in the order of the record, by the scaled forward recursion."""
    classes, starts, lengths, places = _sequences(row, False)
    out, now = np.zeros(len(starts)), None
    active, begins, at, _ = _by_step(starts, lengths)
    classes = classes[at]
    for t, (b, n) in enumerate(zip(begins.tolist(), active.tolist())):
        now = m.emit[classes[b : b + n]] * (m.start if t == 0 else now[:n] @ m.move)
        total = now.sum(axis=1)
        now /= total[:, None]
        out[:n] += np.log(total)
    result = np.empty(len(starts))
    result[places] = out
    return result


COUNTS = "at int, " + ", ".join(f"s{i} double" for i in range(STATES))


def _rows(at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(values[:, i], pa.float64()) for i in range(STATES))], names=[c.split()[0] for c in COUNTS.split(", ")])


def _expect(shared):
    """A task's counts: moves at -1 - state, starts at -1 - STATES, emissions at the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, moves, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
        for batch in batches:
            for i in range(batch.num_rows):
                a, b, c = expected_counts(batch.slice(i, 1).to_pylist()[0], shared.value)
                start, moves, emit = start + a, moves + b, emit + c
        some = np.flatnonzero(emit.any(axis=1))
        yield _rows(np.concatenate([-1 - np.arange(STATES + 1), some]), np.concatenate([moves, start[None, :], emit[some]]))

    return run


def _first_guess(share: np.ndarray) -> np.ndarray:
    """Emissions to begin with (class x state): each class's share of all training tokens, tilted by a fixed hash of class and state.

    It depends on the words' counts alone, so equal tables give equal models, however they are partitioned.
    """
    tilt = mix(np.arange(CLASSES * STATES, dtype=np.uint64), 6).reshape(CLASSES, STATES) >> np.uint64(11)
    return share[:, None] * np.exp(TILT * (tilt / 2.0**53 - 0.5))


def _collect(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums over all tasks: starts, moves, emissions. Their size is set by STATES and CLASSES alone."""
    rows = counts.groupBy("at").agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(STATES))).collect()
    start, moves, emit = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((CLASSES, STATES))
    for r in rows:
        if r[0] >= 0:
            emit[r[0]] = r[1:]
        elif r[0] == -1 - STATES:
            start[:] = r[1:]
        else:
            moves[-1 - r[0]] = r[1:]
    return start, moves, emit


def _model(start: np.ndarray, moves: np.ndarray, emit: np.ndarray, share: np.ndarray, weight: float = 200.0) -> Model:
    """Counts to probabilities, drawn a little towards equal starts and moves and the classes' overall shares."""
    start, moves, emit = start + 1.0, moves + 1.0, emit + weight * share[:, None]
    return Model(start / start.sum(), moves / moves.sum(axis=1)[:, None], emit / emit.sum(axis=0)[None, :])


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, sums, total, vocabulary = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                classes = np.array(row["classes"], np.int64)
                c = np.zeros(len(classes))
                if row["reply"]:
                    at, n = np.frombuffer(row["reply"], "<i8").reshape(-1, 2).T
                    c[at] = n
                base = np.log10((c + 0.5) / (total + 0.5 * (vocabulary + 1)))
                word = np.where(classes == CLASSES - 1, 0.0, np.log10((c + 0.5) / sums[classes]))
                tokens, lengths = np.frombuffer(row["tokens"], "<u4"), np.frombuffer(row["lengths"], "<u4")
                starts = np.cumsum(lengths.astype(np.int64)) - lengths
                by_text = lambda values: np.add.reduceat(values[tokens], starts)  # noqa: E731  every text has its end
                score = forward(row, model) / np.log(10) + by_text(word)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(lengths, pa.int64()), pa.array(by_text((c > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(starts), total), pa.int64()), pa.array(by_text(base), pa.float64()), pa.array(score, pa.float64())],
                    names=[x.split()[0] for x in SCORES.split(", ")],
                )

    return run


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _reply(rows):
    pairs = np.stack([rows.column("pos").to_numpy(), rows.column("c").to_numpy()], axis=1).astype("<i8")
    return pa.table({"of": rows.column("chunk").slice(0, 1).cast(pa.int64()), "reply": pa.array([pairs.tobytes()], pa.binary())})


def language_scores(docs: DataFrame, rounds: int = 4) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from the rows that aren't held out (a null doc_id isn't). A null or empty text is its end alone. Repeated
    rows are learnt from and scored as often as they occur. With nothing to learn from, all words are unknown. An
    empty table gives no rows; other columns are ignored.
    """
    doc_id = F.col("doc_id").cast("long")
    source = docs.select(doc_id.alias("doc_id"), "text", held_out(F.col("doc_id")).alias("held"))
    chunks = materialise(source.mapInArrow(_chunks, CHUNK))
    spark = docs.sparkSession
    # Each word's training count, beside each chunk that asks for it.
    asked = chunks.select("chunk", F.posexplode(F.arrays_zip("words", "classes", "counts")).alias("pos", "w")).select("chunk", "pos", F.col("w.words").alias("word"), F.col("w.classes").alias("class"), F.col("w.counts").alias("n"))
    # Counts are added up within tasks first.
    counted = materialise(asked.where("n > 0").groupBy("word").agg(F.sum("n").alias("c"), F.min("class").alias("class"), F.count("*").alias("chunks")))
    by_class = counted.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # CLASSES rows at most
    # A word of many chunks is told without a shuffle, as long as these words are few; no more than CHUNK_TOKENS / COMMON words can be in a share COMMON of all chunks.
    often = F.col("chunks") >= COMMON * chunks.count()
    common = small_side(counted.where(often).select("word", "c"))
    wanted = asked.select("chunk", "pos", "word")
    rest = wanted.join(common.select("word"), "word", "left_anti").join(counted.where(~often).select("word", "c").hint("merge"), "word")
    told = wanted.join(common, "word").select("chunk", "pos", "c").unionByName(rest.select("chunk", "pos", "c"))
    sums = np.full(CLASSES, 0.5)  # an unknown word in each class
    for r in by_class:
        sums[r["class"]] += r["c"] + 0.5 * r["v"]
    total, vocabulary = sum(r["c"] for r in by_class), sum(r["v"] for r in by_class)
    share = sums / sums.sum()
    trained = chunks.where("exists(held, h -> not h)").select("chunk", "held", "lengths", "tokens", "classes")
    model = _model(np.zeros(STATES), np.eye(STATES) * 500, _first_guess(share) * total, share)
    if total:
        for _ in range(rounds):
            shared = spark.sparkContext.broadcast(model)
            model = _model(*_collect(trained.mapInArrow(_expect(shared), COUNTS)), share)
    replies = told.select("chunk", "pos", "c").groupBy("chunk").applyInArrow(_reply, "of long, reply binary")
    shared = spark.sparkContext.broadcast((model, sums, total, vocabulary))
    both = chunks.select("chunk", "docs", "held", "lengths", "tokens", "classes").join(replies, F.col("chunk") == F.col("of"), "left").drop("of")
    return both.mapInArrow(_score(shared), SCORES)
