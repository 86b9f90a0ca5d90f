"""The corpus operators against plain single-machine versions on the smallest tables."""

import math
import os
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.llm import decontamination, hmm, lines, near_dup, packing, quality, sharding, substrings

FOLDER = "/root/testdata/sf0.001"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def join(parent, a, b):
    a, b = root(parent, a), root(parent, b)
    parent[max(a, b)] = min(a, b)


def check_near(rows, got, k):
    sets = {}
    for i, t in rows:
        w = t.encode().translate(LOWER).split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}
    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                join(parent, a, b)
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), root(parent, i), root(parent, i) == i) for i in sets}
    return parent


def test_near_duplicates(docs, rows):
    parent = check_near(rows, {r.doc_id: r for r in near_dup.near_duplicates(docs, k=4).collect()}, 4)
    assert len({root(parent, i) for i in parent}) < len(parent)


def test_near_duplicates_of_one_large_group(spark):
    """A group of edited copies, from near to far, where most pairs are below the threshold."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 4, 8, 20])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        made.append((i, " ".join(words)))
    table = spark.createDataFrame(made, "doc_id long, text string")
    check_near(made, {r.doc_id: r for r in near_dup.near_duplicates(table, k=5).collect()}, 5)


def test_signatures_within_the_distance_share_a_key():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = rng.integers(0, 2**near_dup.BITS, (near_dup.CHUNKS, near_dup.WIDTH))
        b = a.copy()
        for p in rng.choice(near_dup.POSITIONS, 15, replace=False):
            b[p // near_dup.WIDTH, p % near_dup.WIDTH] ^= 1
        assert any((a[c] != b[c]).sum() <= 1 for c in range(near_dup.CHUNKS))


def plain_lines(text):
    """(line, its normalised words) of each line, without the vectorised hashing."""
    return [(line, tuple(line.encode().translate(lines.NORMAL).split())) for line in text.split("\n")]


def share_a_key(a, b):
    """Whether two lines have one of the first and one of the last two of four blocks in common (all words but one of seven or fewer), or a half."""
    n = len(a)
    if n == len(b):
        m = n if n <= 7 else 4
        same = [a[n * j // m : n * (j + 1) // m] == b[n * j // m : n * (j + 1) // m] for j in range(m)]
        if sum(same) >= n - 1 if n <= 7 else any(same[:2]) and any(same[2:]):
            return True
    halves = lambda n: {h for h in (n // 2, (n - 1) // 2) if h >= 3}
    return any(a[:h] == b[:h] or a[-h:] == b[-h:] for h in halves(len(a)) & halves(len(b)))


def test_lines(docs, rows):
    node = {}
    for i, t in sorted(rows):
        for _, w in plain_lines(t):
            if len(w) >= 3:
                node.setdefault(w, i)
    keys = list(node)
    parent = {k: k for k in range(len(keys))}
    number = {w: k for k, w in enumerate(keys)}
    for i in range(len(keys)):
        for j in range(i + 1, len(keys)):
            if share_a_key(keys[i], keys[j]) and lines.similar(*(b" ".join(keys[x]).decode() for x in (i, j)), 0.9):
                join(parent, i, j)
    stays = defaultdict(lambda: 1 << 60)
    for w, k in number.items():
        stays[root(parent, k)] = min(stays[root(parent, k)], node[w])
    got = {r.doc_id: r for r in lines.line_report(docs).collect()}
    removed = 0
    for i, t in rows:
        seen, kept = set(), []
        for line, w in plain_lines(t):
            if len(w) >= 3:
                of = root(parent, number[w])
                if stays[of] != i or of in seen:
                    continue
                seen.add(of)
            kept.append(line)
        removed += t.count("\n") + 1 - len(kept)
        assert (got[i].n_removed, got[i].text_crc32) == (t.count("\n") + 1 - len(kept), zlib.crc32("\n".join(kept).encode()))
    assert removed


def test_line_hashes_do_not_depend_on_what_stands_around(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice("ab1.,é \n") for _ in range(rng.randrange(300))).encode() for _ in range(60)]
    together = lines.line_features(texts)
    alone = [lines.line_features([line])[1][0] for t in texts for line in t.split(b"\n")]
    assert together[1].tolist() == alone and together[0].sum() == len(together[2])
    by_words = defaultdict(set)
    for h, line in zip(alone, (line for t in texts for line in t.split(b"\n"))):
        by_words[tuple(line.translate(lines.NORMAL).split())].add(int(h))
    assert all(len(v) == 1 for v in by_words.values()) and len(set.union(*by_words.values())) == len(by_words)
    monkeypatch.setattr(lines, "BLOCK", 64)  # many blocks, words across their ends
    lines._tables.cache_clear()
    texts += [b"x" * 200 + b" " + b"y" * 64, b"x" * 199 + b"z"]
    assert lines.line_features(texts)[1].tolist() == [h for t in texts for h in (lines.line_features([line])[1][0] for line in t.split(b"\n"))]
    cut = [lines.line_features(texts)[1].tolist()]
    monkeypatch.undo()
    lines._tables.cache_clear()
    assert cut == [lines.line_features(texts)[1].tolist()]


def test_lines_of_one_large_group(spark):
    """Many near copies of one line that don't all share a key: what stays apart, brute force says."""
    rng = random.Random(8)
    words = [f"word{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) if rng.random() < 0.03 else w for w in words) for _ in range(160)]
    rows = list(enumerate(texts))
    test_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_edit_distance():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(70))) for _ in range(2))
        assert lines.edit_distance(a, b) == plain(a, b)


def test_substrings(docs, rows):
    where = defaultdict(set)
    cut = {}
    for i, t in rows:
        data = t.encode()
        ends = substrings.cuts(data, 4)
        cut[i] = [(a, b, data[a:b]) for a, b in zip([0, *ends], ends)]
        assert b"".join(c for _, _, c in cut[i]) == data
        for _, _, c in cut[i]:
            where[c].add(i)
    got = {r.doc_id: r for r in substrings.repeat_report(docs).collect()}
    changed = 0
    for i, t in rows:
        runs, seen = [], set()
        for a, b, c in cut[i]:
            if min(where[c]) < i or c in seen:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            seen.add(c)
        runs = [r for r in runs if len(t.encode()[r[0] : r[1]].split()) >= 16]
        assert got[i].spans == [x for r in runs for x in r] and got[i].changed == bool(runs)
        changed += bool(runs)
    assert changed


def test_a_shared_passage_is_cut_wherever_it_stands(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(80))
    texts = [(i, " ".join([*(word() for _ in range(rng.randint(5, 60))), passage, *(word() for _ in range(30))])) for i in range(12)] + [(99, " ".join(word() for _ in range(200)))]
    got = {r.doc_id: r for r in substrings.repeat_report(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert not got[0].changed and not got[99].changed and all(got[i].changed and got[i].n_removed > 0.6 * len(passage) for i in range(1, 12))


def test_language_scores(docs, rows):
    count = Counter()
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    words = {i: [*t.encode().translate(LOWER).split(), b"\n"] for i, t in rows}
    for i, _ in rows:
        if not held(i):
            count.update(words[i])
    total, kinds = sum(count.values()), len(count)
    got = {r.doc_id: r for r in hmm.language_scores(docs, rounds=2).collect()}
    gain = []
    for i, _ in rows:
        base = sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words[i])
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i), len(words[i]), sum(count[w] > 0 for w in words[i]), total)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        gain += [(got[i].score - base) / len(words[i])] * held(i)
    assert np.mean(gain) > 0.1


def test_forward_is_the_sum_over_all_paths():
    import itertools

    rng = np.random.default_rng(3)
    k = hmm.STATES
    emit = rng.random((hmm.CLASSES, k))
    model = hmm._model(rng.random(k), rng.random((k, k)) * 9, emit * 9, np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1)
    sequence = [5, 17, 5]
    row = {"tokens": np.array([0, 1, 0], "<u4").tobytes(), "classes": [5, 17], "lengths": np.array([3], "<u4").tobytes(), "held": [False]}
    exact = sum(model.start[p[0]] * model.move[p[0], p[1]] * model.move[p[1], p[2]] * np.prod([model.emit[c, s] for c, s in zip(sequence, p)]) for p in itertools.product(range(k), repeat=3))
    assert hmm.forward(row, model)[0] == pytest.approx(math.log(exact), rel=1e-9)
    start, moves, found = hmm.expected_counts(row, model)
    assert start.sum() == pytest.approx(1, rel=1e-4) and moves.sum() == pytest.approx(2, rel=1e-4) and found.sum() == pytest.approx(3, rel=1e-4)


def test_expected_counts_sum_over_all_paths_of_whole_texts():
    import itertools

    rng = np.random.default_rng(4)
    k = hmm.STATES
    model = hmm._model(rng.random(k), rng.random((k, k)) * 9, rng.random((hmm.CLASSES, k)) * 9, np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    texts, held, classes = [[0], [2, 1, 2, 0], [1, 1], [3, 0], [1, 2, 0]], [False, False, True, False, False], [5, 17, 200, 17]
    row = {"tokens": np.concatenate(texts).astype("<u4").tobytes(), "classes": classes, "lengths": np.array(list(map(len, texts)), "<u4").tobytes(), "held": held}
    start, moves, found = np.zeros(k), np.zeros((k, k)), np.zeros((hmm.CLASSES, k))
    for text, out in zip(texts, held):
        seen = [classes[w] for w in text]
        paths = list(itertools.product(range(k), repeat=len(seen)))
        chance = np.array([model.start[p[0]] * np.prod([model.move[a, b] for a, b in zip(p, p[1:])]) * np.prod([model.emit[c, s] for c, s in zip(seen, p)]) for p in paths])
        for p, share in zip(paths, chance / chance.sum() * (not out)):
            start[p[0]] += share
            for a, b in zip(p, p[1:]):
                moves[a, b] += share
            for c, s in zip(seen, p):
                found[c, s] += share
    for got, exact in zip(hmm.expected_counts(row, model), (start, moves, found)):
        assert np.allclose(got, exact, rtol=1e-4, atol=1e-6)
    assert all(not x.any() for x in hmm.expected_counts({**row, "held": [True] * 5}, model))


def test_moves_are_counted_through_long_texts():
    k, n = hmm.STATES, 800
    model = hmm._model(np.ones(k), np.eye(k) * 50, np.ones((hmm.CLASSES, k)), np.full(hmm.CLASSES, 1 / hmm.CLASSES))
    row = {"tokens": np.zeros(n, "<u4").tobytes(), "classes": [7], "lengths": np.array([n], "<u4").tobytes(), "held": [False]}
    start, moves, found = hmm.expected_counts(row, model)
    assert (start.sum(), moves.sum(), found.sum()) == pytest.approx((1, n - 1, n), rel=1e-4)


def test_contamination(spark, docs, rows):
    benchmark = spark.read.parquet(f"{FOLDER}/benchmark.parquet")
    items = {r.item_id: decontamination.item_words(r.text) for r in benchmark.collect()}
    window = {}
    for i, w in items.items():
        for s in range(max(1, len(w) - 12)):
            window.setdefault(tuple(w[s : s + 13]), set()).add(i)
    one, many = (decontamination.contamination(docs, benchmark, block_words=n) for n in (10**6, 400))
    got = {r.doc_id: r for r in one.collect()}
    assert got == {r.doc_id: r for r in many.collect()}  # in one block or in several
    for i, t in rows:
        w = decontamination.item_words(t)
        hit, found = set(), set()
        for s in range(len(w)):
            if ids := window.get(tuple(w[s : s + 13])):
                hit |= set(range(s, s + 13))
                found |= ids
        assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (len(w), len(hit), len(found), 0 < len(hit) and 20 * len(hit) >= len(w))
    assert any(r.contaminated for r in got.values())


def test_automaton_on_random_words():
    rng = random.Random(3)
    for _ in range(400):
        letters = [b"a", b"b", b"c"][: rng.randint(1, 3)]
        items = {i: [rng.choice(letters) for _ in range(rng.randint(1, 12))] for i in range(rng.randint(1, 5))}
        n, words = rng.randint(1, 6), [rng.choice([*letters, b"z"]) for _ in range(rng.randint(0, 40))]
        hit, found = set(), set()
        for k, w in items.items():
            for part in [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else [w]:
                for i in range(len(words) - len(part) + 1):
                    if words[i : i + len(part)] == part:
                        hit |= set(range(i, i + len(part)))
                        found.add(k)
        spans, keys = decontamination.build(items, n).scan(words)
        assert {x for a, b in spans for x in range(a, b)} == hit and keys == found


def test_packing_round_trip(docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = packing.pack_documents(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, t in rows:
        ids, at = [*tokenizer.encode(t, add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            part = np.array(ids[p.start : p.start + p.length], "<u4").tobytes()
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(part)
            at += p.length
        assert at == len(ids)
    for s in by_sequence.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
    assert sum(p.length for p in pieces) / (2048 * len(by_sequence)) > 0.97


def test_other_scripts_and_spacing_are_encoded_alike():
    encode = packing.ByteBpe("byte_bpe_50k.json", True)
    rng = random.Random(1)
    letters = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250)]] + list("漢字かな😀é́ßΩж")
    texts = ["".join(rng.choice(letters if rng.random() < 0.4 else " \n\t'sStabé1 wa ..,!") for _ in range(rng.randrange(40))) for _ in range(3000)] + ["<|endoftext|> a"]
    assert [x.tolist() for x in encode(texts)] == [encode.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_sharding_balances(docs, rows):
    found = sharding.assign_shards(docs)
    by_shard = found.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    assert sum(r.rows for r in by_shard) == len(rows) and {r["shard"] for r in by_shard} == set(range(24))
    placed = sharding.place(np.random.default_rng(1).random((5000, 3)) / 2500, np.full((24, 3), 1 / 24))[0]
    sizes = np.bincount(placed, minlength=24)
    assert sizes.max() / sizes.mean() < 1.05
    shard_of = defaultdict(set)
    texts = dict(rows)
    for r in found.collect():
        shard_of[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


def test_quality_is_learnt(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in scored]) > 0.97


def test_quality_does_not_depend_on_partitions(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    one = quality.fit(docs.repartition(3), labels)
    other = quality.fit(docs.repartition(17).orderBy(F.desc("text")), labels.repartition(5))
    assert one.intercept == pytest.approx(other.intercept, abs=1e-6)
    assert one.weights == pytest.approx(other.weights, abs=1e-6)


def test_pipeline_runs_to_packed_pieces(spark, rows):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    left = {p.doc_id for p in pieces}
    assert 0.5 * len(rows) < len(left) < len(rows) and left <= {i for i, _ in rows}
