"""Spelling variants against all pairs compared one by one."""

import random
import re
import zlib

import pytest

from terrachron.llm.spelling import near_words, prefix_entries, spelling_groups, word_counts


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counted(rows):
    n = {}
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                n[run] = n.get(run, 0) + 1
    return {w: c for w, c in n.items() if c >= 5}


def grouped(n):
    out = {}
    for w, c in n.items():
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        out[w] = [best if best is not None and n[best] >= 5 * c else None, len(others)]
    roots = {}
    for w in n:
        r = w
        while out[r][0] is not None:
            r = out[r][0]
        roots[w] = r
    return {(w, f, roots[w], n[w], k, None if f is None else n[f]) for w, (f, k) in out.items()}


def found(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_equals_all_pairs(spark, limit):
    rng = random.Random(limit)
    words = {"".join(rng.choice("abéz") for _ in range(rng.choice((1, 2, 5, 6, 7, 8)))) for _ in range(220)}
    # A third of all words share a long prefix, and some have runs of one character, where the place of an insertion is ambiguous.
    words |= {"international" + "".join(rng.choice("ab") for _ in range(rng.randint(1, 7))) for _ in range(110)}
    words |= {"a" * i for i in range(1, 12)} | {"a" * i + "b" + "a" * j for i in range(4) for j in range(4)}
    n = {w: rng.choice((5, 6, 30, 200, 5000)) for w in words}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert found(spelling_groups(df, limit=limit)) == grouped(n)


def test_hot_prefixes_are_cut_until_they_fit(spark):
    words = [("prefix" + a + b + c, 5) for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghij"]
    entries = prefix_entries(spark.createDataFrame(words, "word string, n long"), 50)
    assert max(r["count"] for r in entries.where("hi - lo > 1").groupBy("key").count().collect()) <= 50
    got = near_words(spark.createDataFrame(words, "word string, n long"), 50).collect()
    assert len(got) == 1000 and all(r.n_near == 27 for r in got)


def test_counts_and_deletions(spark):
    rng = random.Random(5)
    stems = ["wizardry", "wizardly", "Straßen", "straßen", "ÀÉÎõüÿ", "àéîõüÿ", "letters", "lettters", "short", "mañana"]
    rows = [(i % 150 if i % 7 else None, " ".join(rng.choice(stems) for _ in range(60)) + ("" if i % 3 else ", Wizardry×LETTERS")) for i in range(200)]
    rows += [(1, None), (2, ""), (None, None), (3, "x" * 30_000), (3, "x" * 30_000)] + [(9, "y" * 20_000)] * 5
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, word string")
    n = counted(rows)
    got = word_counts(df)
    assert {(r.word, r.n) for r in got.collect()} == set(n.items()) and len(n) > 10
    assert found(spelling_groups(got)) == grouped(n)


def test_empty_tables_and_other_columns(spark):
    none = spark.createDataFrame([], "word string, n long, key long, form string")
    assert spelling_groups(none).collect() == []
    assert word_counts(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    some = spark.createDataFrame([("abcdef", 50, 1, "q"), ("abcdeg", 5, 2, "r"), ("abcdeh", 50, 3, "s")], none.schema)
    assert found(spelling_groups(some)) == {("abcdef", None, "abcdef", 50, 2, None), ("abcdeg", "abcdef", "abcdef", 5, 2, 50), ("abcdeh", None, "abcdeh", 50, 2, None)}
