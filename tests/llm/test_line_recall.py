"""Line deduplication against a plain all-pairs edit-similarity join, without any hash of lines."""

import random

import pytest

from terrachron.llm import lines


def near_copy(rng, words, kind):
    """words with one of them replaced, or with one typo; the edit similarity may be below 0.9."""
    out = list(words)
    i = rng.randrange(len(out))
    if kind == "word":
        out[i] = "".join(rng.choice("abcdefghij") for _ in range(len(out[i])))
    else:
        k = rng.randrange(len(out[i]))
        out[i] = out[i][:k] + rng.choice("klmnop") + out[i][k + 1 :]
    return out


@pytest.mark.parametrize("n", [5, 10, 15, 20, 50])
def test_near_copies_of_one_changed_word(spark, n):
    rng = random.Random(n)
    made = []
    for i in range(60):
        base = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(n)]
        made += [base, near_copy(rng, base, "word" if i % 2 else "typo")]
    text = [" ".join(w) for w in made]
    parent = list(range(len(text)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(text)):
        for j in range(i):
            if lines.similar(text[i], text[j], 0.9):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    want = {i: int(root(i) != i) for i in range(len(text))}
    got = {r.doc_id: r.n_removed for r in lines.line_report(spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")).collect()}
    assert sum(want.values()) > 20 and got == want
