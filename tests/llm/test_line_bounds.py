"""Bounds that spare the table of an edit distance lose no similar pair."""

import random

from terrachron.llm import lines


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_bounds_agree_with_the_table():
    rng = random.Random(11)
    for k in range(400):
        a = "".join(rng.choice("abde é가") for _ in range(rng.randrange(60)))
        b = list(a)
        for _ in range(rng.randrange(12)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "é", "ab"])
        if k % 5 == 0:
            rng.shuffle(b)
        b = "".join(b)
        d = plain(a, b)
        assert lines.edit_distance(a, b) == d
        for most in (0, 3.5, d - 1, d, d + 1):
            assert (lines.edit_distance(a, b, most) <= most) == (d <= most)
        for share in (0.7, 0.9):
            assert lines.similar(a, b, share) == (d <= (1 - share) * max(len(a), len(b)))


def test_other_texts_of_equal_letters_need_no_table(monkeypatch):
    """Halves of equal letters in another order: tens of thousands of such pairs took most of the time on a table of near copies."""
    rng = random.Random(3)
    words = [rng.choice(["onthe", "reand", "inthis", "ofere"]) for _ in range(200)]
    monkeypatch.setattr(lines, "edit_distance", lambda *_: 1 / 0)
    letters = list("".join(words[100:]))
    rng.shuffle(letters)
    first = " ".join(words[:100])
    assert not lines.similar(first + "".join(words[100:]), first + "".join(letters), 0.9)


def test_other_texts_are_told_by_their_first_words(monkeypatch):
    """The whole table was made for each two texts of the same words in another order."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    inner, columns = lines._table, []
    monkeypatch.setattr(lines, "_table", lambda a, b, *others: columns.append(len(b)) or inner(a, b, *others))
    for _ in range(10):
        a, b = " ".join(words), " ".join(rng.sample(words, 60))
        columns.clear()
        assert plain(a, b) > 0.1 * len(a) and lines.edit_distance(a, b, 0.1 * len(a)) > 0.1 * len(a)
        assert sum(columns) < len(b) / 2
        # One word moved to the end is near, and needs no table where it alone lies apart.
        c = " ".join([*words[:20], *words[21:], words[20]])
        assert lines.similar(a, c, 0.9) == (plain(a, c) <= (1 - 0.9) * len(a))
    monkeypatch.setattr(lines, "_table", lambda *_: 1 / 0)
    assert lines.similar("x".join(words), "x".join([*words[:20], "other", *words[21:]]), 0.9)


def test_long_texts_agree_with_the_table():
    rng = random.Random(12)
    for k in range(60):
        a = "".join(rng.choice("abcde fgh") for _ in range(rng.randrange(100, 240)))
        b = list(a)
        for _ in range(rng.randrange(30)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "ab"])
        b = "".join(b[40:] + b[:40] if k % 4 == 0 else b)
        d, most = plain(a, b), 0.1 * max(len(a), len(b))
        assert (lines.edit_distance(a, b, most) <= most) == (d <= most)
        for limit in (d - 1, d, d + 1):
            assert (lines.edit_distance(a, b, limit) <= limit) == (d <= limit)
