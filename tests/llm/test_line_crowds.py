"""Lines that share a key and are no copies of each other."""

import random

from terrachron.llm import lines


def test_a_crowded_key_makes_no_rows_of_pairs(spark, monkeypatch):
    """Halves of the same words in another order pass all bounds: each two of a key were a row, with both texts."""
    rng = random.Random(7)
    head = " ".join(f"head{i}" for i in range(10))
    texts = []
    for _ in range(150):
        tail = [f"tail{i:02d}" for i in range(10)]
        rng.shuffle(tail)
        texts.append(f"{head} {' '.join(tail)}")
    # One word less at the end, or a letter: these are near.
    texts += [texts[3][:-1], texts[70][:-2] + "x"]
    normal = [" ".join(t.encode().translate(lines.NORMAL).decode().split()) for t in texts]
    asked, inner = [], lines.linked_components

    def counted(keys, facts_of, near, confirm, **others):
        def seen(pairs):
            asked.append(pairs.count())
            return confirm(pairs)

        return inner(keys, facts_of, near, seen, **others)

    monkeypatch.setattr(lines, "linked_components", counted)
    monkeypatch.setattr(lines, "TILE", 32)
    found = lines.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "_tc_removed").collect()
    assert sum(asked) <= 4 * len(texts)
    part, order = list(range(len(texts))), range(len(texts))
    for a in order:
        for b in order:
            if a < b and part[a] != part[b] and lines.similar(normal[a], normal[b], 0.9):
                part = [part[a] if p == part[b] else p for p in part]
    want = {a for a in order if any(part[b] == part[a] for b in range(a))}
    assert {150, 151} <= want and {r.doc_id for r in found if r._tc_removed} == want


def test_lines_are_looked_up_once(spark, monkeypatch):
    """Each comparison read all texts and joined all lines again."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.sample(words, 12)) for _ in range(40)]
    texts += [f"{t[:-1]}x" for t in texts] + [f"{texts[0]} {w}" for w in words[:30]]
    looked, inner = [], lines.small_side
    monkeypatch.setattr(lines, "small_side", lambda df, *limit: looked.append(df) or inner(df, *limit))
    found = lines.remove_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("_tc_removed > 0").count()
    assert len(looked) == 1 and found >= 40
