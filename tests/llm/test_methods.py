"""The parts of the methods that have no SQL, against plain versions: statistics, rules, url trees, placements, stages on edge rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrachron.llm import common, lines, packing, quality, sharding, substrings, urls

FOLDER = "/root/testdata/sf0.001"


def plain_statistics(text):
    data = (text or "").encode()
    words = re.findall(rb"[^ \t\n\v\f\r]+", data)
    if not words:
        return [0.0] * 17
    n, share = len(words), lambda chars: sum(b in chars for b in data) / len(data)
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 for b in data)
    rows = [x for x in data.split(b"\n") if x.strip()]
    triples = {(words[i], words[i + 1], words[i + 2]) for i in range(n - 2)}
    odd = set(b"0123456789!|#$%&*@^~=<>{}[]\\.,;:?\"'()-_/+")
    return [
        math.log1p(len(data)), math.log1p(n), sum(map(len, words)) / n, sum(65 <= b <= 90 for b in data) / max(1, letters), share(b"0123456789"), share(b"!"), share(b"|"), share(b"#$%&*@^~=<>{}[]\\"), share(b".,;:?"), sum(b >= 128 for b in data) / len(data),
        len(set(words)) / n, max(Counter(words).values()) / n, sum(words[i] == words[i + 1] for i in range(n - 1)) / n, len(triples) / (n - 2) if n > 2 else 1.0, n / len(rows), len(set(rows)) / len(rows), sum(all(b in odd for b in w) for w in words) / n,
    ]


def test_statistics_and_compiled_rules(spark):
    texts = [None, "", " \n", "A!", "é 12 |", "the the THE cat.\nthe cat\n\nthe cat", *(r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").limit(60).collect())]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = {((1, True, 2.0), (4, False, 0.2)): 1.5, ((13, False, 0.9),): -2.0, ((2, True, 4.0), (2, False, 6.0)): 0.75}
    got = {r.doc_id: r for r in quality.with_statistics(table).select("doc_id", "_tc_stats", quality.RuleModel(-0.25, rules).score().alias("score")).collect()}
    for i, t in enumerate(texts):
        want = plain_statistics(t)
        assert list(got[i]._tc_stats) == pytest.approx(want, rel=1e-12)
        total = -0.25 + sum(w for rule, w in rules.items() if all((want[f] > t) == above for f, above, t in rule))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-9)


def test_tree_paths():
    text = "Tree\n  If (feature 3 <= 0.5)\n   If (feature 3 <= 0.25)\n    Predict: 0.0\n   Else (feature 3 > 0.25)\n    Predict: 1.0\n  Else (feature 3 > 0.5)\n   Predict: 1.0\n"
    assert quality.tree_paths(text) == {((3, False, 0.5),), ((3, False, 0.25),), ((3, False, 0.5), (3, True, 0.25)), ((3, True, 0.5),)}


def plain_templates(rows, min_share, min_count, z):
    """rows: (host, path, label or None), one for each page. Host and path to the template."""
    of = {}
    for host, path, label in rows:
        n, known, bad = of.get((host, path), (0, 0, 0))
        of[host, path] = (n + 1, known + (label is not None), bad + (label or 0))
    parts = {k: re.sub("^/", "", k[1]).split("/") for k in of}
    template = dict.fromkeys(of, "")
    for level in range(max(map(len, parts.values()), default=0)):
        groups = defaultdict(lambda: defaultdict(list))
        for k in of:
            groups[k[0], template[k]][parts[k][level] if level < len(parts[k]) else None].append(k)
        for children in groups.values():
            sums = {at: [sum(of[k][i] for k in keys) for i in range(3)] for at, keys in children.items()}
            total = [sum(s[i] for s in sums.values()) for i in range(3)]
            for at, keys in children.items():
                if at is None:
                    continue
                n, known, bad = sums[at]
                others = total[1] - known
                literal = n >= min_count and n >= min_share * total[0]
                if literal and known and others:
                    p = (total[2] + 1) / (total[1] + 2)
                    literal = abs(bad / known - (total[2] - bad) / others) > z * math.sqrt(p * (1 - p) * (1 / known + 1 / others))
                for k in keys:
                    template[k] += f"/{at}" if literal else "/*"
    return of, template


def test_url_trees(spark):
    rng = random.Random(5)
    deep = "/d" * 9
    made = [(i, f"http://{rng.choice('ab')}.org{rng.choice(['', '', deep])}/{rng.choice(['news', 'spam', 'x' + str(rng.randrange(30))])}/{rng.choice(['p', 'q', str(rng.randrange(99))])}{rng.choice(['', '/z', '/'])}") for i in range(700)]
    bad = {u: int("spam" in u) ^ (rng.random() < 0.1) for _, u in made if rng.random() < 0.7}
    table = spark.createDataFrame(made, "page_id long, url string")
    got = {r.page_id: r for r in urls.judge_urls(table, rules=(), labels=spark.createDataFrame(list(bad.items()), "url string, bad int")).collect()}
    split = {i: (u.split("/")[2], u[len("http://a.org") :]) for i, u in made}
    of, template = plain_templates([(*split[i], bad.get(u)) for i, u in made], 0.02, 5, 2.0)
    add = lambda keys: [sum(of[k][i] for k in keys) for i in (1, 2)]
    known, wrong = add(of)
    base = (wrong + 1) / (known + 2)
    for i, _ in made:
        k = split[i]
        hl, hb = add([x for x in of if x[0] == k[0]])
        tl, tb = add([x for x in of if x[0] == k[0] and template[x] == template[k]])
        purity = (tb + 4 * (hb + 4 * base) / (hl + 4)) / (tl + 4)
        assert got[i].template == template[k] and got[i].purity == pytest.approx(purity, rel=1e-12)
        assert got[i].verdict == ("block" if purity >= 0.5 else "allow")
    assert len(set(template.values())) > 5


def test_deep_paths_are_walked_to_their_end(spark):
    """Good and bad paths that part at the seventh segment, beside a path of 3,000 segments and paths that fork late."""
    urls_of = [(i, f"http://h.org/a/b/c/d/e/f/{'spam' if i % 2 else 'news'}/{i}") for i in range(120)]
    urls_of += [(1000 + i, "http://h.org" + "/x" * 3000 + ("/y" if i % 3 else "/z")) for i in range(30)] + [(2000, "http://h.org" + "/w" * 500)]
    labels = spark.createDataFrame([(u, i % 2) for i, u in urls_of[:120]], "url string, bad int")
    got = {r.page_id: r for r in urls.judge_urls(spark.createDataFrame(urls_of, "page_id long, url string"), rules=(), labels=labels).collect()}
    assert all(got[i].verdict == ("block" if i % 2 else "allow") for i in range(120))
    assert {got[i].template for i in range(120)} == {"/a/b/c/d/e/f/spam/*", "/a/b/c/d/e/f/news/*"}
    assert {got[1000 + i].template for i in range(30)} == {"/x" * 3000 + "/y", "/x" * 3000 + "/z"}
    assert got[2000].template == "/*" * 500


def test_groups_are_placed_by_dot_products(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    shard = {r.doc_id: r.shard for r in sharding.assign_shards(docs, alone=2.0).collect()}
    of = defaultdict(list)
    for r in docs.select("doc_id", F.xxhash64("text", F.lit(0)).alias("g1"), F.xxhash64(F.lit(1), "text").alias("g2")).collect():
        of[r.g1, r.g2].append(r.doc_id)
    groups = sorted(of)
    size = np.array([[sum(len(texts[i].encode()) + 8 for i in of[g]), sum(len(texts[i].split()) for i in of[g]), len(of[g])] for g in groups], float)
    size /= size.sum(axis=0)
    turn, residual = groups[0][0] % 24, [[1 / 24] * 3 for _ in range(24)]
    for i in sorted(range(len(groups)), key=lambda i: -max(size[i])):
        dots = [sum(residual[(s + turn) % 24][d] * size[i][d] for d in range(3)) for s in range(24)]
        best = (shard[of[groups[i]][0]] - turn) % 24
        assert {shard[x] for x in of[groups[i]]} == {(best + turn) % 24} and dots[best] >= max(dots) - 1e-15
        for d in range(3):
            residual[(best + turn) % 24][d] -= size[i][d]


def test_large_groups_are_split_and_tasks_balance(spark):
    rows = [(i, "same " * 50 if i % 3 == 0 else f"text {i} " + "w " * (i % 40)) for i in range(6000)]
    found = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), task_groups=500).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    size = [r.b for r in found]
    assert len(found) == 24 and max(size) < 1.1 * sum(size) / 24 and sum(r.n for r in found) == 6000


def test_the_level_of_least_squares():
    rng = random.Random(7)
    levels, plain, size = packing.Levels(64), Counter(), 64
    for k in range(500):
        n = rng.randint(1, 63)
        squares = {}
        for h in [0, *(h for h in plain if plain[h] and h + n <= size)]:
            after = plain.copy()
            after[h] -= h > 0
            after[h + n] += h + n < size
            squares[h] = sum(c * c for c in after.values())
        before = levels.counts.copy()
        levels.place((k, 0, np.zeros(n, np.uint32), n))
        left = [h for h in range(1, size) if levels.counts[h] < before[h]]
        chosen = left[0] if left else 0
        assert squares[chosen] == min(squares.values())
        plain[chosen] -= chosen > 0
        plain[chosen + n] += chosen + n < size
        assert all(plain[h] == levels.counts[h] for h in range(1, size))


def test_rows_without_id_are_documents_of_their_own(spark):
    """Thousands of rows without doc_id, which share lines, take the work of as many with ids."""
    text = [f"a line that all of them share here\nown line number {'abcdefghij'[i % 10]} {i * 7919} of these texts\n" + " ".join(f"w{(i * 31 + j) % 9973}" for j in range(30)) for i in range(5000)]
    none = spark.createDataFrame([(None, t) for t in text], "doc_id long, text string").repartition(8)
    got = lines.line_report(none).collect()
    assert len(got) == 5000 and sum(r.n_removed > 0 for r in got) >= 4999
    passage = " ".join(f"p{j * 37 % 101}" for j in range(60))
    same = spark.createDataFrame([(None, f"{t} {passage}") for t in text[:2000]], "doc_id long, text string")
    assert sum(r.changed for r in substrings.repeat_report(same).collect()) == 1999


def test_stages_on_edge_rows(spark, documents, no_documents, labels, monkeypatch):
    import corpus_pipeline

    tables = {"labels": labels, "benchmark": spark.createDataFrame([(1, "lazy dog")], "item_id long, text string")}
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark, folder, name: tables[name])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, documents, "")
        assert out.columns == documents.columns and stage(spark, no_documents, "").count() == 0
        left = {r.doc_id for r in out.collect()}
        if name != "quality":
            assert {4, 5, 6, 7, 9, 10, 11} <= left
        if name == "decontamination":
            assert not left & {1, 2, 3} and None in left  # the row without text
    kept = quality.keep_good(documents, labels).collect()
    score = {r.doc_id: r.score for r in quality.quality_scores(documents, labels).collect()}
    assert {r.doc_id for r in kept} == {i for i, s in score.items() if s >= 0.5}


def test_broadcasts_are_limited_by_bytes(spark):
    rows = spark.range(1000).select(F.xxhash64("id").alias("key"))
    plan = lambda limit: spark.range(10).withColumn("key", F.col("id")).join(common.small_side(rows, limit), "key")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(1 << 20) and "BroadcastHashJoin" not in plan(100)


def test_crc_of_texts_is_the_usual_one(spark):
    row = sharding.assign_shards(spark.createDataFrame([(1, "é")], "doc_id long, text string")).first()
    assert row.text_crc32 == zlib.crc32("é".encode()) and row["size"] == 10
