"""Every operator and stage on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from pyspark.sql import functions as F

from terrachron.llm import decontamination, hmm, lines, near_dup, packing, quality, sharding, substrings


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_near_duplicates(documents, no_documents):
    got = by_id(near_dup.near_duplicates(documents, k=4))
    assert sum(map(len, got.values())) == documents.count()
    assert [r.component_id for i in (1, 2, 3) for r in got[i]] == [1, 1, 1, 1]
    assert got[4][0].n_shingles == got[5][0].n_shingles == got[6][0].n_shingles == 0
    assert all(got[i][0].kept and got[i][0].component_id == i for i in (4, 5, 6, 7, 9, 10, 11))
    assert (got[8][0].component_id, got[8][0].kept) == (7, False)
    assert all(r.component_id is None and r.kept for r in got[None])
    assert near_dup.near_duplicates(no_documents).count() == 0
    left = near_dup.drop_near_duplicates(documents)
    assert left.columns == documents.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 4, 5, 6, 7, 9, 10, 11]


def test_lines(documents, no_documents):
    got = by_id(lines.line_report(documents))
    assert sum(map(len, got.values())) == documents.count()
    assert got[None][0].n_removed == 0 and got[1][0].n_removed == 1 and got[4][0].n_lines == 0
    assert got[7][0].n_removed == 0  # a line of one word
    stage = lines.without_repeated_lines(documents)
    assert stage.columns == documents.columns
    assert {r.doc_id for r in stage.collect()} >= {4, 5, 6, 7, 8, 9, 10, 11, None}
    assert lines.line_report(no_documents).count() == lines.without_repeated_lines(no_documents).count() == 0


def test_substrings(documents, no_documents):
    got = by_id(substrings.repeat_report(documents))
    assert sum(map(len, got.values())) == documents.count()
    assert got[4][0].n_bytes == 0 and got[4][0].text_crc32 is None and not got[9][0].changed
    assert [r.changed for r in got[2]] == [True, True]  # repeats of the row without id, which counts as the least
    assert substrings.without_repeats(documents).columns == documents.columns
    assert substrings.repeat_report(no_documents).count() == 0


def test_sharding(documents, no_documents):
    rows = sharding.assign_shards(documents).collect()
    assert len(rows) == documents.count()
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(24))
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (4, 5)} == {(8, 0)}
    assert sharding.assign_shards(no_documents).count() == 0


def test_packing(documents, no_documents):
    rows = packing.pack_documents(documents).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in documents.collect()}
    assert {r.doc_tokens for r in rows if r.doc_id in (4, 5)} == {1}
    assert packing.pack_documents(no_documents).count() == 0


def test_decontamination(spark, documents, no_documents):
    items = spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, None), (None, "lazy dog"), (3, "..."), (4, "word")], "item_id long, text string")
    got = by_id(decontamination.contamination(documents, items))
    assert (got[1][0].n_hit, got[1][0].n_items, got[1][0].contaminated) == (3, 1, True)
    assert (got[7][0].n_words, got[7][0].n_hit) == (1, 1) and got[4][0].n_words == 0 and not got[5][0].contaminated
    left = decontamination.decontaminate(documents, items)
    assert left.columns == documents.columns and {r.doc_id for r in left.collect()} == {4, 5, 6, 9, 10, 11, None}
    assert "fox" not in decontamination.cut_spans(documents.where("doc_id = 1"), items).first().text
    none = decontamination.contamination(documents, items.limit(0)).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, documents.count())
    assert decontamination.contamination(no_documents, items).count() == 0


def test_quality(documents, no_documents, labels):
    got = by_id(quality.quality_scores(documents, labels))
    assert sum(map(len, got.values())) == documents.count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for rows in got.values() for r in rows)
    assert got[4][0].score == got[5][0].score
    assert quality.keep_good(documents, labels).columns == documents.columns
    assert quality.quality_scores(no_documents, labels).count() == 0
    assert quality.quality_scores(documents, labels.limit(0)).select("score").distinct().count() == 1


def test_language_scores(documents, no_documents):
    got = by_id(hmm.language_scores(documents, rounds=1))
    assert sum(map(len, got.values())) == documents.count()
    assert got[4][0].n_tokens == got[5][0].n_tokens == got[6][0].n_tokens == 1
    assert all(r.score < 0 and r.base_score < 0 for rows in got.values() for r in rows)
    assert hmm.language_scores(no_documents).count() == 0
    held = documents.where("pmod(crc32(cast(doc_id as string)), 5) = 1")
    assert {r.n_known for r in hmm.language_scores(held).collect()} <= {0}
