"""Names, library records, manifests and packed tiles: values and edges."""

import math

import pytest
from pyspark.sql import functions as F

from terrachron.functions import names, numeric
from terrachron.operators import bundles, packs


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_part_of_town_needs_a_whole_word(spark):
    got = [one(spark, names.part_of_town(F.lit(t))) for t in ("Kemp Ward", "Warden", "NEIGHBORHOOD 3", "", None)]
    assert got == [True, False, True, False, None]


def test_micro_unit_is_korean_only(spark):
    got = [one(spark, names.micro_unit(F.lit(t), F.lit(c))) for t, c in (("중구", "KR"), ("Jung-gu", "KR"), ("Jung-gu", "JP"), ("Jungu", "KR"), (None, "KR"))]
    assert got == [True, True, False, False, False]


def test_hydronyms(spark):
    rows = spark.createDataFrame([(1, None, "river"), (2, "낙동  강", "river"), (3, "소양", "lake"), (4, "미명명 수계 3", "river"), (5, "Nile River", "river"), (6, "River", "river"), (7, "x", None)], "id long, name string, category string")
    aliases = spark.createDataFrame([("Nile", "나일")], "alias string, name string")
    got = {r["id"]: r["hydronym"] for r in bundles.hydronyms(rows, aliases, "name", "category").collect()}
    assert got == {1: "", 2: "낙동강", 3: "소양호", 4: "미명명 수계 3", 5: "나일강", 6: "River", 7: "x"}


def test_valid_names_edges(spark):
    good = ['{"en": {"common": "x"}}', '{"native": [{"language": "und", "common": "x"}], "ko": {"formal": "y", "aliases": []}}']
    bad = [None, "", "[]", "{}", '{"en": {}}', '{"en": {"common": "x", "other": "y"}}', '{"ko": {"aliases": ["a"]}}', '{"native": [{"language": "a b", "common": "x"}]}', '{"native": {}}']
    assert [one(spark, names.valid_names(F.lit(t))) for t in good + bad] == [True] * len(good) + [False] * len(bad)


def test_source_kind(spark):
    got = [one(spark, names.source_kind(F.lit(a), F.lit(b))) for a, b in (("gis", "user"), (None, " user "), ("odd", "user"), (None, None))]
    assert got == ["gis", "user", "unsupported", "unsupported"]


def test_python_round_is_exact(spark):
    values = [0.125, 2.675, 1.005, -0.375, 0.0, -0.0, 1e300, 5e-324, 2.5, 1234567.8901234567, None, math.inf, math.nan]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    for digits in (0, 2, 7, 9):
        got = {r["i"]: r["r"] for r in rows.select("i", numeric.exact_round(F.col("v"), digits).alias("r")).collect()}
        for i, v in enumerate(values):
            want = None if v is None or not math.isfinite(v) else round(v, digits)
            assert got[i] == want, (v, digits)


def test_reads_start_anew_at_gaps_and_spans(spark):
    rows = spark.createDataFrame([("a", 0, 10), ("a", 20, 10), ("a", 200, 10), ("b", 0, 90), ("b", 80, 30), ("b", 105, 10)], "shard string, offset long, length long")
    got = {(r["shard"], r["offset"]): r["start"] for r in packs.coalesced_reads(rows, gap=50, span=100).collect()}
    assert got == {("a", 0): 0, ("a", 20): 0, ("a", 200): 200, ("b", 0): 0, ("b", 80): 80, ("b", 105): 80}
    assert packs.coalesced_reads(rows.where("false")).collect() == []


@pytest.mark.parametrize("kind, want", [("bilinear", [4194304]), ("bicubic", [0, 4194304, 0]), ("lanczos", [0, 0, 4194304, 0, 0])])
def test_weights_of_an_equal_size_keep_the_pixel(spark, kind, want):
    got = one(spark, packs.resample_weights(F.lit(9), F.lit(9), F.lit(4), kind))
    kept = [w for w in got["weights"]]
    at = got["start"] + kept.index(4194304)
    assert at == 4 and sum(kept) == 4194304 and all(w in (0, 4194304) for w in kept) and len(kept) >= len(want)


def test_lanczos_against_its_formula(spark):
    size, out, i = 20, 7, 3
    scale = size / out
    centre = (i + 0.5) * scale
    sinc = lambda x: 1.0 if x == 0 else math.sin(math.pi * x) / (math.pi * x)
    start, stop = max(0, int(centre - 3 * scale + 0.5)), min(size, int(centre + 3 * scale + 0.5))
    values = [sinc(x) * sinc(x / 3) if -3 <= x < 3 else 0.0 for x in ((j - centre + 0.5) / scale for j in range(start, stop))]
    got = one(spark, packs.resample_weights(F.lit(size), F.lit(out), F.lit(i), "lanczos"))
    assert got["start"] == start and got["weights"] == [round(v / sum(values) * 4194304) for v in values]


def test_missing_neighbours_are_differences(spark):
    row = (0, 0, 3, 3, [1] * 9)
    tiles = spark.createDataFrame([row], "col int, row int, width int, height int, data array<int>")
    assert {r["side"] for r in packs.edge_mismatches(tiles, 1, 1).collect()} == set()
    assert {r["side"] for r in packs.edge_mismatches(tiles, 2, 2).collect()} == {"east", "south"}


def test_names_without_a_day(spark):
    rows = spark.createDataFrame([(1, None, 5, "a", ["a", "x"]), (1, 6, None, "b", ["b", "a"]), (2, 10, 20, "c", ["c"])], "entity_id long, lo long, hi long, name string, names array<string>")
    found = {r["entity_id"]: (r["name"], r["search_names"]) for r in bundles.names_at(rows, None).collect()}
    assert found == {1: ("b", ["a", "x", "b"]), 2: ("c", ["c"])}
    assert {r["entity_id"]: r["name"] for r in bundles.names_at(rows, 3).collect()} == {1: "a", 2: None}


def test_record_issues_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, object_id long, lo long, hi long, parent_id long")
    assert bundles.record_issues(none, none, none).collect() == []


def test_chains_count_rings_and_early_ends(spark):
    schema = "id long, next long, stage int, coordinates long, position long"
    ring = spark.createDataFrame([(1, 2, 1, 3, 0), (2, 1, 1, 4, 1), (3, None, None, 9, 2)], schema)
    assert tuple(bundles.chain_counts(ring).first()) == (2, 2, 7)
    line = [(1, 2, 1, 1), (2, 3, 1, 1), (3, None, 1, 1)]
    forwards = spark.createDataFrame([(*r, i) for i, r in enumerate(line)], schema)
    backwards = spark.createDataFrame([(*r, -i) for i, r in enumerate(line)], schema)
    assert tuple(bundles.chain_counts(forwards).first()) == (3, 1, 3)
    assert tuple(bundles.chain_counts(backwards).first()) == (3, 2, 3)
    assert tuple(bundles.chain_counts(ring.where("false")).first()) == (0, 0, 0)


def test_reused_payloads_of_null_shapes(spark):
    rows = spark.createDataFrame([(1, None), (2, "s")], "id long, shape string")
    assert {r["id"]: r["reused"] for r in bundles.reused_payloads(rows.where("id = 1"), rows, "id", "shape").collect()} == {1: True, 2: False}
