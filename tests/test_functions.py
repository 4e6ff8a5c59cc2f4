from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corvault.functions import scores
from corvault.functions import text as T


def one(spark, f, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'string'}" for i, v in enumerate(values)))
    return df.select(f(*(F.col(c) for c in df.columns)).alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("Ａ　ｂ  \n\n\n  中 a 中\t\tx。。 ", "A b中a中x。"), ("", ""), (None, None), ("a\n \n \nb", "a\n\nb")],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, T.clean_text, raw) == clean


def test_traditional_pairs(spark):
    assert len(T.TRADITIONAL) == len(T.SIMPLIFIED)
    assert one(spark, T.for_grams, "國 家 經濟　會議") == "国家经济会议"


@pytest.mark.parametrize(("href", "safe"), [("a/b", True), ("HTTPS://x", True), ("javascript:x", False), ("\x01javascript:x", False), ("data:x", False), ("mailto:a", True)])
def test_safe_href(spark, href, safe):
    assert one(spark, T.safe_href, href) is safe


@pytest.mark.parametrize(("text", "noise"), [("x", None), ("Confidential", True), ("an ordinary line", None), ("y" * 201, False), (None, None)])
def test_noise(spark, text, noise):
    assert one(spark, T.noise, text) is noise


@pytest.mark.parametrize(("line", "skip"), [("目  录", True), ("References", True), ("Appendix B", True), ("abstract", False), ("The references are", False)])
def test_skip_section(spark, line, skip):
    assert one(spark, T.is_skip_section, line) is skip


@pytest.mark.parametrize(("path", "level"), [("MD/0Public/x", "public"), ("MD/1Restricted/x", "restricted"), ("MD/2Confidential/x", "confidential"), ("MD/other/x", "public")])
def test_level_of_path(spark, path, level):
    assert one(spark, T.level_of_path, path) == level
    assert one(spark, lambda p: T.level_of(F.lit(" 2Confidential"), p), path) == "confidential"


@pytest.mark.parametrize(("raw", "shown"), [(0.37, 0.0), (0.45, 0.36), (0.5, 0.46), (0.65, 0.67), (1.0, 1.0)])
def test_rooted_golden_values(spark, raw, shown):
    assert one(spark, scores.rooted, raw) == pytest.approx(shown, abs=0.006)


@pytest.mark.parametrize(
    ("vec", "overlap", "run", "length", "score"),
    [(0.1, 0.0, 80.0, 100.0, 0.94), (0.7, 1.0, 0.0, 100.0, 0.8), (0.5, 0.0, 0.0, 100.0, 0.275), (0.49, 1.0, 79.0, 100.0, 0.5), (0.9, 0.0, 80.0, 0.0, 0.9)],
)
def test_score_channels(spark, vec, overlap, run, length, score):
    assert one(spark, scores.combined, vec, overlap, run, length) == pytest.approx(score)


@pytest.mark.parametrize(("rerank", "fused"), [(None, 0.5), (0.6, 0.57), (0.19, 0.4), (0.2, 0.35), (0.59, 0.545)])
def test_fused(spark, rerank, fused):
    df = spark.createDataFrame([(0.5, rerank)], "s double, r double")
    assert df.select(scores.fused(F.col("s"), F.col("r")).alias("x")).first().x == pytest.approx(fused)


def test_bands(spark):
    rows = spark.createDataFrame([(0.8, True), (0.8, False), (0.65, False), (0.5, True), (0.4, True)], "a double, s boolean")
    assert [r.b for r in rows.select(scores.band(F.col("a"), F.col("s")).alias("b")).collect()] == ["high", "medium", "medium", "low", None]


def test_vector_codec(spark):
    df = spark.createDataFrame([([0.5, -1.0],)], "v array<double>").select(T.format_vector(F.col("v")).alias("s"))
    assert df.first().s == "[0.5000000,-1.0000000]"
    full = df.select(F.concat(F.lit(T.MARKS[0]), "s", F.lit(T.MARKS[1] + "public:0.5,restricted:x")).alias("t"))
    r = full.select(T.parse_vector(F.col("t")).alias("v"), T.parse_similarities(F.col("t")).alias("m")).first()
    assert r.v == [0.5, -1.0]
    assert r.m == {"public": 0.5, "restricted": None}
