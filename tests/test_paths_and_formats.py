"""Paths, formats and settings."""

import pytest
from pyspark.sql import functions as F

from gapweave import config
from gapweave.functions import scalar
from gapweave.operators import paths


def values(spark, rows, schema, *columns):
    return [r[0] if len(columns) == 1 else tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_prefixes(spark):
    names = ["/a/Skip/x.mp4", "/a/Skip_old/x.mp4", "/a/Skip", "/a/skip/x.mp4", "/b", None]
    rows = [(n,) for n in names]
    assert values(spark, rows, "n string", paths.is_under(F.col("n"), ["/a/Skip"])) == [True, False, True, False, False, None]
    assert values(spark, rows, "n string", paths.is_under(F.col("n"), ["/"]))[:5] == [False] * 5
    assert values(spark, rows, "n string", paths.is_under(F.col("n"), []))[:5] == [False] * 5
    assert values(spark, rows, "n string", paths.is_listed_under(F.col("n"), ["/"]))[:5] == [True] * 5
    assert values(spark, rows, "n string", paths.is_listed_under(F.col("n"), []))[:5] == [True] * 5
    assert values(spark, rows, "n string", paths.is_like_prefix(F.col("n"), "/a/Skip"))[:5] == [True, False, True, True, False]
    slashed = [("C:\\a\\x",), ("c:\\A\\b/y",), ("C:a",), ("C:\\a\\b",)]
    assert values(spark, slashed, "n string", paths.is_like_prefix(F.col("n"), "C:\\a\\b")) == [False, True, False, True]


def test_extensions(spark):
    rows = [("/a/B.MP4",), ("/a/x.d.ts",), ("/a/x.ts",), ("/a.mp4/x",), ("/a/.mp4",), ("/a/x.tar.mkv",), ("",), (None,)]
    assert values(spark, rows, "n string", scalar.extension(F.col("n"))) == ["mp4", "ts", "ts", "", "", "mkv", "", None]
    assert values(spark, rows, "n string", paths.has_extension(F.col("n"), ["mp4", "ts"])) == [True, False, True, False, False, False, False, None]


def test_directories(spark):
    rows = [("/a/b/c.mp4",), ("/c.mp4",), ("c.mp4",), ("/a//c",), ("//c",)]
    assert values(spark, rows, "n string", scalar.dirname(F.col("n"))) == ["/a/b", "/", "", "/a", "//"]
    counted = paths.files_per_directory(spark.createDataFrame([*rows, (None,)], "n string"), "n").collect()
    assert [tuple(r) for r in counted] == [("", 1), ("/", 1), ("//", 1), ("/a", 1), ("/a/b", 1)]


def test_settled_files(spark):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    rows = [("/v/a.mp4", "2024-01-01 10:59:59"), ("/v/b.mp4", "2024-01-01 11:00:00"), ("/x/c.mp4", "2023-01-01 00:00:00"), ("/v/d.txt", "2023-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "path string, t string").withColumn("modified", F.col("t").cast("timestamp"))
    assert [r.path for r in paths.importable(df, "path", "modified", ["mp4"], ["/x"], now).collect()] == ["/v/a.mp4"]


def test_sizes(spark):
    rows = [(1536,), (123456,), (0,), (1 << 50,), (None,), (1023,), (1 << 30,)]
    assert values(spark, rows, "n long", scalar.format_size(F.col("n"))) == ["1.50 KiB", "120.56 KiB", "0.00 B", "1024.00 TiB", "unknown", "1023.00 B", "1.00 GiB"]


def test_durations(spark):
    assert values(spark, [(42.9,), (600.0,), (90061.9,), (None,)], "n double", scalar.format_duration(F.col("n"))) == ["00:00:42", "00:10:00", "01:01:01", None]


def test_rates(spark):
    got = values(spark, [("25/1",), ("30000/1001",), ("0/0",), ("1000/1",), ("90000/1",), (None,), ("x",), ("240",), ("-1",)], "n string", scalar.parse_rate(F.col("n")))
    assert got[0] == 25.0 and got[1] == pytest.approx(29.97, abs=0.001) and got[2:] == [None, None, None, None, None, 240.0, None]


def test_resolution_and_names(spark):
    assert values(spark, [(640, 480), (0, 480), (None, 1)], "w int, h int", scalar.resolution(F.col("w"), F.col("h"))) == ["640x480", "unknown", "unknown"]
    assert values(spark, [("ok é",), (None,)], "n string", scalar.valid_text(F.col("n"))) == ["ok é", None]


def test_extension_lists(spark):
    assert values(spark, [("mp4, .MKV,,avi ,mp4",), ("",)], "n string", scalar.parse_extensions(F.col("n"))) == [["avi", "mkv", "mp4"], []]


@pytest.mark.parametrize("cpus,jobs", [(1, 1), (2, 1), (3, 1), (4, 2), (6, 4), (64, 4), (None, 1)])
def test_jobs(cpus, jobs):
    assert config.default_jobs(cpus) == jobs


def test_later_settings_win(tmp_path):
    a, b = tmp_path / "a.toml", tmp_path / "b.toml"
    a.write_text('[search]\nradius = 2.0\nstep = 3\nexclude_dirs = ["/x"]\n[profiles.mine]\nindexlength = 9\n')
    b.write_text("[search]\nradius = 1.5\n")
    settings = config.load(str(b), [a, tmp_path / "none.toml"])
    p = config.search_params(settings, "mine", {"step": 5, "radius": None})
    assert (p.radius, p.step, p.indexlength, p.exclude_dirs) == (1.5, 5, 9, ("/x",))
    assert config.search_params({}, "precise").verify_brightness and config.search_params({}).indexlength == 12
    assert config.search_params({"search": {"profile": "sensitive"}}).indexlength == 10


@pytest.mark.parametrize(
    "settings",
    [{"search": {"nosuch": 1}}, {"search": 3}, {"search": {"profile": "nosuch"}}, {"profiles": {"x": {"ignore_start": 1}}}, {"profiles": {"x": 1}}, {"search": {"exclude_dirs": "x"}}, {"search": {"brightness_correlation": 2}}, {"search": {"step": 0}}],
)
def test_bad_settings(settings):
    with pytest.raises(config.ConfigError):
        config.search_params(settings)


def test_sections_not_asked_for_are_not_checked():
    assert config.search_params({"import": {"nosuch": 1}}).step == 1


def test_missing_and_broken_files(tmp_path):
    with pytest.raises(config.ConfigError):
        config.load(str(tmp_path / "none.toml"), [])
    bad = tmp_path / "bad.toml"
    bad.write_text("x = [")
    with pytest.raises(config.ConfigError):
        config.load(None, [bad])
