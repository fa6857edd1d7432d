"""The catalogue, sources, streams and the command line."""

import os

import pytest
from pyspark.sql import functions as F

from gapweave import cli
from gapweave.operators import catalog
from gapweave.operators.catalog import Catalogue
from gapweave.sources import media, tables
from gapweave.streaming import incremental

RESULT = "name string, fps double, duration double, index array<struct<frame:int,hash:double>>, brightness array<double>"


def result(spark, *rows):
    return spark.createDataFrame(rows, RESULT)


@pytest.fixture
def cat(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/cat").open()
    c.store(result(spark, ("/v/a.mkv", 25.0, 10.0, [(1, 1.0), (5, 4.0)], [1.0, 2.0]), ("/v/b.mkv", 25.0, 20.0, [(2, 2.0)], [3.0]), ("/w/c.mkv", 24.0, 30.0, [], [4.0])))
    return c


def ids(c):
    return {r.name: r.id for r in c.table("files").collect()}


def rows(c, table):
    return sorted(map(str, map(tuple, c.table(table).collect())))


def test_store_and_refresh(spark, cat):
    before = ids(cat)
    assert before == {"/v/a.mkv": 1, "/v/b.mkv": 2, "/w/c.mkv": 3}
    cat.store_media(spark.createDataFrame([(1, "mkv", "h264", 1, 1, 1), (2, "mkv", "h264", 1, 1, 1)], "filename_id long, extension string, codec string, width int, height int, file_size long"))
    cat.store(result(spark, ("/v/a.mkv", 30.0, 11.0, [(9, 9.0)], [9.0]), ("/v/new.mkv", 1.0, 1.0, [], [])))
    assert ids(cat) == before | {"/v/new.mkv": 4}
    assert rows(cat, "hashes") == ["(1, 9, 9.0)", "(2, 2, 2.0)"]
    assert [r.filename_id for r in cat.table("media_info").collect()] == [2]
    cat.store(result(spark, ("/v/b.mkv", 30.0, 11.0, [], None)))
    assert rows(cat, "hashes") == ["(1, 9, 9.0)"]


def test_failures_change_nothing(spark, cat):
    before = {t: rows(cat, t) for t in ("files", "hashes", "brightness")}
    bad = result(spark, ("/v/a.mkv", 1.0, 1.0, [(1, 1.0)], [1.0])).withColumn("brightness", F.array(F.raise_error(F.lit("stop")).cast("double")))
    with pytest.raises(Exception, match="stop"):
        cat.store(bad)
    assert {t: rows(cat, t) for t in before} == before
    folder = cat.folder.replace("file://", "")
    left = len(os.listdir(f"{folder}/tables"))
    with pytest.raises(RuntimeError):
        cat.transaction(lambda c: (_ for _ in ()).throw(RuntimeError("no")))
    assert len(os.listdir(f"{folder}/tables")) == left


def test_of_two_writers_one_fails(spark, cat, monkeypatch):
    version = cat._manifest()
    other = Catalogue(spark, cat.folder)
    other.commit({"whitelist": spark.createDataFrame([(1, 2)], "id1 long, id2 long")})
    monkeypatch.setattr(cat, "_manifest", lambda: version)
    with pytest.raises(RuntimeError, match="meanwhile"):
        cat.commit({"whitelist": spark.createDataFrame([(1, 3)], "id1 long, id2 long")})
    assert rows(other, "whitelist") == ["(1, 2)"]


def test_whitelist(cat):
    assert [tuple(r) for r in cat.whitelist(["/v/b.mkv", "/v/a.mkv", "/nosuch"]).collect()] == [(1, 2)]
    assert cat.whitelist(["/v/b.mkv", "/v/a.mkv"]).count() == 0
    assert cat.whitelist(["/v/b.mkv"]).count() == 0
    assert rows(cat, "whitelist") == ["(1, 2)"]


def test_deleting_by_path(cat):
    cat.whitelist(["/v/a.mkv", "/v/b.mkv", "/w/c.mkv"])
    assert sorted(r.name for r in cat.delete_under("/v").collect()) == ["/v/a.mkv", "/v/b.mkv"]
    assert len(ids(cat)) == 3
    cat.delete_under("/v", delete=True)
    assert ids(cat) == {"/w/c.mkv": 3} and rows(cat, "hashes") == [] and rows(cat, "whitelist") == [] and rows(cat, "brightness") == ["(3, [4.0])"]


def test_purge_is_dry_unless_told(spark, cat):
    readable = spark.createDataFrame([("/v/a.mkv",)], "name string")
    cat.commit({"whitelist": spark.createDataFrame([(1, 99)], "id1 long, id2 long")})
    assert cat.purge(readable).count() == 2 and len(ids(cat)) == 3 and rows(cat, "whitelist") == ["(1, 99)"]
    cat.purge(readable, delete=True)
    assert ids(cat) == {"/v/a.mkv": 1}


def test_tidy_keeps_files_without_hashes(spark, cat):
    cat.commit({"hashes": cat.table("hashes").unionByName(spark.createDataFrame([(77, 1, 1.0)], "filename_id long, frame int, hash double"))})
    cat.tidy()
    assert len(ids(cat)) == 3 and len(rows(cat, "brightness")) == 3 and len(rows(cat, "hashes")) == 3


def test_vacuum(cat):
    cat.delete_under("/v", delete=True)
    before = {t: rows(cat, t) for t in ("files", "brightness", "metadata")}
    cat.vacuum()
    folder = cat.folder.replace("file://", "")
    assert len([f for f in os.listdir(f"{folder}/manifests") if not f.startswith(".")]) == 1 and len(os.listdir(f"{folder}/tables")) == 6
    assert {t: rows(cat, t) for t in before} == before


def test_hash_methods(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/m").open("full-frame")
    assert {r.key: r.value for r in c.table("metadata").collect()}["extrema_distance_seconds"] == "10"
    c.open()
    with pytest.raises(ValueError):
        c.open("legacy-center")
    with pytest.raises(ValueError):
        Catalogue(spark, f"file://{tmp_path}/n").open("nosuch")
    c.commit({"metadata": c.table("metadata").withColumn("value", F.when(F.col("key") == "hash_method_version", "9").otherwise(F.col("value")))})
    with pytest.raises(ValueError):
        c.open()
    old = Catalogue(spark, f"file://{tmp_path}/old")
    old.commit({"files": spark.createDataFrame([(1, "/a", 1.0, 1.0)], "id long, name string, fps double, duration double")})
    with pytest.raises(ValueError):
        old.open("full-frame")
    assert len(ids(old.open())) == 1


def test_upsert_functions(spark):
    files = spark.createDataFrame([(5, "a", 1.0, 1.0), (9, "b", 1.0, 1.0)], "id long, name string, fps double, duration double")
    new = spark.createDataFrame([("b", 2.0, 2.0), ("d", 3.0, 3.0), ("c", 4.0, 4.0), ("c", 4.0, 4.0), (None, 1.0, 1.0)], "name string, fps double, duration double")
    assert sorted(map(tuple, catalog.upsert_by_name(files, new).collect())) == [(5, "a", 1.0, 1.0), (9, "b", 2.0, 2.0), (10, "c", 4.0, 4.0), (11, "d", 3.0, 3.0)]
    assert catalog.upsert_by_name(files.where("false"), new.where("name = 'd'")).first().id == 1


def test_scan(spark, tmp_path):
    for name in ("a.mp4", "b.txt", "c.d.ts", "skip/d.mp4", "skip_old/e.MP4", "new.mp4"):
        f = tmp_path / name
        f.parent.mkdir(exist_ok=True)
        f.write_bytes(b"xyz")
        if name != "new.mp4":
            os.utime(f, (1_600_000_000, 1_600_000_000))
    out = media.scan_files(spark, str(tmp_path), ["mp4", "ts"], [str(tmp_path / "skip")]).collect()
    assert sorted(r.path for r in out) == sorted(str(tmp_path / n) for n in ("a.mp4", "skip_old/e.MP4")) and {r.size for r in out} == {3}


def test_probe_runs(spark):
    files = spark.createDataFrame([("one",)], "path string")
    assert media.run_probe(files, command=["echo", "{}"]).first().json.startswith("{}")
    assert media.run_probe(files, command=["false"]).first().error == "exit code 1"
    assert media.run_probe(files, command=["nosuch-program"]).first().error == "probe program not found"
    assert media.run_probe(files, command=["sleep", "5", "#"], seconds=1).first().error is not None
    assert media.frame_brightness(files, "full-frame", 2, 2, program="nosuch-program").count() == 0


def test_decoded_frames(spark, tmp_path):
    script = tmp_path / "decode"
    script.write_text("#!/bin/sh\nprintf '\\001\\002\\003\\001\\002\\003\\004\\004\\004\\004\\004\\004\\007'\n")
    script.chmod(0o755)
    out = media.frame_brightness(spark.createDataFrame([("v",)], "path string"), "full-frame", 2, 1, program=str(script))
    assert [tuple(r) for r in out.collect()] == [("v", 0, 2.0), ("v", 1, 4.0)]


def test_frames_of_their_own_size_and_failures(spark, tmp_path):
    script = tmp_path / "decode"
    script.write_text("#!/bin/sh\ncase \"$*\" in *bad*) echo broken >&2; printf 'P6\\n1 1\\n255\\nabc'; exit 3;; *none*) exit 0;; esac\n"
                      "printf 'P6\\n2 1\\n255\\n\\001\\002\\003\\001\\002\\003P6\\n# note\\n1 1\\n255\\n\\004\\004\\007'\n")
    script.chmod(0o755)
    files = spark.createDataFrame([("good",), ("bad",), ("none",)], "path string")
    out = {(r.path, r.frame): (r.value, r.error) for r in media.decode_frames(files, "legacy-center", program=str(script)).collect()}
    assert out == {("good", 0): (2.0, None), ("good", 1): (5.0, None), ("bad", 0): (98.0, None), ("bad", None): (None, "broken"), ("none", None): (None, "no frames")}
    missing = media.decode_frames(files.limit(1), "legacy-center", program="nosuch-program").collect()
    assert [r.error for r in missing] == ["decoder not found"]


def test_import_and_report(spark, tmp_path, monkeypatch, capsys):
    """The recorded method is used, each file is decoded once, failures are told, and results get their media facts."""
    log = tmp_path / "log"
    (tmp_path / "probe").write_text(
        "#!/bin/sh\nfor f; do :; done\ncase \"$f\" in *bad*) echo broken >&2; exit 1;; *slow*) r=1/20;; *) r=1/1;; esac\n"
        'echo "{\\"streams\\": [{\\"codec_type\\": \\"video\\", \\"codec_name\\": \\"h264\\", \\"width\\": 4, \\"height\\": 2, \\"avg_frame_rate\\": \\"$r\\"}], \\"format\\": {\\"duration\\": \\"60\\"}}"\n'
    )
    frames = "".join(f"printf 'P6\\n1 1\\n255\\n\\{v:03o}\\{v:03o}\\{v:03o}'\n" for v in [1, 9, 1] * 1 + [1] * 12 + [8, 1] + [1] * 14 + [7, 1])
    (tmp_path / "decode").write_text(f'#!/bin/sh\necho "$*" >> {log}\n{frames}')
    for n in ("probe", "decode"):
        (tmp_path / n).chmod(0o755)
    monkeypatch.setattr(media, "PROBE", [str(tmp_path / "probe")])
    monkeypatch.setattr(media, "DECODER", [str(tmp_path / "decode")])
    (tmp_path / "films").mkdir()
    for n in ("a.mp4", "b.mp4", "bad.mp4", "slow.mp4"):
        (tmp_path / "films" / n).write_bytes(b"12345")
        os.utime(tmp_path / "films" / n, (1_600_000_000, 1_600_000_000))
    folder = f"file://{tmp_path}/cat"
    Catalogue(spark, folder).open("full-frame")
    assert cli.main([folder, "--dir", str(tmp_path / "films"), "--numjobs", "2"], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[-1] == "4 scanned, 0 known, 4 queued, 2 imported, 2 failed" and any("bad.mp4: broken" in x for x in said) and any("slow.mp4: frame rate too low" in x for x in said)
    decoded = log.read_text().splitlines()
    assert len(decoded) == 2 and all("scale=128:72:flags=fast_bilinear -f" in x for x in decoded)
    c = Catalogue(spark, folder)
    assert sorted((r.frame, r.hash) for r in c.table("hashes").collect()) == [(1, 1.0), (1, 1.0), (15, 14.0), (15, 14.0), (31, 16.0), (31, 16.0)]
    assert cli.main([folder, "--dir", str(tmp_path / "films")], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == "4 scanned, 2 known, 2 queued, 0 imported, 2 failed"
    saved = spark.createDataFrame([(1, r.id, r.name, 1.0, 60.0, 0.0) for r in c.table("files").collect()], tables.SAVED)
    tables.write_saved(saved, f"{tmp_path}/res")
    for counts in ("0 at hand, 2 probed, 2 stored", "2 at hand, 0 probed, 0 stored"):
        cli.main([folder, "--searchres", f"{tmp_path}/res"], spark)
        said = capsys.readouterr().out
        assert counts in said and said.count("codec=h264 resolution=4x2 size=5.00 B") == 2


def test_saved_results(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, "/é", 25.0, None, 3.0)], tables.SAVED)
    tables.write_saved(df, f"{tmp_path}/s")
    assert tables.read_saved(spark, f"{tmp_path}/s").collect() == df.collect()
    (tmp_path / "odd.json").write_text('{"group": 1, "!!python/object": "os.system", "name": 5}\nnot json\n')
    assert [r.group for r in tables.read_saved(spark, f"{tmp_path}/odd.json").collect()] == [1, None]


def test_stream_import(spark, tmp_path):
    c = Catalogue(spark, f"file://{tmp_path}/cat").open()
    value = [0, 1, 0, 0, 2, 0, 0]

    def land(names):
        rows = [(n, i, float(v), 1.0, None) for n in names for i, v in enumerate(value)]
        spark.createDataFrame(rows, incremental.FRAMES).write.mode("append").parquet(f"{tmp_path}/in")

    for names in (["/a", "/b"], ["/c"]):
        land(names)
        incremental.import_stream(spark, f"{tmp_path}/in", c, f"{tmp_path}/ck", peak_seconds=1).awaitTermination()
    assert set(ids(c)) == {"/a", "/b", "/c"}
    assert {(r.frame, r.hash) for r in c.table("hashes").collect()} == {(1, 1.0), (4, 3.0)} and c.table("hashes").count() == 6
    assert c.table("files").first().duration == 7.0


def test_event_counts_of_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-02 02:00:00", "b"), (None, "b")], "t string, kind string").select(F.col("t").cast("timestamp").alias("ts"), "kind")
    rows.write.parquet(f"{tmp_path}/e")
    want = sorted(map(tuple, incremental.event_counts(rows, "ts", "kind").collect()))
    q = incremental.event_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/e"), "ts", "kind").writeStream.outputMode("complete").format("memory").queryName("counted").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counted").collect())) == want and len(want) == 2


def test_command_line(spark, tmp_path, capsys, cat):
    folder = cat.folder
    assert cli.main([folder, "--list-db-files"], spark) == 0
    assert capsys.readouterr().out.split() == ["/v/a.mkv", "/v/b.mkv", "/w/c.mkv"]
    cli.main([folder, "--list-db-dirs", "--list-db-path", "/v"], spark)
    assert capsys.readouterr().out == "     2 /v\n"
    cli.main([folder, "--whitelist", "/v/a.mkv", "/v/b.mkv"], spark)
    assert capsys.readouterr().out == "whitelisted 1 and 2\n"
    cli.main([folder, "--delete-db-path", "/w"], spark)
    assert len(ids(cat)) == 3
    cli.main([folder, "--search", "--searchres", f"{tmp_path}/res"], spark)
    cli.main([folder, "--searchres", f"{tmp_path}/res"], spark)
    cli.main([folder, "--purge", "--delete", "--tidy", "--vacuum"], spark)
    assert ids(cat) == {}
    (tmp_path / "bad.toml").write_text("[search]\nnosuch = 1\n")
    assert cli.main([folder, "--search", "--config", f"{tmp_path}/bad.toml"], spark) == 2
