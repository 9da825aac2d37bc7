import os

from pyspark.sql import functions as F

from gleaner.engine import Engine, Options
from gleaner.operators import exact, reports
from gleaner.sources import folders
from gleaner.streaming import incremental


def tree(tmp_path):
    (tmp_path / "a/deep").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "skip").mkdir()
    for name, data in (("one", b"same" * 3000), ("a/two", b"same" * 3000), ("a/deep/three", b"x"), (".hidden/four", b"y"), ("skip/five", b"z"), ("empty", b"")):
        (tmp_path / name).write_bytes(data)
    os.link(tmp_path / "one", tmp_path / "a/linked")
    os.symlink("nowhere", tmp_path / "broken")
    return str(tmp_path)


def test_walk(spark, tmp_path):
    root = tree(tmp_path)
    entries, errors = folders.discover(spark, [root, root + "/none"], exclude_prefixes="skip")
    rows = {os.path.relpath(r.path, root): r for r in entries.collect()}
    assert set(rows) == {".", "one", "a", "a/two", "a/deep", "a/deep/three", "a/linked", "empty", "broken"}
    assert rows["a/deep/three"].depth == 3 and rows["one"].physical_key == rows["a/linked"].physical_key
    assert rows["broken"].kind == "Symlink" and rows["broken"].link_target == "nowhere"
    assert [(r.error, r.path) for r in errors.collect()] == [("NotFound", root + "/none")]
    everything, _ = folders.discover(spark, [root], include_hidden="true", include_symlink_entries="false")
    assert {os.path.relpath(r.path, root) for r in everything.collect()} >= {".hidden/four", "skip/five"}


def test_duplicates_of_real_files(spark, tmp_path):
    entries, _ = folders.discover(spark, [tree(tmp_path)])
    found = exact.confirmed_members(folders.with_content(entries)).collect()
    assert sorted(os.path.basename(r.path) for r in found) in (["one", "two"], ["linked", "two"])
    digests = {os.path.basename(r.path): r for r in folders.file_digests(entries.where("kind = 'File'")).collect()}
    assert digests["one"].full == digests["two"].full and digests["one"].partial != digests["one"].full
    assert digests["three"].partial == digests["three"].full


def test_duplicates_of_large_files(spark, tmp_path):
    size = (64 << 20) + 5000
    for name, at in (("a", 100), ("b", 100), ("middle", 32 << 20), ("other", 10)):
        with open(tmp_path / name, "wb") as f:
            f.truncate(size)
            f.seek(at)
            f.write(b"mark")
    for name in ("small1", "small2", "gone1", "gone2"):
        (tmp_path / name).write_bytes(b"abc" if name[0] == "s" else b"defg")
    engine = Engine.over_folders(spark, [str(tmp_path)], Options(excludes=()))
    assert {os.path.basename(r.path) for r in engine.scan("partial").collect()} == {"a", "b", "small1", "small2", "gone1", "gone2"}
    engine.entries = engine.entries.localCheckpoint()
    (tmp_path / "gone2").unlink()
    names = lambda df: {os.path.basename(r.path) for r in df.collect()}
    assert names(engine.scan("full")) == names(engine.scan("compared")) == names(engine.exact()) == {"a", "b", "small1", "small2"}
    assert [(os.path.basename(r.path), r.error) for r in engine.unread().collect()] == [("gone2", "NotFound")]
    (tmp_path / "b").write_bytes(b"\0" * size)
    assert not folders._same(str(tmp_path / "a"), str(tmp_path / "b")) and folders._same(str(tmp_path / "a"), str(tmp_path / "a"))


def test_incremental_digests(spark, tmp_path):
    schema = "physical_key string, size_bytes long, mtime_ns long, ctime_ns long, content string"
    rows = [(f"k{i}", i, i, None, f"text {i}") for i in range(6)]
    source, cache, at = (str(tmp_path / x) for x in ("in", "cache", "at"))
    for n in (3, 6):
        spark.createDataFrame(rows[:n], schema).write.mode("append").parquet(source)
        incremental.append_digests(spark.readStream.schema(schema).parquet(source), cache, at).awaitTermination(120)
    assert spark.read.parquet(cache).count() == 6
    assert incremental.current_digests(spark, cache).count() == 6


def test_first_seen_and_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    source = str(tmp_path / "events")
    events.write.parquet(source)
    stream = spark.readStream.schema(events.schema).parquet(source)
    for name, df in (("first", incremental.first_seen(stream, ["user_id"], "ts", "3650 days")), ("windows", incremental.windowed(stream, "ts", ["event_type"]))):
        query = df.writeStream.format("memory").queryName(name).outputMode("append" if name == "first" else "update").trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("first").count() == events.select("user_id").distinct().count()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").count().count()
    assert spark.table("windows").select("window", "event_type").distinct().count() == want


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "<b>"), (2, None)], "n int, t string")
    assert '"n" : 1' in reports.json_rows(df).collect()[0].json
    page = reports.html_page("T & T", [("rows", df)], 1)
    assert "&lt;b&gt;" in page and "More rows" in page and "T &amp; T" in page
    store = reports.SavedReports(str(tmp_path / "store"))
    store.save({"id": "a", "created_at": "2020", "groups": [{}, {}]})
    store.save({"id": "b", "created_at": "2021", "groups": [], "html": str(tmp_path / "gone.html")})
    store.save({"id": "c", "created_at": "2022", "groups": []})
    assert [r["id"] for r in store.list()] == ["c", "a"] and store.get("b") is None
    assert store.mark_verified("a", 1) == 1 and reports.match_percent(0.876) == 88


def test_streams_of_tables_in_folders(spark, tmp_path):
    """A table is streamed whole whether it is one file or a folder of several."""
    from gleaner.plans import records

    docs = spark.createDataFrame([(i, f"text {i}", 6) for i in range(40)], "doc_id long, text string, n_chars long")
    events = spark.createDataFrame([(i, i % 7) for i in range(40)], "event_id long, user_id long")
    events = events.select("event_id", "user_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id")).alias("ts"))
    for parts in (1, 4):
        at = str(tmp_path / f"in{parts}")
        for name, table in (("documents", docs), ("events", events)):
            table.repartition(parts).write.parquet(f"{at}/{name}.parquet")
        if parts == 1:
            for name in ("documents", "events"):
                folder = tmp_path / f"in1/{name}.parquet"
                next(folder.glob("part-*")).rename(tmp_path / "one")
                for left in folder.iterdir():
                    left.unlink()
                folder.rmdir()
                (tmp_path / "one").rename(folder)
        rows = records.QUERIES["stream_digests"](spark, at).collect()
        assert sorted(r.physical_key for r in rows) == sorted(f"ino:{i}" for i in range(40))
        assert sorted(r.user_id for r in records.QUERIES["stream_first_seen"](spark, at).collect()) == list(range(7))


def test_inventory_without_contents(spark):
    """What asks for no content joins none to its links, and members' inventory is a table of its own."""
    from gleaner.plans import review
    from gleaner.sources import inventory

    def joins(plan):
        below = [plan.children().apply(i) for i in range(plan.children().size())]
        return [plan] * (plan.nodeName() == "Join") + [j for p in below for j in joins(p)]

    docs = spark.createDataFrame([(0, "a"), (3, "a"), (6, None), (41, "b")], "doc_id long, text string")
    found = inventory.files(docs)
    rows = sorted(tuple(r) for r in found.select("size_bytes", "content", "physical_key").collect())
    assert rows == [(0, "", "ino:0"), (0, "", "ino:41"), (0, "", "ino:6"), (1, "a", "ino:0")]
    joined = joins(found.drop("content")._jdf.queryExecution().optimizedPlan())
    names = [j.output().apply(i).name() for j in joined for i in range(j.output().size())]
    assert names and not {"text", "content"} & set(names)
    whole, members = review._members(spark, "/root/testdata/sf0.001")
    assert "content" not in whole.columns and all("/inventory-" in f for f in whole.inputFiles())
    assert members.count() > 0
