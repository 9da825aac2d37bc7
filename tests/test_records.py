"""What touches files, pages, cancellation and pictures' bytes: effects that SQL can't tell."""

import json
import os
import struct
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import images, text
from gleaner.operators import control, quarantine, reports, review, state
from gleaner.operators.tables import dropped, written
from gleaner.sources import folders, ground_truth


def test_quarantine_moves_restores_and_purges(spark, tmp_path):
    tree, held = tmp_path / "tree", tmp_path / "held"
    for name in ("a/one.txt", "b/one.txt", "c.txt", "d.txt"):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(name)
    rows = [(str(tree / n), "quarantine", 5, "s1", r, "2024-01-01 00:00:00", p) for n, r, p in (
        ("a/one.txt", "exact-auto", "2024-02-01 00:00:00"), ("b/one.txt", "similar-auto", None), ("c.txt", "exact-auto", "2024-03-01 00:00:00"), ("gone.txt", "exact-auto", None))]
    rows.append((str(tree / "d.txt"), "keep", 5, "s1", "", "2024-01-01 00:00:00", None))
    plan = spark.createDataFrame(rows, "path string, action string, size_bytes long, session_id string, reason string, at string, purge_at string")
    journal = quarantine.Journal(spark, str(tmp_path / "journal"))
    journal.move(plan, str(held))
    assert sorted(p.relative_to(tree).as_posix() for p in tree.rglob("*.txt")) == ["d.txt"]
    assert len(list((held / "s1").iterdir())) == 3 and journal.active().count() == 3
    failed = journal.events().where("event = 'failed'").collect()
    assert [(os.path.basename(r.path), r.error) for r in failed] == [("gone.txt", "FileNotFoundError")]
    # The same again, as a repeated task would: nothing changes, and what is there is told as moved.
    again = {os.path.basename(r.path): r.event for r in quarantine.move(quarantine.planned(plan, str(held))).collect()}
    assert again == {"one.txt": "moved", "c.txt": "moved", "gone.txt": "failed"}

    (tree / "b" / "one.txt").write_text("new")
    journal.restore(1_704_000_000 + 86_400 * 10, reason="similar%")
    assert (tree / "b" / "one.txt").read_text() == "new" and journal.active().count() == 3
    journal.restore(1_704_000_000 + 86_400 * 10, ids=[r.id for r in journal.active().where("path like '%/c.txt'").collect()])
    assert (tree / "c.txt").read_text() == "c.txt" and journal.active().count() == 2
    journal.purge(1_707_000_000)  # 2024-02-03: one is due
    assert [r.reason for r in journal.active().collect()] == ["similar-auto"]
    journal.purge(1_707_000_001, session="other")
    assert journal.active().count() == 1
    journal.purge(1_707_000_002, everything=True)
    assert journal.active().count() == 0 and not list((held / "s1").iterdir())


def test_ground_truth_is_found(spark, tmp_path):
    plan = ground_truth.plan(spark)
    made = ground_truth.written_tree(plan, str(tmp_path / "tree")).collect()
    assert len(made) == 18 + 20 + 4 and all(os.path.getsize(tmp_path / "tree" / r.path) == r.size_bytes for r in made)
    from gleaner.engine import Engine, Options

    e = Engine.over_folders(spark, [str(tmp_path / "tree")], Options(excludes=()))
    found = {}
    for r in e.exact().collect():
        found.setdefault(r.group_id, set()).add(os.path.relpath(r.path, tmp_path / "tree"))
    want = {}
    for r in plan.where("kind = 'exact'").collect():
        want.setdefault(r.cluster, set()).add(r.path)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))
    assert {os.path.basename(r.path) for r in e.hygiene().collect()} >= {"Thumbs.db", "empty.txt", "~$lock.docx"}
    assert ground_truth.content(5, 13) == ground_truth.content(5, 20)[:13] != ground_truth.content(6, 13)


def test_pages_tell_all_or_say_that_they_dont(spark):
    rows = [(g, f"/x/<{g}>/{i}.txt", 10 * (g + 1), i == 0) for g in range(5) for i in range(4)]
    members = spark.createDataFrame(rows, "group_id long, path string, size_bytes long, is_keeper boolean")
    page = reports.groups_page(members, "exact", "es_MX", most=2, most_members=3)
    assert page.count("<ul>") == 2 and page.count("<li") == 6 and reports.words("es")["more"] in page and "15 archivos a limpiar" in page
    whole = reports.groups_page(members, "exact", most=None, most_members=None)
    assert whole.count("<li") == 20 and reports.words("en")["more"] not in whole and "<4>" not in whole
    items = spark.createDataFrame([("/a", "Empty Files", "Low", 0, "x", True), ("/b", "Cache Files", "High", 5, "y", False)], "path string, category string, risk string, size_bytes long, explanation string, can_clean boolean")
    both = reports.with_section(whole, reports.hygiene_section(items))
    assert both.endswith("</body></html>") and "50.0 %" in both and "/a" in both and "<td>/b</td>" not in both
    none = reports.groups_page(members.limit(0), "similar")
    assert reports.words("en")["none"] in none
    assert reports.with_section("no body", "more") == "no bodymore"


def test_a_cancelled_run_gives_nothing(spark):
    run, told = control.Run(spark), []
    run.told = lambda *x: told.append(x)
    slow = F.pandas_udf(lambda x: x.map(lambda i: time.sleep(0.5) or i), "long")

    def stop():
        while run.progress()[1] == 0:
            time.sleep(0.1)
        run.cancel()

    other = threading.Thread(target=stop)
    other.start()
    with pytest.raises(control.Interrupted), run.stage("full"):
        spark.range(400).select(slow("id").alias("x")).agg(F.sum("x")).collect()
    other.join()
    assert told == [("full", "started"), ("full", "cancelled")]
    with pytest.raises(control.Interrupted), run.stage("compared"):
        pass
    fresh = control.Run(spark)
    with pytest.raises(ZeroDivisionError), fresh.stage("sizes"):
        raise ZeroDivisionError
    with fresh.stage("partial"):
        assert spark.range(3).count() == 3
    assert fresh.events == [("sizes", "started"), ("sizes", "failed"), ("partial", "started"), ("partial", "ended")]


def test_places_are_put_into_jpegs(spark):
    plain = b"\xff\xd8\xff\xdb\x00\x04\x00\x01\xff\xd9"
    rows = [(1, plain, 41.5, -3.25), (2, plain, None, 1.0), (3, b"no jpeg", 1.0, 1.0), (4, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, content binary, lat double, lon double")
    got = {r.id: r.c for r in df.select("id", images.with_place(F.col("content"), F.col("lat"), F.col("lon")).alias("c")).collect()}
    assert bytes(got[2]) == plain and bytes(got[3]) == b"no jpeg" and got[4] is None
    made = bytes(got[1])
    assert made[:2] == plain[:2] and made.endswith(plain[2:])
    marker, payload = next(images.segments(made))
    assert marker == 0xE1 and payload[:6] == b"Exif\0\0" and len(images.gps_segment(1, 1)) == 4 + len(payload)
    tiff = payload[6:]
    assert images.exif(made).get("gps_latitude") is not None
    assert struct.unpack("<6I", tiff[80:104]) == (41, 1, 30, 1, 0, 100) and struct.unpack("<6I", tiff[104:128]) == (3, 1, 15, 1, 0, 100)
    again = spark.createDataFrame([(made, 2.0, 2.0)], "content binary, lat double, lon double")
    assert bytes(again.select(images.with_place(F.col("content"), F.col("lat"), F.col("lon")).alias("c")).first().c) == made


def test_quarantine_folders_are_remembered(tmp_path):
    known = config.QuarantineFolders(str(tmp_path / "conf" / "state.json"))
    assert known.list() == [] and known.last() is None
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        known.add(str(tmp_path / name))
        known.add(str(tmp_path / name))
    assert known.list() == [str(tmp_path / "a"), str(tmp_path / "b")] and known.last() == str(tmp_path / "b")
    (tmp_path / "b").rmdir()
    assert known.last() == str(tmp_path / "a")
    known.remove(str(tmp_path / "a"))
    assert known.list() == []
    known.path.write_text(json.dumps({"last_quarantine_dir": str(tmp_path / "a")}))
    assert known.list() == [str(tmp_path / "a")]
    assert config.belongs("/data/x/y", ["/other", "/data/x"]) == "/data/x" and config.belongs("/z", ["/data"]) is None


def test_ordinals_over_several_ranges(spark):
    rows = [(f"g{g}", 100 - g % 3, f"/a/{'b/' if i % 2 else ''}{i}") for g in range(9) for i in range(40 if g == 4 else 3)]
    members = spark.createDataFrame(rows, "group_id string, size_bytes long, path string")
    got = {(r.group_id, r.path): (r.group_no, r.member_no) for r in review.numbered(members).collect()}
    order = sorted({(s, g) for g, s, _ in rows})
    for g, s, p in rows:
        own = sorted((x.split("/"), x) for a, _, x in rows if a == g)
        assert got[g, p] == (order.index((s, g)) + 1, own.index((p.split("/"), p)) + 1)


def test_fresh_rows_leave_stand_in_identities_out(spark):
    schema = "path string, physical_key string, size_bytes long, mtime_ns long, ctime_ns long, digest string, was_cached boolean"
    df = spark.createDataFrame([("/a", "ino:1", 1, 1, 1, "x", False), ("/b", "path:/b", 1, 1, 1, "x", False), ("/c", "ino:2", 1, 1, 1, "x", True), ("/d", "ino:3", 1, 1, 1, None, False)], schema)
    assert [r.physical_key for r in state.fresh_rows(df, 9).collect()] == ["ino:1"]


def test_locked_files_and_names(spark, tmp_path):
    (tmp_path / "a").write_text("x")
    found, _ = folders.discover(spark, [str(tmp_path)])
    assert [(r.kind, r.locked) for r in folders.locked(found).where("kind = 'File'").collect()] == [("File", False)]
    df = spark.createDataFrame(pd.DataFrame({"p": ["/", "", "/a/b/", "/a/..", "x"]}))
    assert [r.n for r in df.select(text.folder_name(F.col("p")).alias("n")).collect()] == ["root", "root", "b", "unknown", "x"]


def test_written_tables_go(spark):
    df = written(spark.range(5), "gone")
    path = df.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and df.count() == 5
    dropped(df)
    dropped(df)
    assert not os.path.exists(path)


def test_sizes_beyond_64_bits_and_nearly_halves(spark, tmp_path):
    """Cubes of large keys, years of five digits, and quotients that doubles hold just beside a half."""
    from gleaner.plans import review as plans

    keys = [1, 999, 150_000, 2_097_151, 2_097_152, 8_999_999, 9_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    rows = {r.o_orderkey: r for r in plans.QUERIES["shown_values"](spark, str(tmp_path)).collect()}
    for k in keys[3:]:
        assert (rows[k].two, rows[k].one, rows[k].binary) == (f"{k**3 / 1e9:.2f} GB", f"{k**3 / 1e9:.1f} GB", f"{k**3 / 1024.0**4:.1f} TB")
    assert (rows[1].two, rows[9_000_000].clock[:4], rows[9_000_000].clock[0]) == ("1 B", "2661", "2")
    sizes = [1_015, 1_005, 3_375, 999_999, 1_145_000, 10**12 + 5 * 10**6]
    made = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", text.decimal_size(F.col("n")).alias("two"))
    unit = lambda n: next((n / x, u) for x, u in ((1e9, "GB"), (1e6, "MB"), (1e3, "KB")) if n >= x)
    assert {r.n: r.two for r in made.collect()} == {n: "{:.2f} {}".format(*unit(n)) for n in sizes}
