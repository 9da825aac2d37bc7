"""The golden tree: files made by a rule, with a hard link, twins by head and tail, and twins by size."""

import pytest
from pyspark.sql import functions as F

from gleaner.operators import exact, keeper

SCHEMA = "root_id int, path string, kind string, depth int, size_bytes long, readonly boolean, mtime_s long, physical_key string, content binary"


def pattern(seed, n):
    return bytes((i % 251) ^ seed for i in range(n))


@pytest.fixture(scope="module")
def tree(spark):
    big, twin = pattern(1, 100_000), pattern(3, 20_000)
    other = twin[:10_000] + bytes(b ^ 255 for b in twin[10_000:10_010]) + twin[10_010:]
    files = {
        "/t/big_a": big, "/t/sub/big_b": big, "/t/sub/deep/big_c": big, "/t/small_a": pattern(2, 1000), "/t/small_b": pattern(2, 1000),
        "/t/head_tail_twin_1": twin, "/t/head_tail_twin_2": other, "/t/size_twin_1": pattern(4, 5000), "/t/size_twin_2": pattern(5, 5000),
        "/t/unique": pattern(6, 77_777), "/t/empty_1": b"", "/t/empty_2": b"", "/t/zlink_to_big": big,
    }
    rows = [(0, p, "File", p.count("/") - 1, len(c), False, 1, "big" if p in ("/t/big_a", "/t/zlink_to_big") else p, c) for p, c in files.items()]
    rows += [(0, p, "Directory", 1, None, False, 1, p, None) for p in ("/t/sub", "/t/sub/deep")]
    return spark.createDataFrame(rows, SCHEMA)


def test_counts(tree):
    r = exact.physical_summary(tree).first()
    assert (r.physical_files, r.hardlink_clusters, r.duplicate_paths_removed, r.empty_files, r.overlapping) == (10, 1, 1, 2, True)
    r = exact.exact_summary(tree).first()
    assert (r.eliminated_by_partial, r.eliminated_by_full, r.confirmed_groups, r.confirmed_files) == (2, 2, 2, 5)
    assert r.reclaimable == 2 * 100_000 + 1000
    r = exact.discovery_summary(tree).first()
    assert (r.files, r.directories, r.symlinks, r.others) == (13, 2, 0, 0)


def groups(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.group_id, set()).add(r.path)
    return sorted(map(sorted, out.values()))


WANT = sorted([["/t/big_a", "/t/sub/big_b", "/t/sub/deep/big_c"], ["/t/small_a", "/t/small_b"]])


@pytest.mark.parametrize("mode", ["always", "never", "cached_only"])
def test_trusted_equals_compared(tree, mode):
    members = exact.byte_compare(tree, exact.full_members(tree), mode, tree.limit(0))
    assert groups(members.where("verdict <> 'different'")) == WANT


def test_head_only_finds_the_same_groups(tree):
    assert groups(exact.full_members(tree, head_only=True)) == WANT


def test_a_poisoned_digest_is_found_out(tree):
    members = exact.full_members(tree).withColumn("group_id", F.lit("one"))
    verdicts = {r.verdict: r["count"] for r in exact.byte_compare(tree, members).groupBy("verdict").count().collect()}
    assert verdicts["different"] == 2


def test_empty_inventory(tree):
    none = tree.limit(0)
    assert exact.confirmed_members(none).count() == 0
    assert exact.exact_summary(none).first().reclaimable == 0


def test_keepers(spark, tree):
    members = exact.confirmed_members(tree)
    best = keeper.with_keeper(members, tree, "shortest-path").where("is_keeper")
    assert sorted(r.path for r in best.collect()) == ["/t/big_a", "/t/small_a"]
    assert keeper.strategy_named("NEWEST") == "newest" and keeper.strategy_named("?") == "smart"


@pytest.mark.parametrize(
    ("better", "worse"),
    [
        ("/home/u/Pictures/Holiday 2019 - Beach.jpg", "/tmp/x/IMG_copy.jpg"),
        ("/data/Artist - Album/Artist - Song.mp3", "/data/dump/8472934872.mp3"),
        ("/data/docs/report.pdf", "/data/docs/report (1).pdf"),
    ],
)
def test_scores_prefer_what_people_made(spark, better, worse):
    df = spark.createDataFrame([(better,), (worse,)], "path string").withColumn("depth", F.size(F.split("path", "/")) - 2)
    scores = {r.path: r.s for r in df.select("path", (keeper.path_score(F.col("path"), F.col("depth")) + keeper.name_score(F.col("path"))).alias("s")).collect()}
    assert scores[better] > scores[worse]
