"""Queries over pictures' facts, caches, plans and reports, a folder walk and streams.

Inputs that the tables don't have (facts of pictures, cached rows, events of a journal) are
arithmetic on a table's ids, written once as SQL expressions that both engines read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from gleaner import config
from gleaner.functions import bits, images, text
from gleaner.functions import dictionaries as D
from gleaner.operators import exact, hygiene, protection, reports, review, similar, state
from gleaner.operators.tables import shared_dir, written
from gleaner.plans import files as FQ
from gleaner.plans import review as RQ
from gleaner.plans.files import LOW_EXT, NAME, PARENT, REPORT, _holds, _list, _q, _with
from gleaner.sources import folders, ground_truth
from gleaner.sources.inventory import NOW, entries
from gleaner.streaming import incremental

#: Facts of pictures by ``doc_id``, four to a cluster.
PICTURES = """
  doc_id AS id, doc_id - doc_id % 4 AS group_id,
  CASE doc_id % 3 WHEN 0 THEN '/data/Pictures/' WHEN 1 THEN '/home/u/pictures/' ELSE '/srv/downloads/' END ||
  CASE doc_id % 13 WHEN 0 THEN 'IMG_' || doc_id || '.jpg' WHEN 1 THEN 'img-20200101-wa000' || doc_id || '.jpg' WHEN 2 THEN 'received_' || doc_id
    WHEN 3 THEN 'FB_IMG_' || doc_id || '.jpg' WHEN 4 THEN 'snapchat-' || doc_id || '.jpg' WHEN 5 THEN 'photo_' || doc_id || '@x.jpg'
    WHEN 6 THEN 'holiday copy ' || doc_id || '.jpg'
    WHEN 7 THEN 'image.jpg' WHEN 8 THEN 'Screenshot ' || doc_id || '.png' WHEN 9 THEN '12345678' || doc_id || '.jpg'
    WHEN 10 THEN 'DSC_' || doc_id || '.CR2'
    WHEN 11 THEN 'plain' || doc_id || '_v2.png' ELSE 'plain.jpeg' END AS path,
  CAST(640 + doc_id % 5 * 320 AS INT) AS width, CAST(480 + doc_id % 4 * 200 AS INT) AS height, 1000 + doc_id * 7919 % 500000 AS size_bytes,
  1600163000 + doc_id % 10 * 200 AS mtime_s, CASE WHEN doc_id % 6 <> 0 THEN 1500000000 + doc_id * 31 % 1000 END AS birth_s,
  doc_id % 17 = 0 AS truncated,
  CASE WHEN doc_id % 5 <> 0 THEN '2020:09:15 10:00:00' END AS date_time_original,
  CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '2021:01:01 00:00:00' ELSE '2020:09:15 10:00:00' END AS date_time,
  doc_id % 8 = 0 AS compressed_twice, doc_id % 19 = 0 AS history, doc_id % 3 = 0 AS maker_note, CASE WHEN doc_id % 4 <> 0 THEN 'Canon' END AS make,
  CASE WHEN doc_id % 6 <> 1 THEN 'EOS' END AS model, doc_id % 9 = 0 AS gps,
  CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'Adobe Photoshop 22' WHEN 3 THEN 'iOS 14' WHEN 4 THEN 'Firmware 1.0'
  ELSE 'GIMP for Android' END AS software,
  doc_id % 2 = 0 AS color_space, doc_id % 11 <> 0 AS any_exif"""

#: Cached fingerprints of files by their times: of two detectors and versions, some failed, some stale.
PRINTS = """
  physical_key, size_bytes, mtime_ns + CASE WHEN mtime_ns % 1000 % 7 = 0 THEN 1 ELSE 0 END AS mtime_ns, ctime_ns,
  CASE WHEN mtime_ns % 1000 % 5 = 0 THEN 'text-simhash' ELSE 'image-phash' END AS detector, CASE WHEN mtime_ns % 1000 % 3 = 0 THEN 'full'
  ELSE 'mirror' END AS params,
  CASE WHEN mtime_ns % 1000 % 11 = 0 THEN 0 ELSE 1 END AS algo_version, CASE WHEN mtime_ns % 1000 % 4 <> 0 THEN 'print of ' || path END AS data,
  CASE WHEN mtime_ns % 1000 % 4 = 0 THEN 'degenerate hash' END AS error, 1700000000 + mtime_ns % 1000 AS created_at"""

#: A journal's events: all were moved, some restored or purged since, some of these failed to.
EVENT = ("CASE WHEN mtime_ns % 1000 % 5 = 0 THEN 'restored' WHEN mtime_ns % 1000 % 7 = 0 THEN 'purged' ELSE 'failed' END AS event", "1700000001 + mtime_ns % 1000 AS moment")


def _pictures(spark, sf_dir):
    return _with_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), PICTURES)


def _with_columns(df, listed: str):
    """The columns that SQL expressions make of ``df``."""
    return df.sparkSession.sql(f"SELECT {listed} FROM {{t}}", t=df)


def _scores(spark, sf_dir):
    parts = ("content", "exif", "filename", "path_score", "fs", "total")
    return images.keeper_scores(_pictures(spark, sf_dir)).select("id", "group_id", *[F.round(c, 6).alias(c) for c in parts])


def _metadata(spark, sf_dir):
    p = _pictures(spark, sf_dir)
    made = images.metadata((F.col("width") / 2).cast("int"), (F.col("height") / 2).cast("int"), F.col("width"), F.col("height"), F.struct("make", "model"))
    get = lambda x, kind: F.get_json_object("j", f"$.{x}").cast(kind).alias(x.replace("exif.", ""))
    return p.select("id", made.alias("j")).select(
        "id", get("width", "int"), get("orig_height", "int"), get("min_side", "int"), F.round(get("aspect_ratio", "double"), 6).alias("aspect_ratio"),
        F.round(get("megapixels", "double"), 6).alias("megapixels"), get("exif.make", "string"), get("exif.model", "string"), get("fingerprint_algo_version", "int"),
    )


def _varied(spark, sf_dir):
    """Classes of fingerprints that bring a variant of theirs along, and the distance that a size allows."""
    prints = RQ._prints(spark, sf_dir)
    turned = F.struct(F.col("p").bitwiseXOR(F.lit(15)).alias("p"), F.col("d").bitwiseXOR(F.lit(3)).alias("d"))
    side = (F.col("id") % 700).cast("int")
    return prints.select("id", "p", "d", F.array(F.struct("p", "d"), turned).alias("blocks"), bits.limit(side, side).alias("within"))


def _gated(spark, sf_dir):
    """Pairs of files of one stem, but those that belong together."""
    named = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS id", f"{STEMMED} AS path")
    key = F.col("id") - F.col("id") % 6
    x, y = named.select(F.col("id").alias("a"), key.alias("k")), named.select(F.col("id").alias("b"), key.alias("k"))
    pairs = x.join(y, "k").where("a < b").select("a", "b")
    return similar.without_companions(pairs, named)


STEMMED = """'/x/' || CASE WHEN doc_id % 2 = 0 THEN 'p' ELSE 'q' END || '/IMG_' || CASE doc_id % 5 WHEN 0 THEN 'a' ELSE 'b' END ||
  CASE doc_id % 6 WHEN 0 THEN '.CR2' WHEN 1 THEN '.jpg' WHEN 2 THEN '.HEIC' WHEN 3 THEN '.MOV' WHEN 4 THEN '.JPEG' ELSE '.nef' END"""


def _files(e):
    return e.where((F.col("kind") == "File") & F.col("mtime_ns").isNotNull())


def _fingerprint_cache(spark, sf_dir):
    found = _files(entries(spark, sf_dir))
    cache = _with_columns(found, PRINTS)
    asked = found.groupBy("physical_key").agg(F.min(F.struct("path", "size_bytes", "mtime_ns", "ctime_ns")).alias("f")).select("physical_key", "f.*")
    return state.probe_fingerprints(asked, _one_each(cache), "image-phash", "mirror", 1).select("path", "data", "error", "cached")


def _one_each(cache):
    """Of rows with the same key and time the largest data, as the SQL has it."""
    return cache.groupBy(*[c for c in cache.columns if c not in ("data", "error")]).agg(F.max(F.struct("data", "error")).alias("m")).select("*", "m.data", "m.error").drop("m")


def _hash_stage(spark, sf_dir):
    """Digests of candidates, from the cache where that knows them, and whether a group has one of these."""
    e = entries(spark, sf_dir)
    cache = RQ._cached(e)
    found = exact.candidates(e).select("path").join(e, "path").select("path", "physical_key", "size_bytes", "mtime_ns", "ctime_ns", "content")
    hashed = written(state.hashed(found, cache, lambda path: F.when(path.isNotNull(), F.sha2(F.col("content").cast("binary"), 256))).drop("content"), "hashed")
    return state.with_provenance(hashed, ["size_bytes", "digest"]).select("path", "digest", "was_cached", "any_cached")


def _appended(spark, sf_dir):
    """What a scan adds to the cache of digests."""
    e = entries(spark, sf_dir)
    cache = RQ._cached(e)
    found = _files(e).select("path", "physical_key", "size_bytes", "mtime_ns", "ctime_ns", "content")
    hashed = state.hashed(found, cache, lambda path: F.when(path.isNotNull(), F.sha2(F.col("content").cast("binary"), 256)))
    return state.fresh_rows(hashed, NOW).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("created_at"))


def _region_keys(spark, sf_dir):
    e = entries(spark, sf_dir).where("kind = 'File'")
    n = F.col("size_bytes") % 4
    kind = F.when(n == 0, "full").when(n == 1, "head").when(n == 2, "middle").otherwise("sampled")
    key = state.region_key(kind, F.when(n > 0, F.col("size_bytes")), F.when(n > 1, F.lit(100)))
    return e.select("path", key.alias("region"))


def _stale(spark, sf_dir):
    """Identities whose digests a comparison proved wrong, where every seventh of a group is said to differ."""
    e, members = RQ._members(spark, sf_dir)
    n = F.length("path") % 7
    found = members.join(e.select("path", "physical_key", "mtime_s"), "path")
    compared = found.withColumn("verdict", F.when(n == 0, "different").otherwise("confirmed")).withColumn("was_cached", F.col("mtime_s") % 3 == 0)
    return state.stale_groups(state.with_provenance(compared, ["group_id"]))


def _events(spark, sf_dir):
    found = entries(spark, sf_dir).where("kind = 'File' AND mtime_ns IS NOT NULL")
    moved = found.select(F.col("path").alias("id"), F.lit("moved").alias("event"), F.lit(1_700_000_000).cast("long").alias("at"))
    later = found.selectExpr("path AS id", *EVENT).where("moment % 3 = 0 AND event <> 'failed'").withColumnRenamed("moment", "at")
    return state.active(moved.unionByName(later)).select("id", F.col("at").alias("moment"))


def _planned(spark, sf_dir):
    e, members = RQ._members(spark, sf_dir)
    changed = protection.changed_since(RQ._seen(e), e)
    return e, members, review.session_plan(members, protection.classified(e), changed, hygiene.report(e, NOW), "s1", NOW)


def _protected(spark, sf_dir):
    _, members, plan = _planned(spark, sf_dir)
    return review.protected_groups(plan.where("source = 'exact'").select("path", "group_id", "action"), members)


def _near(spark, sf_dir):
    near = RQ._groups(spark, sf_dir).withColumn("is_keeper", F.col("id") == F.col("keeper"))
    return near.withColumn("path", F.concat(F.lit("/docs/"), F.col("id").cast("string"), F.lit(".txt")))


def _exact_groups(spark, sf_dir):
    return reports.group_rows(RQ._members(spark, sf_dir)[1], "sha256")


def _saved(spark, sf_dir):
    return reports.saved_summary(_exact_groups(spark, sf_dir), "exact", "/data/r0/Documents/", "2024-01-11_190640", "a1b2c3")


def _full(spark, sf_dir):
    e, members = RQ._members(spark, sf_dir)
    return reports.full_report(exact.discovery_summary(e), members, "exact", "1", "/data", "2024-01-11")


def _names(spark, sf_dir):
    e = entries(spark, sf_dir).where("kind = 'Directory'").select("path").distinct()
    odd = spark.createDataFrame([("/",), ("",), ("/a/..",)], "path string")
    return e.unionByName(odd).select("path", text.folder_name(F.col("path")).alias("name"))


def _once(spark, sf_dir):
    """Candidates for similarity, one for each identity; stand-in identities are each their own."""
    return similar.once(_candidates(spark, sf_dir)).select("path")


def _candidates(spark, sf_dir):
    e = entries(spark, sf_dir)
    return e.where((F.col("size_bytes") > 0) & (F.col("kind") == "File") & F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin("txt", "jpg", "tmp", "aae"))


def _counters(spark, sf_dir):
    found = _candidates(spark, sf_dir)
    prints = similar.once(found).select("path", F.when(F.col("size_bytes") % 5 != 0, F.col("size_bytes")).alias("p"))
    return similar.counters(found, prints)


def _merged(spark, sf_dir):
    """Pictures and the side-car of each: its time, and its place in degrees, minutes and hundredths of seconds."""
    made = RQ._takeout(spark, sf_dir)
    path = F.concat(F.lit("/photos/"), "title")
    sidecars = made.select(F.concat(path, F.lit(".json")).alias("sidecar"), "taken", "latitude", "longitude")
    pictures = made.where("event_id % 2 = 0").select("event_id", path.alias("path"))
    return text.with_sidecars(pictures, sidecars)


def _walk(spark, sf_dir):
    """The files of the tables' own folder, found by the folder source."""
    found, errors = folders.discover(spark, [os.path.abspath(sf_dir)])
    own = found.where("depth = 1 AND path LIKE '%.parquet'").select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "depth")
    return own.withColumn("errors", F.lit(errors.count()))


def _streamed(spark, stream, what: str):
    """All that a stream gives out in one run over what is there, as a table."""
    at = f"{shared_dir(spark)}/stream-{what}-{uuid.uuid4().hex}"
    stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def _stream(spark, sf_dir, table: str):
    """A table as a stream, be it one file or a folder of files: the pattern, which nothing else fits, lets Spark take either."""
    path = f"{sf_dir}/{table}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _event_stream(spark, sf_dir):
    return _stream(spark, sf_dir, "events")


def _windows(spark, sf_dir):
    counted = incremental.windowed(_event_stream(spark, sf_dir), "ts", ["event_type"])
    out = counted.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    return _streamed(spark, out, "windows")


def _first_seen(spark, sf_dir):
    return _streamed(spark, incremental.first_seen(_event_stream(spark, sf_dir).select("ts", "user_id"), ["user_id"], "ts", "3650 days").select("user_id"), "first")


def _append_twice(spark, sf_dir):
    """Digests of the documents as files, appended by two runs of a stream: the second adds nothing."""
    at = f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
    for run in ("a", "b"):
        made = _stream(spark, sf_dir, "documents").selectExpr("'ino:' || doc_id AS physical_key", "n_chars AS size_bytes", "doc_id AS mtime_ns", "doc_id AS ctime_ns", "coalesce(text, '') AS content")
        incremental.append_digests(made, f"{at}/rows", f"{at}/{run}").awaitTermination()
    return spark.read.parquet(f"{at}/rows").select("physical_key", "size_bytes", "digest")


QUERIES = {
    "variant_pairs": lambda spark, sf_dir: similar.near_pairs(similar.classes(_varied(spark, sf_dir))),
    "companion_gate": _gated,
    "picture_scores": _scores,
    "picture_metadata": _metadata,
    "fingerprint_cache": _fingerprint_cache,
    "cached_hash_stage": _hash_stage,
    "cache_append": _appended,
    "cache_region_keys": _region_keys,
    "cache_stale_groups": _stale,
    "quarantine_active": _events,
    "session_plan": lambda spark, sf_dir: _planned(spark, sf_dir)[2],
    "protected_groups": _protected,
    "hygiene_manifest": lambda spark, sf_dir: hygiene.manifest(hygiene.cleanup(hygiene.report(entries(spark, sf_dir), NOW))),
    "report_exact_groups": _exact_groups,
    "report_similar_groups": lambda spark, sf_dir: reports.group_rows(_near(spark, sf_dir), "text-simhash"),
    "report_saved": _saved,
    "report_full": _full,
    "report_names": _names,
    "similar_once": _once,
    "similar_counters": _counters,
    "common_folders": lambda spark, sf_dir: config.common_folders(entries(spark, sf_dir)),
    "takeout_merge": _merged,
    "ground_truth": lambda spark, sf_dir: ground_truth.plan(spark, 50),
    "ground_truth_counts": lambda spark, sf_dir: ground_truth.counts(ground_truth.plan(spark, 50)),
    "folder_walk": _walk,
    "stream_windows": _windows,
    "stream_first_seen": _first_seen,
    "stream_digests": _append_twice,
}


# The same in SQL.


def _capped(score: str, cap: float) -> str:
    return f"greatest(-{cap}::DOUBLE, least({cap}::DOUBLE, {score}))"


def _when(*rules) -> str:
    return " + ".join(f"CASE WHEN {c} THEN {float(w)!r}::DOUBLE ELSE 0 END" for c, w in rules)


def _starts(column: str, values) -> str:
    return "(" + " OR ".join(f"starts_with({column}, {_q(v)})" for v in values) + ")"


_N = f"lower({NAME})"
_STEM = rf"regexp_replace({_N}, '\.[^.]*$', '')"
_ORIGINAL = "1600164000"
_TIMES = [(f"contains(path, {_q(p)})", w * D.CANONICAL_TIMES.get(p, 1)) for p, w in D.CANONICAL] + [(f"contains(path, {_q(p)})", w) for p, w in D.JUNK]
SCORES = f"""
WITH pictures AS (SELECT {PICTURES} FROM documents),
cluster AS (SELECT group_id, max(width * height)::DOUBLE AS mp, max(size_bytes / (width * height)::DOUBLE) AS md, min(birth_s) AS oldest FROM pictures
GROUP BY group_id),
parts AS (
  SELECT id, group_id,
    {_capped(_when(("truncated", -50), (f"{LOW_EXT} IN {_list(D.RAW_SIBLINGS)}", 40), ("(width, height) IN ((1920, 1080), (1280, 720), (2048, 1024), (640, 480))", -8))
      + " + CASE WHEN width * height / mp >= 0.99 THEN 10.0 WHEN width * height / mp >= 0.5 THEN 5.0 ELSE 0 END"
      + " + CASE WHEN size_bytes / (width * height)::DOUBLE / md >= 0.95 THEN 10.0 ELSE 0 END", 50)} AS content,
    {_capped(_when((f"date_time_original IS NOT NULL AND mtime_s < {_ORIGINAL}", -25), ("compressed_twice", -25), ("history", -30), ("maker_note", 30), ("make IS NOT NULL AND model IS NOT NULL", 20),
      ("gps", 15), ("date_time_original = date_time", 8), (_holds("lower(software)", images.EDITORS), -35),
      (f"software = '' OR {_holds('lower(software)', ('ios', 'android', 'firmware'))}", 5),
      ("color_space", 5), ("NOT any_exif", -10)), 60)} AS exif,
    {_capped(_when((_starts(_N, images.CAMERA_NAMES), 25), (f"strlen({_N}) > 20 AND starts_with({_N}, 'img-') AND contains({_N}, '-wa')", -30), (f"regexp_matches({_N}, '^received_[0-9]+$')", -25),
      (f"starts_with({_N}, 'fb_img_')", -25), (f"starts_with({_N}, 'snapchat-')", -25), (f"starts_with({_N}, 'photo_') AND contains({_N}, '@')", -20),
      (_holds(_N, images.COPIED_NAMES), -20),
      (f"{_N} IN {_list(images.PLAIN_NAMES)}", -15), (_starts(_N, ("screenshot", "captura")), -10),
      (f"length(regexp_replace({_STEM}, '[^0-9]', '', 'g')) / greatest(strlen({_STEM}), 1) > 0.6", -5)), 40)} AS filename,
    {_capped(_when(*_TIMES), 30)} AS path_score, CASE WHEN birth_s <= oldest THEN 10.0 ELSE 0 END AS fs
  FROM pictures JOIN cluster USING (group_id)
)
SELECT id, group_id, round(content, 6) AS content, round(exif, 6) AS exif, round(filename, 6) AS filename, round(path_score, 6) AS path_score,
round(fs, 6) AS fs,
  round(content + exif + filename + path_score + fs, 6) AS total FROM parts"""

_EXT_OF = "lower(regexp_extract(path, '\\.([^./]*)$', 1))"
_CANDIDATES = f"candidates AS (SELECT *, {_EXT_OF} AS ext FROM entries WHERE kind = 'File' AND size_bytes > 0 AND {_EXT_OF} IN ('txt', 'jpg', 'tmp', 'aae'))"
_ONCE = f"""{_CANDIDATES}, once AS (
  SELECT min({{'c': string_split(path, '/'), 'p': path, 's': size_bytes}}) AS f FROM candidates GROUP BY CASE WHEN starts_with(physical_key,
  'path:') THEN path ELSE physical_key END)"""
_SESSION = _with(f"{RQ.GUARDED}, plan AS ({RQ.PLAN}), {REPORT}", "")
_CLOCKED = RQ._CLOCK.format
_GROUPS = f"""SELECT group_id, {NAME.replace('path', 'kept')} AS name, coalesce({FQ.EXT.replace('path', 'kept')}, '') AS extension,
    {{algorithm}} AS algorithm, {{match}} AS match, kept, kept_bytes, removed, removed_bytes FROM (
  SELECT group_id, max(CASE WHEN is_keeper THEN path END) AS kept, max(CASE WHEN is_keeper THEN size_bytes END) AS kept_bytes,
  count(*) FILTER (WHERE NOT is_keeper) AS removed,
    coalesce(sum(size_bytes) FILTER (WHERE NOT is_keeper), 0)::BIGINT AS removed_bytes, {{average}} AS s FROM {{members}} GROUP BY group_id)"""
_EXACT_GROUPS = _GROUPS.format(algorithm="'sha256'", match="'100%'", average="1", members="members")
_VAR = "{{'p': xor({0}.p, 15::BIGINT), 'd': xor({0}.d, 3::BIGINT)}}"
_APART = "(bit_count(xor({0}.p, {1}.p)) + 0.7e0 * bit_count(xor({0}.d, {1}.d)))"
_BOTH = f"least(64, ceil(least({_APART.format('a', 'b')}, {_APART.format('a.v', 'b')}, {_APART.format('a', 'b.v')})))::INT"
_SIDE = "CASE WHEN id % 700 <= 128 THEN 4 WHEN id % 700 <= 256 THEN 6 WHEN id % 700 <= 512 THEN 8 ELSE 10 END"


def _dms(column: str) -> str:
    a = f"abs({column})"
    return f"floor({a})::BIGINT AS {column}_degrees, floor(({a} - floor({a})) * 60)::BIGINT AS {column}_minutes, round((({a} - floor({a})) * 60 - floor(({a} - floor({a})) * 60)) * 6000)::BIGINT AS {column}_hundredths"


_PAIR = "((x IN {0} AND y IN ('jpg', 'jpeg')) OR (x IN ('heic', 'heif') AND y = 'mov'))"
_LATEST = """latest AS (
  SELECT physical_key, size_bytes,
  max({'o': created_at, 'mtime_ns': mtime_ns, 'c': coalesce(ctime_ns, -1), 'digest': digest, 'ctime_ns': ctime_ns}) AS m FROM cache GROUP BY 1, 2
), known AS (
  SELECT e.*, CASE WHEN m.mtime_ns = e.mtime_ns
  AND (m.ctime_ns = e.ctime_ns OR m.ctime_ns IS NULL OR e.ctime_ns IS NULL) THEN m.digest END AS cached_digest
  FROM (SELECT * FROM entries WHERE kind = 'File') e LEFT JOIN latest l ON l.physical_key = e.physical_key AND l.size_bytes = e.size_bytes
  AND NOT starts_with(e.physical_key, 'path:')
)"""

SQL = {
    "variant_pairs": f"""WITH {RQ.PRINTS}, reps AS (
        SELECT min(id) AS id, p, d, {_VAR.format('q')} AS v, within FROM (SELECT *, {_SIDE} AS within FROM prints) q GROUP BY p, d, within)
        SELECT a.id AS a, b.id AS b, {_BOTH} AS distance FROM reps a JOIN reps b ON a.id < b.id WHERE {_BOTH} <= least(a.within, b.within, 10)""",
    "companion_gate": f"""WITH named AS (SELECT doc_id AS id, doc_id - doc_id % 6 AS k, {STEMMED} AS path FROM documents), parts AS (SELECT *,
        {FQ.STEM} AS stem, {LOW_EXT} AS ext FROM named)
        SELECT a, b FROM (SELECT l.id AS a, r.id AS b, l.stem = r.stem AS same, l.ext AS x, r.ext AS y FROM parts l JOIN parts r ON l.k = r.k
        AND l.id < r.id)
        WHERE NOT (same AND ({_PAIR.format(_list(D.RAW_SIBLINGS))} OR
        {_PAIR.format(_list(D.RAW_SIBLINGS)).replace('x IN', 'Z IN').replace('y IN', 'x IN').replace('y =', 'x =').replace('Z IN', 'y IN')}))""",
    "picture_scores": SCORES,
    "picture_metadata": f"""SELECT id, width // 2 AS width, height AS orig_height, least(width, height) AS min_side,
        round((width // 2) / (height // 2), 6) AS aspect_ratio,
        round((width // 2) * (height // 2) / 1000000, 6) AS megapixels, make, model, 1 AS fingerprint_algo_version FROM (SELECT {PICTURES}
        FROM documents)""",
    "fingerprint_cache": _with("", f"""SELECT f.p AS path, CASE WHEN hit THEN data END AS data, CASE WHEN hit THEN error END AS error, hit AS cached
        FROM (
        SELECT f, m.data AS data, m.error AS error, coalesce(m.mtime_ns = f.m AND (m.ctime_ns = f.c OR m.ctime_ns IS NULL OR f.c IS NULL),
        false) AS hit FROM
          (SELECT physical_key, min({{'p': path, 's': size_bytes, 'm': mtime_ns, 'c': ctime_ns}}) AS f FROM entries WHERE kind = 'File'
          AND mtime_ns IS NOT NULL GROUP BY physical_key) a
          LEFT JOIN (SELECT physical_key, size_bytes, max({{'o': created_at, 'mtime_ns': mtime_ns, 'c': coalesce(ctime_ns, -1), 'd': coalesce(data,
          ''), 'ctime_ns': ctime_ns, 'data': data, 'error': error}}) AS m
            FROM (SELECT {PRINTS} FROM entries WHERE kind = 'File' AND mtime_ns IS NOT NULL) WHERE detector = 'image-phash' AND params = 'mirror'
            AND algo_version = 1 GROUP BY 1, 2) k
          ON a.physical_key = k.physical_key AND a.f.s = k.size_bytes AND NOT starts_with(a.physical_key, 'path:'))"""),
    "cached_hash_stage": _with(f"{FQ.PHYSICAL}, {RQ.CACHE}, {_LATEST}", """SELECT path, digest, was_cached,
        bool_or(was_cached) OVER (PARTITION BY size_bytes, digest) AS any_cached FROM (
        SELECT path, size_bytes, coalesce(cached_digest, sha256(content)) AS digest, cached_digest IS NOT NULL AS was_cached FROM known
        WHERE path IN (SELECT path FROM cand))"""),
    "cache_append": _with(f"{RQ.CACHE}, {_LATEST}", f"""SELECT sha256(content) AS digest, count(*) AS n, {NOW}::BIGINT AS created_at FROM known
        WHERE mtime_ns IS NOT NULL AND cached_digest IS NULL AND NOT starts_with(physical_key, 'path:') GROUP BY 1"""),
    "cache_region_keys": _with("", """SELECT path, CASE size_bytes % 4 WHEN 0 THEN 'full:-1:-1' WHEN 1 THEN 'head:' || size_bytes || ':-1'
        WHEN 2 THEN 'middle:' || size_bytes || ':100' ELSE 'sampled:-1:-1' END AS region
        FROM entries WHERE kind = 'File'"""),
    "cache_stale_groups": _with(RQ.KEPT, """SELECT DISTINCT physical_key FROM members m JOIN entries e USING (path) WHERE group_id IN (
        SELECT group_id FROM members m JOIN entries e USING (path) GROUP BY group_id HAVING bool_or(length(path) % 7 = 0)
        AND bool_or(e.mtime_s % 3 = 0))"""),
    "quarantine_active": _with("", f"""SELECT path AS id, 1700000000::BIGINT AS moment FROM entries WHERE kind = 'File' AND mtime_ns IS NOT NULL
        AND path NOT IN (SELECT path FROM (SELECT path, {', '.join(EVENT)} FROM entries WHERE kind = 'File' AND mtime_ns IS NOT NULL)
        WHERE moment % 3 = 0 AND event <> 'failed')"""),
    "session_plan": f"""{_SESSION} SELECT path, source, group_id, action, reason, 's1' AS session_id, {_CLOCKED(f'{NOW}::BIGINT')} AS at,
        CASE WHEN action = 'quarantine' THEN {_CLOCKED(f'{NOW}::BIGINT + 2592000')} END AS purge_at FROM (
          SELECT path, 'exact' AS source, group_id, action, reason FROM plan
          UNION ALL SELECT path, 'hygiene', NULL, CASE WHEN risk = 'Low' THEN 'delete' ELSE 'quarantine' END, 'junk: ' || lower(category) FROM report
          WHERE (risk = 'Low' AND can_clean) OR risk = 'Medium')""",
    "protected_groups": f"""{_SESSION} SELECT * FROM (SELECT group_id, count(*) AS total_files,
        count(*) FILTER (WHERE action = 'protected') AS protected_files,
        count(*) FILTER (WHERE action = 'quarantine') AS cleaned_files, coalesce(sum(size_bytes) FILTER (WHERE action = 'protected'),
        0)::BIGINT AS protected_bytes
        FROM plan JOIN members USING (path, group_id) GROUP BY group_id) WHERE protected_files > 0""",
    "hygiene_manifest": _with(REPORT, """SELECT path, size_bytes, CASE WHEN risk = 'Low' THEN 'delete' ELSE 'quarantine' END AS action FROM report
        WHERE (risk = 'Low' AND can_clean) OR risk = 'Medium'"""),
    "report_exact_groups": _with(RQ.KEPT, _EXACT_GROUPS),
    "report_similar_groups": RQ._near(_GROUPS.format(algorithm="'text-simhash'", match="greatest(0, least(100, floor(s * 100 + 0.5)))::BIGINT || '%'", average="max(avg_similarity)",
        members="(SELECT *, id = keeper AS is_keeper, '/docs/' || id || '.txt' AS path FROM near)")),
    "report_saved": _with(RQ.KEPT, f"""SELECT '2024-01-11_190640_Documents_exact_a1b2c3' AS id, 'Exact · Documents — 2024-01-11' AS title,
        'exact' AS mode, '/data/r0/Documents/' AS source_path,
        coalesce(sum(removed), 0)::BIGINT AS files_removed, coalesce(sum(removed_bytes), 0)::BIGINT AS bytes_reclaimed, count(*) AS groups_count,
        0 AS verified_groups, 'active' AS status FROM ({_EXACT_GROUPS})"""),
    "report_full": _with(RQ.KEPT, """SELECT '1' AS version, '/data' AS scan_root, '2024-01-11' AS "timestamp", (SELECT count(*) FROM entries
        WHERE kind = 'File') AS total_files,
        (SELECT sum(size_bytes)::BIGINT FROM entries WHERE kind = 'File') AS total_bytes, (SELECT count(DISTINCT group_id)
        FROM members) AS exact_groups, (SELECT count(*) FROM members WHERE NOT is_keeper) AS exact_files,
        (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM members WHERE NOT is_keeper) AS exact_bytes, 0::BIGINT AS similar_groups,
        0::BIGINT AS similar_files, 0::BIGINT AS similar_bytes, 0::BIGINT AS hygiene_items, 0::BIGINT AS hygiene_bytes"""),
    "report_names": _with("", f"""SELECT path, CASE WHEN path IN ('', '/') THEN 'root' WHEN {NAME} IN ('', '..', '.') THEN 'unknown'
        ELSE {NAME} END AS name
        FROM (SELECT DISTINCT path FROM entries WHERE kind = 'Directory' UNION ALL VALUES ('/'), (''), ('/a/..'))"""),
    "similar_once": _with(_ONCE, "SELECT f.p AS path FROM once"),
    "similar_counters": _with(_ONCE, """SELECT candidates, hardlinks, fingerprints + failed AS tried, failed,
        CASE WHEN candidates < 2 OR fingerprints < 2 THEN 0 ELSE fingerprints END AS files_scanned, CASE WHEN candidates < 2 THEN candidates
        ELSE failed + CASE WHEN fingerprints < 2 THEN fingerprints ELSE 0 END END AS files_skipped
        FROM (SELECT (SELECT count(*) FROM candidates) AS candidates, (SELECT count(*) FROM candidates) - (SELECT count(*) FROM once) AS hardlinks,
          (SELECT count(*) FROM once WHERE f.s % 5 <> 0) AS fingerprints, (SELECT count(*) FROM once WHERE f.s % 5 = 0) AS failed)"""),
    "common_folders": _with("", f"""SELECT name, path, color, icon, coalesce(n || ' items', '') AS size FROM (SELECT DISTINCT path, {NAME} AS name
        FROM entries WHERE kind = 'Directory')
        JOIN (VALUES {', '.join(f'({_q(a)}, {_q(b)}, {_q(c)})' for a, b, c in config.COMMON)}) c(name, color, icon) USING (name) LEFT
        JOIN (SELECT {PARENT} AS path, count(*) AS n FROM entries GROUP BY 1) USING (path)"""),
    "takeout_merge": f"""SELECT event_id, '/photos/' || title AS path, taken AS mtime_s, CASE WHEN latitude >= 0 THEN 'N'
        ELSE 'S' END AS latitude_ref, {_dms('latitude')},
        CASE WHEN longitude >= 0 THEN 'E' ELSE 'W' END AS longitude_ref, {_dms('longitude')} FROM ({RQ.SQL['takeout_metadata']})
        WHERE event_id % 2 = 0""",
    "ground_truth": """SELECT 'exact/' || (n % 3) || '/doc_' || (n // 3) || '.bin' AS path, 'exact' AS kind, n // 3 AS cluster, n // 3 + 1 AS seed,
        1000 + (n // 3) * 997 % 50000 AS size_bytes FROM range(900) r(n)
        UNION ALL SELECT 'unique/doc_' || n || '.bin', 'unique', NULL, n + 1000000, 1000 + n * 997 % 50000 FROM range(1000) r(n)
        UNION ALL SELECT 'junk/' || n || '/' || name, 'hygiene', NULL, n + 2000000, size FROM range(50) r(n), (VALUES ('Thumbs.db', 16), ('empty.txt',
        0), ('draft.tmp', 12), ('~$lock.docx', 8)) j(name, size)""",
    "ground_truth_counts": """SELECT 'exact' AS kind, 900::BIGINT AS files, 300::BIGINT AS clusters,
        (SELECT sum(1000 + (n // 3) * 997 % 50000)::BIGINT FROM range(900) r(n)) AS bytes
        UNION ALL SELECT 'unique', 1000, 0, (SELECT sum(1000 + n * 997 % 50000)::BIGINT FROM range(1000) r(n)) UNION ALL SELECT 'hygiene', 200, 0,
        50 * 36""",
    "folder_walk": f"""SELECT name || '.parquet' AS name, 1 AS depth, 0::BIGINT AS errors FROM (VALUES {', '.join(f'({_q(t)})' for t in (
        'region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels',
        'conversations'))}) t(name)""",
    "stream_windows": """SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total FROM (
        SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
        WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
    "stream_first_seen": "SELECT DISTINCT user_id FROM events",
    "stream_digests": "SELECT 'ino:' || doc_id AS physical_key, n_chars AS size_bytes, sha256(coalesce(text, '')) AS digest FROM documents",
}
