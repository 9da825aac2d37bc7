"""Queries over fingerprints, groups under review, and state that outlives a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import bits, text
from gleaner.operators import evaluate, exact, hygiene, keeper, protection, review, similar, state
from gleaner.operators.tables import dropped, written
from gleaner.plans import files as FQ
from gleaner.plans.files import PARENT, REPORT, SCORED, _best, _with
from gleaner.sources import inventory
from gleaner.sources.inventory import NOW, entries


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _prints(spark, sf_dir):
    return written(similar.simhash(_docs(spark, sf_dir)).select(F.col("doc_id").alias("id"), "p", "d"), "prints")


def _groups(spark, sf_dir):
    sizes = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"))
    prints = _prints(spark, sf_dir)
    near = similar.near_groups(prints)
    members = written(near.join(sizes, "id"), "sized")  # what is asked of groups reads them several times, texts once
    dropped(prints, near)
    return similar.best_members(members, F.col("size_bytes"))


def _functions(spark, sf_dir):
    """The distances of each fingerprint and the next one's, in all their forms."""
    prints = _prints(spark, sf_dir)
    x = prints.select("id", F.struct("p", "d").alias("x"))
    y = prints.select((F.col("id") - 1).alias("id"), F.struct("p", "d").alias("y"))
    turned = lambda s: F.struct(s["d"].alias("p"), s["p"].alias("d"))
    both = x.join(y, "id").select("id", "x", "y", F.array("x", turned(F.col("x"))).alias("a"), F.array("y", turned(F.col("y"))).alias("b"))
    distance = bits.alignment_distance(F.col("a"), F.col("b"))
    side = (F.col("id") % 700).cast("int")
    sim = bits.similarity(bits.whole_distance(distance).cast("double"))
    return both.select(
        "id", bits.hamming(F.col("x.p"), F.col("y.p")).alias("hamming"), F.round(bits.block_distance(F.col("x"), F.col("y")), 6).alias("block"),
        F.round(distance, 6).alias("aligned"), bits.whole_distance(distance).alias("whole"), sim.alias("similarity"), bits.label(sim).alias("label"),
        bits.limit(side, F.when(F.col("id") % 5 != 0, side + 100)).alias("limit"), bits.varied(F.col("x")).alias("varied"),
        F.size(bits.distinct_variants(F.concat("a", F.array("x")))).alias("variants"),
    )


def _members(spark, sf_dir):
    """The inventory without contents, as a written table that plans may read many times, and the members of its exact groups."""
    whole = entries(spark, sf_dir)
    e = written(whole.drop("content"), "inventory")
    return e, keeper.with_keeper(exact.confirmed_members(whole), e).select("group_id", "size_bytes", "path", "keeper_path", "is_keeper")


def _reference(spark, sf_dir):
    return review.with_reference(_members(spark, sf_dir)[1], "/data/r0")


def _isolate(spark, sf_dir):
    return review.across_roots(_members(spark, sf_dir)[1], ("/data/r0", "/data/r1")).select("group_id", "path")


def _top(spark, sf_dir):
    return review.top_groups(_members(spark, sf_dir)[1])


def _totals(spark, sf_dir):
    e, members = _members(spark, sf_dir)
    near = _groups(spark, sf_dir).withColumn("is_keeper", F.col("id") == F.col("keeper"))
    return review.totals(exact.discovery_summary(e), members, near, hygiene.report(e, NOW))


def _seen(e):
    """Files as an earlier scan might have seen them: a few have changed or gone since."""
    n = F.col("mtime_ns") % 1000
    return e.where((F.col("kind") == "File") & F.col("mtime_ns").isNotNull()).select(
        F.when(n % 29 == 0, F.concat("path", F.lit(".gone"))).otherwise(F.col("path")).alias("path"), (F.col("size_bytes") + (n % 17 == 0).cast("long")).alias("size_bytes"),
        F.when(n % 2 == 0, F.col("mtime_s") + (n % 19 == 0).cast("long")).alias("mtime_s"),
        F.when(n % 3 == 0, F.when(n % 23 == 0, "other").otherwise(F.col("physical_key"))).alias("physical_key"),
    )


def _changed(spark, sf_dir):
    e = entries(spark, sf_dir)
    return protection.changed_since(_seen(e), e)


def _plan(spark, sf_dir):
    e, members = _members(spark, sf_dir)
    problems = protection.changed_since(_seen(e), e)
    return review.cleanup_plan(members, protection.classified(e), problems).select("path", "group_id", "action", "reason")


def _numbered(spark, sf_dir):
    return review.numbered(_members(spark, sf_dir)[1])


def _cache(e):
    """Digests as earlier runs might have cached them: some stale, some twice, some old."""
    found = e.where((F.col("kind") == "File") & F.col("mtime_ns").isNotNull())
    n = F.col("mtime_ns") % 1000
    first = found.where(n % 5 != 0).select(
        "physical_key", "size_bytes", (F.col("mtime_ns") + (n % 7 == 0).cast("long")).alias("mtime_ns"),
        F.when(n % 4 != 0, F.col("ctime_ns") + (n % 11 == 0).cast("long")).alias("ctime_ns"),
        F.sha2(F.col("content").cast("binary"), 256).alias("digest"), (F.lit(NOW) - n * 40_000).alias("created_at"),
    )
    again = first.where(F.col("created_at") % 80_000 == NOW % 80_000).withColumns(
        {"mtime_ns": F.col("mtime_ns") - 1, "digest": F.lit("old"), "created_at": F.col("created_at") - 7}
    )
    return first.unionByName(again)


def _cached(e):
    """Of cached rows that differ in their time alone the last."""
    rows = _cache(e)
    return rows.groupBy(*[c for c in rows.columns if c != "created_at"]).agg(F.max("created_at").alias("created_at"))


def _probe(spark, sf_dir):
    e = entries(spark, sf_dir)
    files = e.where(F.col("kind") == "File").select("path", "physical_key", "size_bytes", "mtime_ns", "ctime_ns")
    return state.probe(files, _cached(e), "digest").select("path", "digest")


def _journal(e):
    """A quarantine journal of every third file."""
    n = F.col("mtime_ns") % 1000
    found = e.where((F.col("kind") == "File") & (n % 3 == 0))
    return found.select(
        F.concat(F.lpad(n.cast("string"), 4, "0"), F.lit(":"), "path").alias("id"), "path", "size_bytes", F.concat(F.lit("s"), (n % 5).cast("string")).alias("session_id"),
        F.when(n % 4 == 0, "exact-auto").when(n % 4 == 1, "similar-auto").when(n % 4 == 2, "junk: temporary").otherwise("user-cleaned").alias("reason"),
        text.clock(F.col("mtime_s")).alias("moved_at"), F.when(n % 6 != 0, text.clock(F.col("mtime_s") + 30 * 86_400)).alias("purge_at"),
    )


def _listing(e):
    return e.where((F.col("kind") == "File") & (F.col("mtime_ns") % 1000 % 2 == 0)).select("path")


def _on(make):
    return lambda spark, sf_dir: make(entries(spark, sf_dir))


def _kept(e):
    a = e.where(F.col("mtime_s") % 2 == 0).select("path", F.col("mtime_s").alias("kept_at"))
    return state.kept_files(a, e.where(F.col("mtime_s") % 3 == 0).select("path", (F.col("mtime_s") + 5).alias("kept_at")))


def _takeout(spark, sf_dir):
    """Side-car JSON built from events, and what is read back from it."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    made = events.select(
        "event_id",
        F.to_json(
            F.struct(
                F.concat(F.lit("IMG_"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("title"),
                F.struct((F.lit(1_600_000_000) + F.col("event_id")).cast("string").alias("timestamp")).alias("photoTakenTime"),
                F.when(F.col("event_id") % 3 != 0, F.struct((F.col("user_id") % 90 + 0.25).alias("latitude"),
                    (-(F.col("user_id") % 180) - 0.5).alias("longitude"))).alias("geoData"),
                F.when(F.col("event_id") % 2 == 0, F.struct(F.lit(1.5).alias("latitude"), F.lit(2.75).alias("longitude"))).alias("geoDataExif"),
            )
        ).alias("json"),
    )
    get = lambda p: F.get_json_object("json", p)
    lat = F.coalesce(get("$.geoData.latitude"), get("$.geoDataExif.latitude")).try_cast("double")
    lon = F.coalesce(get("$.geoData.longitude"), get("$.geoDataExif.longitude")).try_cast("double")
    d = text.degrees(lat)
    return made.select(
        "event_id", get("$.title").alias("title"), get("$.photoTakenTime.timestamp").try_cast("bigint").alias("taken"), lat.alias("latitude"), lon.alias("longitude"),
        d["degrees"].alias("degrees"), d["minutes"].alias("minutes"), d["hundredths"].alias("hundredths"),
    )


def _shown(spark, sf_dir):
    """Sizes, durations and times as people read them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    n = F.col("o_orderkey")
    wide = n.cast("decimal(19,0)")
    big = wide * wide * wide  # a cube is soon beyond 64 bits
    return orders.select(
        "o_orderkey", text.decimal_size(big).alias("two"), text.decimal_size(big, 1).alias("one"), text.binary_size(big).alias("binary"), text.duration(n).alias("duration"),
        text.clock(n * 86_400).alias("clock"), text.iso_seconds(F.lit("2020-02-29T12:00:01Z")).alias("iso"),
        text.exif_seconds(F.when(n % 2 == 0, "2021:03:04 05:06:07").otherwise("bad")).alias("exif"),
        F.date_from_unix_date((n % 20000).cast("int")).cast("string").alias("day"),
    )


QUERIES = {
    "simhash": lambda spark, sf_dir: similar.simhash(_docs(spark, sf_dir)),
    "embedding_sign_bits": lambda spark, sf_dir: similar.sign_bits(spark.read.parquet(f"{sf_dir}/embeddings.parquet")),
    "fingerprint_functions": _functions,
    "hamming_join": lambda spark, sf_dir: similar.near_pairs(similar.classes(_prints(spark, sf_dir))),
    "near_duplicate_groups": _groups,
    "protect_prior_keepers": lambda spark, sf_dir: similar.protect_kept(
        _groups(spark, sf_dir), _docs(spark, sf_dir).where("doc_id % 4 = 0").select(F.col("doc_id").alias("id"))).select("id", "group_id", "keeper", "files"),
    "reference_filter": _reference,
    "isolate_filter": _isolate,
    "top_groups": _top,
    "full_scan_summary": _totals,
    "changed_since_scan": _changed,
    "cleanup_plan": _plan,
    "selection_ordinals": _numbered,
    "cache_probe": _probe,
    "cache_latest": _on(lambda e: state.latest(_cached(e), ["physical_key", "size_bytes"]).select("physical_key", "size_bytes", "created_at")),
    "cache_invalidate": _on(lambda e: state.invalidated(_cache(e), e.where("readonly")).groupBy("digest").agg(F.count(F.lit(1)).alias("n"))),
    "cache_prune": _on(lambda e: state.pruned(_cache(e), NOW).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("oldest"))),
    "quarantine_sessions": _on(lambda e: state.sessions(_journal(e))),
    "quarantine_by_reason": _on(lambda e: state.by_reason(_journal(e), "exact%").select("path", "reason")),
    "quarantine_expired": _on(lambda e: state.expired(_journal(e), "2023-12-25 00:00:00").select("path", "purge_at")),
    "quarantine_healed": _on(lambda e: state.healed(_journal(e), _listing(e)).select("path")),
    "quarantine_strays": _on(lambda e: state.strays(_journal(e), _listing(e))),
    "kept_files": _on(_kept),
    "takeout_metadata": _takeout,
    "shown_values": _shown,
    "cluster_metrics": lambda spark, sf_dir: evaluate.pair_metrics(
        _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("group_id")),
        _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("source").alias("group_id"))
    ),
}

PRINTS = """
tokens AS (
  SELECT doc_id, ('0x' || substr(m, 1, 16))::UBIGINT AS p, ('0x' || substr(m, 17, 16))::UBIGINT AS d
  FROM (SELECT doc_id, md5(w) AS m FROM (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\r]+')) AS w
  FROM documents) WHERE w <> '')
), bits AS (
  SELECT doc_id, i, sum((p >> i::UBIGINT) & 1) * 2 > count(*) AS bp, sum((d >> i::UBIGINT) & 1) * 2 > count(*) AS bd
  FROM tokens, range(64) r(i) GROUP BY doc_id, i
), prints AS (
  SELECT doc_id AS id,
    (sum(CASE WHEN bp THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << i::INT END ELSE 0 END))::BIGINT AS p,
    (sum(CASE WHEN bd THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << i::INT END ELSE 0 END))::BIGINT AS d
  FROM bits GROUP BY doc_id
)"""
_BLOCK = "(bit_count(xor({0}.p, {1}.p)) + 0.7e0 * bit_count(xor({0}.d, {1}.d)))"
_WHOLE = f"least(64, ceil({_BLOCK}))::INT"
NEAR = f"""
{PRINTS}, matches AS (
  SELECT a.id AS x, b.id AS y FROM prints a JOIN prints b ON a.id <> b.id WHERE {_WHOLE.format('a', 'b')} <= 10
), reach(id, c) AS (
  SELECT id, id FROM prints UNION SELECT m.y, r.c FROM reach r JOIN matches m ON m.x = r.id
), comps AS (
  SELECT id, min(c) AS component FROM reach GROUP BY id
), sims AS (
  SELECT ca.component, a.id AS x, b.id AS y, 1 - {_WHOLE.format('a', 'b')} / 64.0e0 AS s
  FROM comps ca JOIN comps cb ON ca.component = cb.component AND ca.id <> cb.id JOIN prints a ON a.id = ca.id JOIN prints b ON b.id = cb.id
), weak AS (
  SELECT component FROM sims GROUP BY component HAVING min(s) < 0.65 AND count(DISTINCT x) > 2
), again(id, c) AS (
  SELECT id, id FROM comps WHERE component IN (SELECT component FROM weak)
  UNION SELECT s.y, g.c FROM again g JOIN sims s ON s.x = g.id AND s.s >= 0.80 AND s.component IN (SELECT component FROM weak)
), grouped AS (
  SELECT id, min(c) AS group_id FROM again GROUP BY id
  UNION ALL SELECT id, component FROM comps WHERE component NOT IN (SELECT component FROM weak)
), stats AS (
  SELECT a.group_id, count(DISTINCT a.id) AS files, avg(s.s) AS avg_similarity
  FROM sims s JOIN grouped a ON a.id = s.x JOIN grouped b ON b.id = s.y AND a.group_id = b.group_id GROUP BY a.group_id
), near AS (
  SELECT g.id, group_id, files, avg_similarity,
    CASE {' '.join(f"WHEN avg_similarity >= {x} THEN '{t}'" for x, t in bits.LABELS)} ELSE '{bits.UNSURE}' END AS confidence,
    strlen(coalesce(text, '')) AS size_bytes, first_value(g.id) OVER (PARTITION BY group_id ORDER BY strlen(coalesce(text, '')) DESC, g.id) AS keeper
  FROM grouped g JOIN stats USING (group_id) JOIN documents t ON t.doc_id = g.id
)"""


def _near(select: str) -> str:
    return f"WITH RECURSIVE {NEAR} {select}"


SEEN = f"""seen AS (
  SELECT CASE WHEN n % 29 = 0 THEN path || '.gone' ELSE path END AS path, size_bytes + (n % 17 = 0)::BIGINT AS size_bytes,
    CASE WHEN n % 2 = 0 THEN mtime_s + (n % 19 = 0)::BIGINT END AS mtime_s, CASE WHEN n % 3 = 0 THEN CASE WHEN n % 23 = 0 THEN 'other'
    ELSE physical_key END END AS physical_key
  FROM (SELECT *, mtime_ns % 1000 AS n FROM entries WHERE kind = 'File' AND mtime_ns IS NOT NULL)
), changed AS (
  SELECT s.path, CASE WHEN e.path IS NULL THEN 'cannot stat file'
  WHEN e.size_bytes <> s.size_bytes THEN 'size ' || s.size_bytes || '→' || e.size_bytes
    WHEN s.mtime_s <> e.mtime_s THEN 'mtime ' || s.mtime_s || '→' || e.mtime_s
    WHEN s.physical_key <> e.physical_key THEN 'physical identity mismatch' END AS problem
  FROM seen s LEFT JOIN entries e ON s.path = e.path
)"""
CACHE = f"""cached AS (
  SELECT physical_key, size_bytes, mtime_ns + (n % 7 = 0)::BIGINT AS mtime_ns, CASE
  WHEN n % 4 <> 0 THEN ctime_ns + (n % 11 = 0)::BIGINT END AS ctime_ns, sha256(content) AS digest, {NOW} - n * 40000 AS created_at
  FROM (SELECT *, mtime_ns % 1000 AS n FROM entries WHERE kind = 'File' AND mtime_ns IS NOT NULL) WHERE n % 5 <> 0
), cache AS (
  SELECT * FROM cached UNION ALL SELECT physical_key, size_bytes, mtime_ns - 1, ctime_ns, 'old', created_at - 7 FROM cached
  WHERE created_at % 80000 = {NOW % 80_000}
)"""
_CLOCK = "strftime(make_timestamp(({0}) * 1000000), '%Y-%m-%d %H:%M:%S')"
JOURNAL = f"""journal AS (
  SELECT lpad(n::VARCHAR, 4, '0') || ':' || path AS id, path, size_bytes, 's' || (n % 5) AS session_id,
    CASE n % 4 WHEN 0 THEN 'exact-auto' WHEN 1 THEN 'similar-auto' WHEN 2 THEN 'junk: temporary' ELSE 'user-cleaned' END AS reason,
    {_CLOCK.format('mtime_s')} AS moved_at, CASE WHEN n % 6 <> 0 THEN {_CLOCK.format('mtime_s + 2592000')} END AS purge_at
  FROM (SELECT *, mtime_ns % 1000 AS n FROM entries WHERE kind = 'File') WHERE n % 3 = 0
), listing AS (SELECT path FROM entries WHERE kind = 'File' AND mtime_ns % 1000 % 2 = 0)"""
KEPT = f"{SCORED}, members AS (SELECT group_id, size_bytes, path, keeper_path, path = keeper_path AS is_keeper FROM total JOIN ({_best('smart', '-score')}) USING (group_id))"


def _size(n: str, base: int, units, form: str) -> str:
    return "CASE " + " ".join(f"WHEN {n} >= {base**p} THEN format('{form} {u}', {n} / {float(base**p)!r}e0)" for p, u in reversed(list(enumerate(units, 1)))) + f" ELSE {n} || ' B' END"


_GEO = "CASE WHEN event_id % 3 <> 0 THEN {0} WHEN event_id % 2 = 0 THEN {1} END"
GUARDED = f"{KEPT}, {SEEN}, protected AS ({FQ.PROTECTION})"
PLAN = """SELECT
        path, group_id,
        CASE WHEN is_keeper THEN 'keep' WHEN level = 'NeverDelete' THEN 'protected' WHEN problem IS NOT NULL THEN 'changed'
        ELSE 'quarantine' END AS action,
        CASE WHEN is_keeper THEN '' WHEN level = 'NeverDelete' THEN reason WHEN problem IS NOT NULL THEN problem ELSE 'user-cleaned' END AS reason
        FROM members LEFT JOIN protected USING (path) LEFT JOIN changed USING (path)"""

SQL = {
    "simhash": f"WITH {PRINTS} SELECT id AS doc_id, p, d FROM prints",
    "embedding_sign_bits": """SELECT vec_id, (sum(CASE WHEN embedding[i + 1] > 0 THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT
        ELSE 1::HUGEINT << i::INT END ELSE 0 END))::BIGINT AS p FROM embeddings, range(64) r(i) GROUP BY vec_id""",
    "hamming_join": f"""WITH {PRINTS}, reps AS (SELECT min(id) AS id, p, d FROM prints GROUP BY p, d) SELECT a.id AS a, b.id AS b,
        {_WHOLE.format('a', 'b')} AS distance FROM reps a JOIN reps b ON a.id < b.id WHERE {_WHOLE.format('a', 'b')} <= 10""",
    "near_duplicate_groups": _near("SELECT id, group_id, files, avg_similarity, confidence, size_bytes, keeper FROM near"),
    "protect_prior_keepers": _near("""SELECT id, group_id, keeper, count(*) OVER (PARTITION BY group_id) AS files FROM (
        SELECT id, group_id, coalesce(max(CASE WHEN id % 4 = 0 AND id = keeper THEN id END) OVER w, min(CASE WHEN id % 4 = 0 THEN id END) OVER w,
        keeper) AS keeper FROM near WINDOW w AS (PARTITION BY group_id))
        WHERE id % 4 <> 0 OR id = keeper QUALIFY files > 1"""),
    "reference_filter": _with(KEPT, """SELECT group_id, size_bytes, path, k.p AS keeper_path, path = k.p AS is_keeper FROM members
        JOIN (SELECT group_id, min({'o': string_split(path, '/'), 'p': path}) FILTER (WHERE starts_with(path, '/data/r0/')) AS k FROM members
        GROUP BY group_id HAVING bool_or(NOT starts_with(path, '/data/r0/')) AND k IS NOT NULL) USING (group_id)"""),
    "isolate_filter": _with(KEPT, """SELECT group_id, path FROM members WHERE group_id IN (SELECT group_id FROM members
        GROUP BY group_id HAVING bool_or(starts_with(path, '/data/r0/')) AND bool_or(starts_with(path, '/data/r1/')))"""),
    "top_groups": _with(KEPT, f"""SELECT *, {_size('freed', 1000, ('KB', 'MB', 'GB'), '{:.2f}')} AS freed_text FROM (SELECT group_id,
        {FQ.NAME.replace('path', 'keeper_path')} AS name, upper(coalesce({FQ.EXT.replace('path', 'keeper_path')}, '')) AS ext, count(*) AS n,
        (max(size_bytes) * (count(*) - 1))::BIGINT AS freed FROM members GROUP BY group_id, keeper_path ORDER BY freed DESC, group_id LIMIT 5)"""),
    "changed_since_scan": _with(SEEN, "SELECT * FROM changed"),
    "cleanup_plan": _with(GUARDED, PLAN),
    "selection_ordinals": _with(KEPT, """SELECT group_id, path, row_number() OVER (PARTITION BY group_id ORDER BY string_split(path, '/'),
        path) AS member_no, dense_rank() OVER (ORDER BY size_bytes, group_id) AS group_no FROM members"""),
    "cache_invalidate": _with(CACHE, """SELECT digest, count(*) AS n FROM cache WHERE physical_key NOT IN (SELECT physical_key FROM entries
        WHERE readonly) GROUP BY digest"""),
    "cache_prune": _with(CACHE, f"SELECT count(*) AS n, min(created_at) AS oldest FROM cache WHERE created_at >= {NOW} - 30 * 86400"),
    "cache_latest": _with(CACHE, "SELECT physical_key, size_bytes, max(created_at) AS created_at FROM cache GROUP BY physical_key, size_bytes"),
    "cache_probe": _with(CACHE, """SELECT e.path, CASE WHEN l.mtime_ns = e.mtime_ns
        AND (l.ctime_ns = e.ctime_ns OR l.ctime_ns IS NULL OR e.ctime_ns IS NULL) THEN digest END AS digest
        FROM (SELECT * FROM entries WHERE kind = 'File') e LEFT JOIN (
          SELECT physical_key, size_bytes, m.mtime_ns, m.ctime_ns, m.digest FROM (SELECT physical_key, size_bytes,
          max({'o': created_at, 'mtime_ns': mtime_ns, 'c': coalesce(ctime_ns, -1), 'digest': digest, 'ctime_ns': ctime_ns}) AS m FROM cache
          GROUP BY 1, 2)) l
        ON l.physical_key = e.physical_key AND l.size_bytes = e.size_bytes"""),
    "quarantine_sessions": _with(JOURNAL, f"""SELECT session_id, mode, CASE WHEN mode = 'junk' THEN 'Junk'
        ELSE mode END || ' cleanup · ' || path AS label, {PARENT} AS source_path, moved_at AS cleaned_at, files, bytes FROM (
        SELECT session_id, f.path AS path, f.moved_at AS moved_at, CASE WHEN contains(f.reason, 'junk') THEN 'junk' WHEN contains(f.reason,
        'similar') THEN 'similar' ELSE 'exact' END AS mode, files, bytes
        FROM (SELECT session_id, min({{'id': id, 'reason': reason, 'path': path, 'moved_at': moved_at}}) AS f, count(*) AS files,
        sum(size_bytes)::BIGINT AS bytes FROM journal GROUP BY session_id))"""),
    "quarantine_by_reason": _with(JOURNAL, "SELECT path, reason FROM journal WHERE reason LIKE 'exact%'"),
    "quarantine_expired": _with(JOURNAL, "SELECT path, purge_at FROM journal WHERE purge_at < '2023-12-25 00:00:00'"),
    "quarantine_healed": _with(JOURNAL, "SELECT path FROM journal WHERE path IN (SELECT path FROM listing)"),
    "quarantine_strays": _with(JOURNAL, "SELECT path FROM listing WHERE path NOT IN (SELECT path FROM journal)"),
    "kept_files": _with("", """SELECT path, max(k) AS kept_at FROM (SELECT path, mtime_s AS k FROM entries WHERE mtime_s % 2 = 0
        UNION ALL SELECT path, mtime_s + 5 FROM entries WHERE mtime_s % 3 = 0) GROUP BY path"""),
    "takeout_metadata": f"""SELECT event_id, title, taken, latitude, longitude, floor(a)::BIGINT AS degrees,
        floor((a - floor(a)) * 60)::BIGINT AS minutes, round(((a - floor(a)) * 60 - floor((a - floor(a)) * 60)) * 6000)::BIGINT AS hundredths FROM (
        SELECT *, abs(latitude) AS a FROM (SELECT event_id, 'IMG_' || event_id || '.jpg' AS title, 1600000000 + event_id AS taken,
        ({_GEO.format('user_id % 90 + 0.25', '1.5')})::DOUBLE AS latitude, ({_GEO.format('-(user_id % 180) - 0.5', '2.75')})::DOUBLE AS longitude
        FROM events))""",
    "cluster_metrics": """SELECT *, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1
        FROM (
        SELECT *, round(CASE WHEN found_pairs > 0 THEN common_pairs / found_pairs ELSE 1 END, 9) AS precision, round(CASE
        WHEN true_pairs > 0 THEN common_pairs / true_pairs ELSE 1 END, 9) AS recall FROM (
          SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY lang)) AS found_pairs,
            (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY source)) AS true_pairs,
            (SELECT coalesce(sum(n * (n - 1) // 2), 0)::BIGINT FROM (SELECT count(*) AS n FROM documents GROUP BY lang, source)) AS common_pairs))""",
    "full_scan_summary": _with(f"{KEPT}, {REPORT}", f"""SELECT (SELECT count(*) FROM entries WHERE kind = 'File') AS total_files,
        (SELECT sum(size_bytes)::BIGINT FROM entries) AS total_bytes,
        (SELECT count(DISTINCT group_id) FROM members) AS exact_groups, (SELECT count(*) FROM members WHERE NOT is_keeper) AS exact_files,
        (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM members WHERE NOT is_keeper) AS exact_reclaimable,
        (SELECT count(DISTINCT group_id) FROM near) AS similar_groups, (SELECT count(*) FROM near WHERE id <> keeper) AS similar_files,
        (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM near WHERE id <> keeper) AS similar_reclaimable,
        (SELECT count(*) FROM report WHERE can_clean) AS hygiene_items, (SELECT coalesce(sum(size_bytes), 0)::BIGINT FROM report WHERE can_clean) AS hygiene_reclaimable""").replace("WITH ", "WITH RECURSIVE ", 1).replace(" SELECT (SELECT count(*) FROM entries", f", {NEAR} SELECT (SELECT count(*) FROM entries", 1),
    "fingerprint_functions": f"""WITH {PRINTS}, two AS (
          SELECT a.id, {_BLOCK.format('a', 'b')} AS block, bit_count(xor(a.p, b.p)) AS hamming, least({_BLOCK.format('a', 'b')}, bit_count(xor(a.d,
          b.p)) + 0.7e0 * bit_count(xor(a.p, b.d)), bit_count(xor(a.p, b.d)) + 0.7e0 * bit_count(xor(a.d, b.p))) AS aligned,
            bit_count(a.p) BETWEEN 10 AND 54 AND bit_count(a.d) BETWEEN 10 AND 54 AS varied, bit_count(xor(a.p, a.d)) * 1.7e0 AS own
          FROM prints a JOIN prints b ON b.id = a.id + 1)
        SELECT id, hamming, round(block, 6) AS block, round(aligned, 6) AS aligned, least(64, ceil(aligned))::INT AS whole, 1 - least(64,
        ceil(aligned)) / 64.0e0 AS similarity,
          CASE {' '.join(f"WHEN 1 - least(64, ceil(aligned)) / 64.0e0 >= {x} THEN '{t}'" for x, t in bits.LABELS)} ELSE '{bits.UNSURE}' END AS label,
          CASE WHEN id % 700 <= 128 THEN 4 WHEN id % 700 <= 256 THEN 6 WHEN id % 700 <= 512 THEN 8 ELSE 10 END AS limit, varied, CASE
          WHEN own <= 1 THEN 1 ELSE 2 END AS variants FROM two""",
    "shown_values": f"""SELECT o_orderkey, {_size('b', 1000, ('KB', 'MB', 'GB'), '{:.2f}')} AS two,
        {_size('b', 1000, ('KB', 'MB', 'GB'), '{:.1f}')} AS one, {_size('b', 1024, ('KB', 'MB', 'GB', 'TB'), '{:.1f}')} AS binary,
        CASE WHEN n < 60 THEN n || 's' WHEN n < 3600 THEN (n // 60) || 'm ' || (n % 60) || 's'
        ELSE (n // 3600) || 'h ' || (n % 3600 // 60) || 'm' END AS duration, {_CLOCK.format('n * 86400')} AS clock,
        1582977601::BIGINT AS iso, CASE WHEN n % 2 = 0 THEN 1614834367 END::BIGINT AS exif, ((DATE '1970-01-01') + (n % 20000)::INT)::VARCHAR AS day
        FROM (SELECT o_orderkey, o_orderkey AS n, o_orderkey * o_orderkey * o_orderkey AS b FROM orders)""",
}
