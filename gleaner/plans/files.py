"""Queries over the inventory: discovery, exact duplicates, keepers, hygiene."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import categories, hashing, paths, text
from gleaner.functions import dictionaries as D
from gleaner.operators import exact, hygiene, keeper, protection
from gleaner.sources import inventory
from gleaner.sources.inventory import NOW, entries


def _over(make):
    return lambda spark, sf_dir: make(entries(spark, sf_dir))


def _regions(e):
    data = F.col("content").cast("binary")
    files = exact.regular_files(e)
    return files.select(
        "path",
        hashing.digest(hashing.prefix(data, 100)).alias("head"),
        hashing.digest(hashing.suffix(data, 100)).alias("tail"),
        hashing.digest(hashing.middle(data, 50, 100)).alias("middle"),
        hashing.digest(hashing.head_tail(data)).alias("head_tail"),
        hashing.digest(hashing.sampled(data, ((0, 10), (100, 20)))).alias("sampled"),
        hashing.digest(data).alias("full"),
        hashing.region_covers(F.col("size_bytes"), 8192).alias("covered"),
        hashing.from_hex(F.col("path")).isNull().alias("not_hex"),
    )


def _parts(e):
    p = F.col("path")
    return e.select(
        "root_id", "path", "kind", "depth", paths.file_name(p).alias("name"), paths.extension(p).alias("extension"), paths.file_stem(p).alias("file_stem"),
        paths.short_stem(p).alias("short_stem"), paths.parent(p).alias("parent"), paths.under(p, "/data/r0/a").alias("under_a"), paths.normalised(p, False).alias("normalised"),
    )


def _exact(e):
    members = keeper.with_keeper(exact.confirmed_members(e), e)
    return members.select("group_id", "size_bytes", "path", "path_score", "name_score", "sibling_score", "score", "keeper_path", "is_keeper")


def _strategies(e):
    return keeper.keepers_by_strategy(keeper.scored_members(exact.confirmed_members(e), e))


def _compare(e):
    cached = e.where(F.col("mtime_s") % 2 == 0)
    members = exact.full_members(e)
    out = None
    for mode in ("always", "cached_only", "never"):
        found = exact.byte_compare(e, members, mode, cached).groupBy("verdict").agg(F.count(F.lit(1)).alias("n")).withColumn("mode", F.lit(mode))
        out = found if out is None else out.unionByName(found)
    return out


QUERIES = {
    "discover": _over(lambda e: e.select("root_id", "path", "kind", "depth", "size_bytes", "readonly", "mtime_s", "mtime_ns", "ctime_ns", "physical_key")),
    "discovery_summary": _over(exact.discovery_summary),
    "path_parts": _over(_parts),
    "excluded_prefixes": _over(lambda e: protection.without_excluded(e, ("/data/r0/a/b", "/data/r1/tmp")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))),
    "file_categories": _over(lambda e: exact.regular_files(e).groupBy(categories.category(F.col("path")).alias("category")).agg(F.count(F.lit(1)).alias("n"), F.sum("size_bytes").alias("bytes"))),
    "similar_candidates": _over(lambda e: categories.similar_candidates(e).select("path", "size_bytes")),
    "blacklist": _over(lambda e: hygiene.with_blacklist(e).select("path", "blacklisted")),
    "protection": _over(lambda e: protection.classified(e).select("path", "level", "reason", "flags_readonly")),
    "hash_regions": _over(_regions),
    "physical_files": _over(exact.physical_files),
    "hardlink_clusters": _over(exact.hardlink_clusters),
    "physical_summary": _over(exact.physical_summary),
    "empty_file_entries": _over(lambda e: exact.empty_files(e).select("path")),
    "size_groups": _over(lambda e: exact.size_groups(exact.physical_files(e))),
    "partial_hash": _over(lambda e: exact.partial_members(e).select("path", "size_bytes", "n_files")),
    "partial_hash_head_only": _over(lambda e: exact.partial_members(e, True).select("path", "size_bytes", "n_files")),
    "full_hash": _over(lambda e: exact.full_members(e).select("group_id", "path", "size_bytes", "n_files")),
    "byte_compare": _over(_compare),
    "exact_summary": _over(exact.exact_summary),
    "exact_duplicates": _over(_exact),
    "keeper_strategies": _over(_strategies),
    "path_scores": _over(lambda e: e.select("path", keeper.path_score(F.col("path"), F.col("depth")).alias("path_score"), keeper.name_score(F.col("path")).alias("name_score"))),
    "sibling_scores": _over(keeper.sibling_scores),
    "keeper_notes": _over(lambda e: e.select("path", text.keeper_note(F.col("path")).alias("note"))),
    "hygiene_empty_files": _over(hygiene.empty_files),
    "hygiene_empty_directories": _over(hygiene.empty_directories),
    "hygiene_temporary_files": _over(lambda e: hygiene.temporary_files(e, NOW)),
    "hygiene_broken_symlinks": _over(hygiene.broken_symlinks),
    "hygiene_cache_directories": _over(hygiene.cache_directories),
    "hygiene_system_junk": _over(hygiene.system_junk),
    "hygiene_orphan_sidecars": _over(hygiene.orphan_sidecars),
    "hygiene_report": _over(lambda e: hygiene.report(e, NOW)),
    "hygiene_by_category": _over(lambda e: hygiene.by_category(hygiene.report(e, NOW))),
    "hygiene_by_risk": _over(lambda e: hygiene.by_risk(hygiene.report(e, NOW))),
    "hygiene_cleanup": _over(lambda e: hygiene.cleanup(hygiene.report(e, NOW))),
}


# The same in SQL.


def _q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


def _holds(column: str, values) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(v)})" for v in values) + ")"


def _scores(column: str, scores) -> str:
    return "CASE " + " ".join(f"WHEN contains({column}, {_q(p)}) THEN {s}" for p, s in scores) + " ELSE 0 END"


NAME = r"regexp_extract(path, '([^/]+)/*$', 1)"
PARENT = r"regexp_replace(path, '/[^/]+/*$', '')"
EXT = rf"CASE WHEN regexp_matches({NAME}, '^.+\.[^.]*$') THEN regexp_extract({NAME}, '^.+\.([^.]*)$', 1) END"
LOW_EXT = f"coalesce(lower({EXT}), '')"
STEM = rf"CASE WHEN regexp_matches({NAME}, '^.+\.[^.]*$') THEN regexp_extract({NAME}, '^(.+)\.[^.]*$', 1) ELSE {NAME} END"
SHORT = rf"regexp_replace({NAME}, '\.[^.]*$', '')"
LOW = r"lower(replace(path, '\', '/'))"

PHYSICAL = """
regular AS (SELECT * FROM entries WHERE kind = 'File'),
physical AS (
  SELECT physical_key, f.p AS path, f.s AS size_bytes, links FROM (
    SELECT physical_key, min({'c': string_split(path, '/'), 'r': root_id, 'p': path, 's': size_bytes}) AS f, count(*) AS links
    FROM regular WHERE size_bytes > 0 GROUP BY physical_key)
), cand AS (
  SELECT p.*, r.content FROM physical p JOIN regular r ON p.path = r.path
  WHERE p.size_bytes IN (SELECT size_bytes FROM physical GROUP BY size_bytes HAVING count(*) > 1)
), part AS (
  SELECT *, count(*) OVER (PARTITION BY size_bytes, ph) AS n_files FROM (
    SELECT *, CASE WHEN size_bytes <= 8192 THEN hex(encode(content)) ELSE substr(hex(encode(content)), 1, 8192) || right(hex(encode(content)),
    8192) END AS ph FROM cand)
  QUALIFY n_files > 1
), matched AS (
  SELECT *, sha2id AS group_id FROM (
    SELECT path, size_bytes, ph, content, count(*) OVER (PARTITION BY size_bytes, ph, content) AS n_files,
    sha256(size_bytes || ':' || sha256(content)) AS sha2id FROM (SELECT path, size_bytes, ph, content FROM part))
  WHERE n_files > 1
)"""
PATH_SCORE = f"""(CASE WHEN depth = 1 THEN -60 WHEN depth BETWEEN 2 AND 4 THEN 40 WHEN depth BETWEEN 5 AND 8 THEN 0 ELSE -30 END
 + {_scores(LOW, D.JUNK)} + {_scores(LOW, D.CANONICAL)} + CASE WHEN contains({NAME}, '.') THEN 15 ELSE -15 END)"""


def _marked() -> str:
    s = f"lower({SHORT})"
    out = []
    for m in D.COPY_MARKS:
        out.append(f"{s} = {_q(m)}")
        out += [f"starts_with({s}, {_q(m + x)})" for x in "_ -"] + [f"ends_with({s}, {_q(x + m)})" for x in "_ -"] + [f"contains({s}, {_q('_' + m + '_')})"]
    return " OR ".join(out)


_LEN = f"strlen({SHORT})"
_DIGITS = f"length(regexp_replace({SHORT}, '[^0-9]', '', 'g'))"
_LETTERS = f"length(regexp_replace({SHORT}, '[^A-Za-z]', '', 'g'))"
_VOWELS = f"length(regexp_replace({SHORT}, '[^aeiouAEIOU]', '', 'g'))"
NAME_SCORE = rf"""(CASE WHEN {_marked()} THEN -60 ELSE 0 END + CASE WHEN {_holds(f'lower({SHORT})', ('(1)', '(2)', '(3)'))} THEN -50 ELSE 0 END
 + CASE WHEN contains({SHORT}, '-') OR contains({SHORT}, ' ') THEN 20 ELSE 0 END
 + CASE WHEN contains({SHORT}, '-') AND {_LEN} > 10 AND NOT starts_with({SHORT}, '-') AND NOT ends_with({SHORT}, '-') THEN 15 ELSE 0 END
 + CASE WHEN {_LEN} < 5 THEN -20 ELSE 0 END + CASE WHEN contains({NAME}, '.') THEN 10 ELSE 0 END
 + CASE WHEN {_LEN} >= 6 AND ({_DIGITS} * 2 >= {_LEN} OR ({_LETTERS} = 0 AND {_DIGITS} > 2) OR ({_LETTERS} > 4 AND {_VOWELS} = 0)
     OR ({_LEN} > 12 AND {_DIGITS} * 3 > {_LEN} AND NOT contains({SHORT}, '-') AND NOT contains({SHORT}, ' '))) THEN -40 ELSE 0 END
 + CASE WHEN regexp_matches({SHORT}, '(^|[-_ .()\[\]])\+?0*(19|20)[0-9][0-9]($|[-_ .()\[\]])') THEN 15 ELSE 0 END)"""

SIBLINGS = f"""
named AS (SELECT path, {PARENT} AS folder, {NAME} AS name, lower({EXT}) AS ext FROM entries),
facts AS (
  SELECT a.path, any_value(a.name) AS name, any_value(a.ext) AS ext, count(*) AS n, count(*) FILTER (WHERE a.ext IS NOT DISTINCT FROM b.ext) AS alike,
         count(*) FILTER (WHERE contains(b.path, ' - ')) AS dashes, count(*) FILTER (WHERE contains(b.path, '_')) AS unders,
         sum(strlen(b.name)) / count(*) AS mean, list(b.name ORDER BY b.name) AS others
  FROM named a JOIN named b ON a.folder = b.folder AND a.path <> b.path GROUP BY a.path
), more AS (
  SELECT *, n // 2 + 1 AS majority,
         coalesce(list_max(list_filter(range(1, least(length(name), 20) + 1), lambda i: len(list_filter(others, lambda o: left(o, i::INT) = left(name,
         i::INT))) >= n // 2 + 1)), 0) AS prefix,
         CASE WHEN n > 1 THEN floor(list_sum(list_transform(others[2:], lambda o: len(list_filter(range(1, least(length(o), length(others[1])) + 1),
         lambda i: left(o, i::INT) = left(others[1], i::INT))))) / (n - 1)) END AS fit
  FROM facts
), sibling AS (
  SELECT path, n AS siblings, CASE WHEN n < 2 THEN 0 ELSE
    CASE WHEN alike >= n * 0.5 THEN 25 WHEN ext IS NOT NULL AND alike = 0 THEN -30 ELSE 0 END
    + CASE WHEN NOT contains(path, ' - ') THEN 0 WHEN dashes >= majority THEN 20 WHEN dashes < 2 THEN -15 ELSE 0 END
    + CASE WHEN NOT contains(path, '_') THEN 0 WHEN unders >= majority THEN 15 WHEN unders < 2 THEN -15 ELSE 0 END
    + CASE WHEN prefix >= 4 THEN 20 WHEN prefix = 0 AND n >= 3 AND fit >= 4 THEN -25 ELSE 0 END
    + CASE WHEN abs(strlen(name) - mean) < mean * 0.3 THEN 10 WHEN abs(strlen(name) - mean) > mean * 1.5 THEN -15 ELSE 0 END END AS sibling_score
  FROM more
  UNION ALL SELECT path, 0, 0 FROM named WHERE path NOT IN (SELECT path FROM facts)
)"""
SCORED = f"""
{PHYSICAL}, {SIBLINGS},
scored AS (
  SELECT m.group_id, m.size_bytes, path, e.depth, e.mtime_s, {PATH_SCORE} AS path_score, {NAME_SCORE} AS name_score, sibling_score, readonly,
         max(e.mtime_s) OVER (PARTITION BY m.group_id) AS latest
  FROM matched m JOIN entries e USING (path) JOIN sibling s USING (path)
), total AS (
  SELECT *, (trunc(path_score * 60 / 100.0) + trunc(name_score * 40 / 100.0) + trunc(sibling_score * 30 / 100.0)
    + CASE WHEN {LOW_EXT} IN {_list(D.DERIVED_EXTENSIONS)} THEN -200 ELSE 0 END + CASE WHEN readonly THEN 30 ELSE 0 END + CASE
    WHEN mtime_s < latest THEN 30 ELSE 0 END)::BIGINT AS score
  FROM scored
)"""
LISTED = rf"""listed AS (
  SELECT *, (regexp_matches(path, '/\.(git|hg|svn|bzr)(/|$)') OR {NAME} = '.nomedia'
    OR (contains(path, 'node_modules') AND {PARENT} IN (SELECT {PARENT} FROM entries WHERE {NAME} IN {_list(D.LOCK_FILES)}))) AS blacklisted
  FROM entries
), allowed AS (SELECT * FROM listed WHERE NOT blacklisted)"""
SYSTEM = "(" + " OR ".join(f"starts_with({NAME}, {_q(p) if chr(13) not in p else _q(p[:-1]) + ' || chr(13)'})" for p in D.SYSTEM_NAMES) + ")"


def _sidecar_sql() -> str:
    wanted, why = [], []
    base = f"({PARENT} || '/' || ({STEM}) || '.')"
    for suffix, reason, options in D.SIDECARS:
        wanted.append(f"WHEN ends_with(path, {_q(suffix)}) THEN list_transform([{', '.join(_q(x) for x in options)}], lambda x: {base} || x)")
        why.append(f"WHEN ends_with(path, {_q(suffix)}) THEN {_q(reason)}")
    takeout = r"\.(" + "|".join(f"{x}|{x.upper()}" for x in D.TAKEOUT_EXTENSIONS) + r")\.json$"
    wanted.append(r"WHEN ends_with(path, '.supplemental-metadata.json') THEN [regexp_replace(path, '\.supplemental-metadata\.json$', '')]")
    wanted.append(rf"WHEN regexp_matches(path, '{takeout}') THEN [regexp_replace(path, '\.json$', '')]")
    why.append(f"ELSE {_q('companion media file was deleted (Google Takeout metadata)')}")
    return f"""SELECT path, 'Orphan Sidecars' AS category, 'Medium' AS risk, coalesce(size_bytes, 0) AS size_bytes,
        'Orphan sidecar: ' || ({STEM}) || ' ' || why AS explanation, true AS can_clean
  FROM (SELECT *, CASE {' '.join(wanted)} END AS wanted, CASE {' '.join(why)} END AS why FROM entries)
  WHERE wanted IS NOT NULL AND NOT list_has_any(wanted, (SELECT list(path) FROM entries))"""


JUNK = {
    "empty_files": """SELECT path, 'Empty Files' AS category, 'Low' AS risk, 0::BIGINT AS size_bytes, 'Empty file (0 bytes)' AS explanation,
        true AS can_clean FROM allowed WHERE kind = 'File' AND size_bytes = 0""",
    "empty_directories": f"""SELECT DISTINCT path, 'Empty Directories' AS category, 'Low' AS risk, coalesce(size_bytes, 0) AS size_bytes,
      CASE WHEN path IN (SELECT {PARENT} FROM entries) THEN 'Directory contains only empty subdirectories' ELSE 'Empty directory' END AS explanation,
      true AS can_clean
      FROM entries d WHERE kind = 'Directory' AND NOT EXISTS (SELECT 1 FROM entries f WHERE f.kind = 'File' AND starts_with(f.path, d.path || '/')
      AND NOT {SYSTEM.replace('path', 'f.path')})""",
    "temporary_files": f"""SELECT path, 'Temporary Files' AS category, CASE WHEN trunc(({NOW} - mtime_s) / 86400) > 30 THEN 'Low'
        ELSE 'Medium' END AS risk, size_bytes,
      CASE WHEN starts_with(name, '~$') THEN 'Office lock file: ' || name WHEN ends_with(name, '~') THEN 'Editor backup file: ' || name
      WHEN starts_with(name, 'core.') THEN 'Crash dump: ' || name
           WHEN ext IN {_list(D.SWAP_EXTENSIONS)} THEN 'Vim swap file: ' || name ELSE 'Temporary file (.' || ext || '): ' || name END AS explanation,
      trunc(({NOW} - mtime_s) / 86400) > 30 AS can_clean
      FROM (SELECT *, {NAME} AS name, {LOW_EXT} AS ext FROM allowed WHERE kind = 'File')
      WHERE ext IN {_list(D.TEMPORARY_EXTENSIONS)} OR starts_with(name, '~$') OR ends_with(name, '~') OR starts_with(name, 'core.')""",
    "broken_symlinks": f"""SELECT path, 'Broken Symlinks' AS category, 'Medium' AS risk, 0::BIGINT AS size_bytes,
        'Broken symlink → ' || link_target AS explanation, false AS can_clean
      FROM allowed WHERE kind = 'Symlink' AND CASE WHEN starts_with(link_target, '/') THEN link_target
      ELSE {PARENT} || '/' || link_target END NOT IN (SELECT path FROM entries)""",
    "cache_directories": f"""SELECT path, 'Cache Files' AS category, 'High' AS risk, 0::BIGINT AS size_bytes,
        'Development cache directory: ' || {NAME} AS explanation, false AS can_clean
      FROM allowed WHERE kind = 'Directory' AND {NAME} IN {_list(D.CACHE_DIRS)} AND NOT ({NAME} = '.venv'
      AND {PARENT} || '/pyproject.toml' IN (SELECT path FROM entries))""",
    "system_junk": f"""SELECT path, 'System Junk' AS category, 'Low' AS risk, size_bytes, 'System metadata file: ' || {NAME} AS explanation,
        true AS can_clean
      FROM entries WHERE kind = 'File' AND ({SYSTEM} OR {_holds('path', D.SYSTEM_PATHS)})""",
    "orphan_sidecars": _sidecar_sql(),
}
REPORT = LISTED + ", report AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM ({s})" for s in JUNK.values()) + ") WHERE path IN (SELECT path FROM allowed))"


def _with(ctes: str, select: str) -> str:
    return f"WITH {inventory.SQL}{', ' + ctes if ctes else ''} {select}"


def _best(strategy: str, value: str) -> str:
    return f"""SELECT group_id, min({{'v': {value}, 'o': string_split(path, '/'), 'p': path}}).p AS keeper_path, '{strategy}' AS strategy FROM total
        GROUP BY group_id"""


def _comparison(mode: str) -> str:
    verdict = {
        "always": "'confirmed'", "never": "'trusted'",
        "cached_only": "CASE WHEN bool_or(e.mtime_s % 2 = 0) OVER (PARTITION BY group_id) THEN 'confirmed' ELSE 'trusted' END",
    }[mode]
    return f"""SELECT verdict, count(*) AS n, '{mode}' AS mode FROM (SELECT {verdict} AS verdict FROM matched m JOIN entries e USING (path))
        GROUP BY verdict"""


_ROLL = """SELECT category, count(*) AS n, coalesce(sum(size_bytes), 0)::BIGINT AS bytes FROM report GROUP BY category UNION ALL SELECT 'TOTAL',
    count(*), coalesce(sum(size_bytes), 0)::BIGINT FROM report"""
_SHARE = "CASE WHEN count(*) > 0 THEN round(100.0 * count(*) FILTER (WHERE risk = '{0}') / count(*), 4) ELSE 0 END::DOUBLE AS {1}_pct"

PROTECTION = f"""SELECT path, CASE WHEN (mode & 2048) <> 0 OR (mode & 1024) <> 0 OR kind = 'Symlink' THEN 'NeverDelete'
        WHEN {LOW_EXT} IN {_list(D.SYSTEM_EXTENSIONS)} AND {_holds('lower(path)', D.WINDOWS_DIRS + D.UNIX_DIRS)} THEN 'NeverDelete'
        WHEN {_holds('lower(path)', D.PASSING_DIRS)} THEN 'WarnBefore' ELSE 'Allow' END AS level,
        CASE WHEN kind = 'Symlink' THEN 'Symlink — cannot safely modify: ' WHEN (mode & 2048) <> 0 THEN 'Setuid binary — system critical: '
        WHEN (mode & 1024) <> 0 THEN 'Setgid binary — system critical: '
          WHEN {LOW_EXT} IN {_list(D.SYSTEM_EXTENSIONS)} THEN CASE WHEN {_holds('lower(path)', D.WINDOWS_DIRS)} THEN 'System directory on Windows: '
          WHEN {_holds('lower(path)', D.UNIX_DIRS)} THEN 'System directory on Unix: ' ELSE 'Executable file — system critical: ' END
          ELSE 'Protected file: ' END || path AS reason, readonly AS flags_readonly FROM entries"""

SQL = {
    "discover": _with("", "SELECT root_id, path, kind, depth, size_bytes, readonly, mtime_s, mtime_ns, ctime_ns, physical_key FROM entries"),
    "discovery_summary": _with("", """SELECT count(*) FILTER (WHERE kind = 'File') AS files,
        count(*) FILTER (WHERE kind = 'Directory') AS directories, count(*) FILTER (WHERE kind = 'Symlink') AS symlinks, 0::BIGINT AS others,
        sum(size_bytes)::BIGINT AS total_file_bytes FROM entries"""),
    "path_parts": _with("", f"""SELECT root_id, path, kind, depth, {NAME} AS name, {EXT} AS extension, {STEM} AS file_stem, {SHORT} AS short_stem,
        {PARENT} AS parent, path = '/data/r0/a' OR starts_with(path, '/data/r0/a/') AS under_a, lower(path) AS normalised FROM entries"""),
    "excluded_prefixes": _with("", """SELECT kind, count(*) AS n FROM entries WHERE NOT (path = '/data/r0/a/b' OR starts_with(path,
        '/data/r0/a/b/') OR path = '/data/r1/tmp' OR starts_with(path, '/data/r1/tmp/')) GROUP BY kind"""),
    "file_categories": _with("", f"""SELECT CASE {' '.join(f'WHEN {LOW_EXT} IN {_list(x)} THEN {_q(c)}' for c, x in D.CATEGORIES)}
        ELSE 'Other' END AS category, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM entries WHERE kind = 'File' GROUP BY 1"""),
    "similar_candidates": _with("", f"SELECT path, size_bytes FROM entries WHERE size_bytes > 0 AND {LOW_EXT} IN {_list(D.IMAGE_EXTENSIONS)}"),
    "blacklist": _with(LISTED, "SELECT path, blacklisted FROM listed"),
    "protection": _with("", PROTECTION),
    "hash_regions": _with("", """SELECT path, sha256(unhex(substr(h, 1, 200))) AS head, sha256(unhex(right(h, 200))) AS tail, sha256(unhex(substr(h,
        101, 200))) AS middle,
        sha256(CASE WHEN size_bytes <= 8192 THEN unhex(h) ELSE unhex(substr(h, 1, 8192) || right(h, 8192)) END) AS head_tail,
        CASE WHEN size_bytes >= 120 THEN sha256(unhex(substr(h, 1, 20) || substr(h, 201, 40))) END AS sampled, sha256(content) AS full,
        size_bytes <= 8192 AS covered, true AS not_hex
        FROM (SELECT *, hex(encode(content)) AS h FROM entries WHERE kind = 'File')"""),
    "physical_files": _with(PHYSICAL, "SELECT * FROM physical"),
    "hardlink_clusters": _with(PHYSICAL, "SELECT * FROM physical WHERE links > 1"),
    "physical_summary": _with(PHYSICAL, """SELECT count(*) AS physical_files, count(*) FILTER (WHERE links > 1) AS hardlink_clusters,
        sum(links - 1)::BIGINT AS duplicate_paths_removed, (SELECT count(*) FROM regular WHERE coalesce(size_bytes, 0) = 0) AS empty_files,
        sum(links - 1) > 0 AS overlapping FROM physical"""),
    "empty_file_entries": _with("", "SELECT path FROM entries WHERE kind = 'File' AND coalesce(size_bytes, 0) = 0"),
    "size_groups": _with(PHYSICAL, "SELECT size_bytes, count(*) AS n_files FROM physical GROUP BY size_bytes HAVING count(*) > 1"),
    "partial_hash": _with(PHYSICAL, "SELECT path, size_bytes, n_files FROM part"),
    "partial_hash_head_only": _with(PHYSICAL, """SELECT path, size_bytes, count(*) OVER (PARTITION BY size_bytes, substr(hex(encode(content)), 1,
        8192)) AS n_files FROM cand QUALIFY n_files > 1"""),
    "full_hash": _with(PHYSICAL, "SELECT group_id, path, size_bytes, n_files FROM matched") ,
    "byte_compare": _with(PHYSICAL, " UNION ALL ".join(_comparison(m) for m in ("always", "cached_only", "never"))),
    "exact_summary": _with(PHYSICAL, """SELECT *, candidates - promoted_to_full AS eliminated_by_partial,
        promoted_to_full - confirmed_files AS eliminated_by_full FROM (
        SELECT (SELECT count(DISTINCT size_bytes) FROM cand) AS size_groups, (SELECT count(*) FROM cand) AS candidates, (SELECT count(*)
        FROM (SELECT DISTINCT size_bytes, ph FROM part)) AS partial_groups,
        (SELECT count(*) FROM part) AS promoted_to_full, (SELECT count(DISTINCT group_id) FROM matched) AS confirmed_groups, (SELECT count(*)
        FROM matched) AS confirmed_files,
        (SELECT coalesce(sum(s * (n - 1)), 0)::BIGINT FROM (SELECT max(size_bytes) AS s, count(*) AS n FROM matched
        GROUP BY group_id)) AS reclaimable)"""),
    "exact_duplicates": _with(SCORED, f"""SELECT group_id, size_bytes, path, path_score, name_score, sibling_score, score, keeper_path,
        path = keeper_path AS is_keeper FROM total JOIN ({_best('smart', '-score')}) USING (group_id)"""),
    "keeper_strategies": _with(SCORED, " UNION ALL ".join(_best(s, v) for s, v in (("smart", "-score"), ("oldest", "coalesce(mtime_s, 0)"), ("newest", "-coalesce(mtime_s, 0)"), ("shallowest", "depth"), ("shortest-path", "strlen(path)"), ("canonical", "-path_score"), ("manual", "0")))),
    "path_scores": _with("", f"SELECT path, {PATH_SCORE} AS path_score, {NAME_SCORE} AS name_score FROM entries"),
    "sibling_scores": _with(SIBLINGS, "SELECT * FROM sibling"),
    "keeper_notes": _with("", f"""SELECT path, CASE WHEN {_holds('lower(path)', ('copy', 'copia'))} THEN 'copy name'
        WHEN {_holds('lower(path)', ('(1)', '(2)'))} THEN 'numbered copy' WHEN contains(lower(path), 'backup') THEN 'backup'
        WHEN contains(lower(path), 'old') THEN 'old version' ELSE '' END AS note FROM entries"""),
    **{f"hygiene_{k}": _with(LISTED, s) for k, s in JUNK.items()},
    "hygiene_report": _with(REPORT, "SELECT * FROM report"),
    "hygiene_by_category": _with(REPORT, _ROLL),
    "hygiene_by_risk": _with(REPORT, f"""SELECT count(*) AS total_items,
        {', '.join(f'''count(*) FILTER (WHERE risk = '{r}') AS {r.lower()}''' for r in ('Low', 'Medium', 'High'))},
        {', '.join(_SHARE.format(r, r.lower()) for r in ('Low', 'Medium', 'High'))} FROM report"""),
    "hygiene_cleanup": _with(REPORT, """SELECT path, category, size_bytes, CASE WHEN risk = 'Low' THEN 'delete' ELSE 'quarantine' END AS action
        FROM report WHERE (risk = 'Low' AND can_clean) OR risk = 'Medium'"""),
}
