"""An inventory of files over the ``documents`` table.

Paths, sizes, times and physical identities are arithmetic on ``doc_id``, so that the same
tree can be told in SQL. A few directories, links and project files are added that no
document gives rise to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDERS = ("Pictures/2019", "Documents", "Downloads", "tmp", "backup/old", "Music/Artist - Album", "src/app/.git/objects", "a/b/c/d/e/f")
STEMS = ("IMG_", "Report 2019 - ", "notes_final_", "copy_", "x", "core.", "~$lock")
SUFFIXES = (".txt", ".jpg", ".tmp", ".jpg.json", ".xmp", ".CR2", "~", "", " (1).pdf", ".AAE")
#: The time that ages are told from.
NOW = 1_705_000_000

#: root, path, kind, size, where a link points
EXTRA = (
    (0, "/data/r0/empty_dir", "Directory", None, None),
    (0, "/data/r0/empty_dir/nested", "Directory", None, None),
    (0, "/data/r0/only_system", "Directory", None, None),
    (0, "/data/r0/only_system/Thumbs.db", "File", 64, None),
    (0, "/data/r0/proj", "Directory", None, None),
    (0, "/data/r0/proj/pyproject.toml", "File", 10, None),
    (0, "/data/r0/proj/.venv", "Directory", None, None),
    (0, "/data/r0/proj/__pycache__", "Directory", None, None),
    (0, "/data/r0/web", "Directory", None, None),
    (0, "/data/r0/web/package.json", "File", 20, None),
    (0, "/data/r0/web/node_modules.tmp", "File", 0, None),
    (0, "/data/r0/bin", "Directory", None, None),
    (0, "/data/r0/bin/tool.so", "File", 99, None),
    (1, "/data/r1/lone", "Directory", None, None),
    (1, "/data/r1/lone/.venv", "Directory", None, None),
    (1, "/data/r1/target", "Directory", None, None),
    (1, "/data/r1/target/.nomedia", "File", 0, None),
    (1, "/data/r1/photos", "Directory", None, None),
    (1, "/data/r1/photos/a.AAE", "File", 5, None),
    (1, "/data/r1/photos/a.HEIC", "File", 50, None),
    (1, "/data/r1/photos/b.AAE", "File", 5, None),
    (1, "/data/r1/photos/c.thm", "File", 6, None),
    (1, "/data/r1/photos/c.MP4", "File", 60, None),
    (1, "/data/r1/photos/d.jpg.supplemental-metadata.json", "File", 7, None),
    (0, "/data/r0/good_link", "Symlink", None, "/data/r0/Documents"),
    (0, "/data/r0/near_link", "Symlink", None, "proj/pyproject.toml"),
    (1, "/data/r1/bad_link", "Symlink", None, "/data/r1/none"),
)


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def files(docs: DataFrame) -> DataFrame:
    """A file for each document, with its content.

    Sizes are taken before files meet their links, so that queries that ask for no content shuffle none.
    """
    d = F.col("doc_id")
    root = (d % 2).cast("int")
    path = F.concat(F.lit("/data/r"), root.cast("string"), F.lit("/"), _pick(FOLDERS, d % 8), F.lit("/"), _pick(STEMS, d % 7), d.cast("string"), _pick(SUFFIXES, d % 10))
    firsts = docs.groupBy(F.md5("text").alias("__k")).agg(F.min("doc_id").alias("__first"))
    content = F.when(d % 41 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    own = docs.select("doc_id", F.md5("text").alias("__m"), content.alias("content"), F.octet_length(content).cast("long").alias("size_bytes"))
    linked = own.join(firsts, F.col("__m") == F.col("__k"), "left")
    mtime = 1_700_000_000 + d * 7919 % 5_000_000
    return linked.select(
        root.alias("root_id"),
        path.alias("path"),
        F.lit("File").alias("kind"),
        "content",
        (d % 11 == 0).alias("readonly"),
        mtime.alias("mtime_s"),
        (mtime * 1_000_000_000 + d % 1000).alias("mtime_ns"),
        F.when(d % 13 != 0, mtime * 1_000_000_000 + d % 1000 + 5).alias("ctime_ns"),
        F.concat(F.lit("ino:"), F.when(d % 3 == 0, F.coalesce("__first", d)).otherwise(d).cast("string")).alias("physical_key"),
        (33188 + F.when(d % 97 == 0, 2048).when(d % 89 == 0, 1024).otherwise(0)).cast("int").alias("mode"),
        F.lit(None).cast("string").alias("link_target"),
        "size_bytes",
    )


def _depth():
    return (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit(""))) - 2).cast("int")


COLUMNS = ("root_id", "path", "kind", "depth", "size_bytes", "readonly", "mtime_s", "mtime_ns", "ctime_ns", "physical_key", "mode", "link_target", "content")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole inventory: files, the directories above them, and the additional entries."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = files(docs)
    schema = T.StructType(
        [T.StructField("root_id", T.IntegerType()), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("size_bytes", T.LongType()), T.StructField("link_target", T.StringType())]
    )
    extra = spark.createDataFrame(list(EXTRA), schema)
    parts = F.split("path", "/")
    above = (
        found.select("root_id", F.explode(F.transform(F.sequence(F.lit(3), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path"))
        .distinct()
        .withColumn("kind", F.lit("Directory"))
    )
    plain = extra.unionByName(above, allowMissingColumns=True).withColumns(
        {
            "readonly": F.lit(False),
            "mtime_s": F.when(F.col("kind") == "File", F.lit(NOW - 3_600)).cast("long"),
            "physical_key": F.concat(F.lit("path:"), "path"),
            "mode": F.lit(33188),
            "content": F.when(F.col("kind") == "File", F.substring(F.repeat("path", 10), F.lit(1), F.coalesce("size_bytes", F.lit(0)).cast("int"))),
        }
    )
    everything = found.unionByName(plain, allowMissingColumns=True)
    return everything.withColumn("depth", _depth()).select(*COLUMNS)


def _case(values, index: str) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"([{listed}])[{index} + 1]"


_EXTRA = ", ".join(
    f"({r}, '{p}', '{k}', {'NULL' if s is None else s}::BIGINT, {'NULL' if t is None else repr(t)}::VARCHAR)" for r, p, k, s, t in EXTRA
)

#: The same tree as common table expressions; ``entries`` is the last of them.
SQL = f"""
__files AS (
  SELECT (doc_id % 2)::INT AS root_id,
         '/data/r' || (doc_id % 2) || '/' || {_case(FOLDERS, 'doc_id % 8')} || '/' || {_case(STEMS, 'doc_id % 7')} || doc_id || {_case(SUFFIXES, 'doc_id % 10')} AS path,
         'File' AS kind, CASE WHEN doc_id % 41 = 0 THEN '' ELSE coalesce(text, '') END AS content, doc_id % 11 = 0 AS readonly,
         1700000000 + doc_id * 7919 % 5000000 AS mtime_s,
         CASE WHEN doc_id % 3 = 0 THEN coalesce(min(doc_id) OVER (PARTITION BY text), doc_id) ELSE doc_id END AS ino, doc_id,
         (33188 + CASE WHEN doc_id % 97 = 0 THEN 2048 WHEN doc_id % 89 = 0 THEN 1024 ELSE 0 END)::INT AS mode
  FROM documents
), __extra(root_id, path, kind, size_bytes, link_target) AS (VALUES {_EXTRA}),
__above AS (
  SELECT DISTINCT root_id, array_to_string(string_split(path, '/')[1:n], '/') AS path
  FROM (SELECT root_id, path, unnest(range(3, len(string_split(path, '/')))) AS n FROM __files)
), __plain AS (
  SELECT * FROM __extra UNION ALL SELECT root_id, path, 'Directory', NULL, NULL FROM __above
), entries AS (
  SELECT root_id, path, kind, (length(path) - length(replace(path, '/', '')) - 2)::INT AS depth, strlen(content)::BIGINT AS size_bytes,
         readonly, mtime_s, mtime_s * 1000000000 + doc_id % 1000 AS mtime_ns,
         CASE WHEN doc_id % 13 <> 0 THEN mtime_s * 1000000000 + doc_id % 1000 + 5 END AS ctime_ns,
         'ino:' || ino AS physical_key, mode, NULL::VARCHAR AS link_target, content
  FROM __files
  UNION ALL
  SELECT root_id::INT, path, kind, (length(path) - length(replace(path, '/', '')) - 2)::INT, size_bytes, false,
         CASE WHEN kind = 'File' THEN {NOW - 3600} END, NULL, NULL, 'path:' || path, 33188, link_target,
         CASE WHEN kind = 'File' THEN substr(repeat(path, 10), 1, coalesce(size_bytes, 0)::INT) END
  FROM __plain
)
"""
