"""Which member of a group stays: scores of paths, names and folders, and strategies."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import dictionaries as D
from gleaner.functions import paths
from gleaner.functions.text import first_score, holds_any
from gleaner.operators.tables import written

WEIGHTS = {"path": 60, "name": 40, "siblings": 30, "readonly": 30, "older": 30, "derived": -200}
STRATEGIES = ("smart", "oldest", "newest", "shallowest", "shortest-path", "canonical", "manual")


def strategy_named(name: str) -> str:
    """The strategy of a preset; anything unknown is ``smart``."""
    name = name.lower()
    return name if name in STRATEGIES else "smart"


def path_score(path, depth, roots=()):
    """How likely a file belongs where it is. ``roots`` adds (pattern, score) of the user's own folders."""
    low = F.lower(paths.normalised(path))
    return (
        F.when(depth == 1, -60).when(depth.between(2, 4), 40).when(depth.between(5, 8), 0).otherwise(-30)
        + first_score(low, D.JUNK)
        + first_score(low, (*D.CANONICAL, *roots))
        + F.when(F.contains(paths.file_name(path), F.lit(".")), 15).otherwise(-15)
    ).cast("long")


def is_copy_name(stem):
    """Whether a lower-cased stem holds a mark of copies as a word of its own."""
    marks = "(?:" + "|".join(re.escape(m) for m in D.COPY_MARKS) + ")"
    return stem.rlike(f"^{marks}$|^{marks}[_ -]|[_ -]{marks}$|_{marks}_")


def looks_random(stem):
    size = F.octet_length(stem)
    digits = F.length(F.regexp_replace(stem, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(stem, "[^A-Za-z]", ""))
    vowels = F.length(F.regexp_replace(stem, "[^aeiouAEIOU]", ""))
    return (size >= 6) & (
        (digits * 2 >= size)
        | ((letters == 0) & (digits > 2))
        | ((letters > 4) & (vowels == 0))
        | ((size > 12) & (digits * 3 > size) & ~F.contains(stem, F.lit("-")) & ~F.contains(stem, F.lit(" ")))
    )


def has_year(stem):
    return F.exists(
        F.split(stem, r"[-_ .()\[\]]"), lambda w: w.rlike(r"^\+?0*(19|20)[0-9]{2}$")
    )


def name_score(path):
    """How much a name looks like one a person gave."""
    stem = paths.short_stem(path)
    low = F.lower(stem)
    dash, blank = F.contains(stem, F.lit("-")), F.contains(stem, F.lit(" "))
    inner = dash & (F.octet_length(stem) > 10) & ~F.startswith(stem, F.lit("-")) & ~F.endswith(stem, F.lit("-"))
    parts = (
        (is_copy_name(low), -60),
        (holds_any(low, ("(1)", "(2)", "(3)")), -50),
        (dash | blank, 20),
        (inner, 15),
        (F.octet_length(stem) < 5, -20),
        (F.contains(paths.file_name(path), F.lit(".")), 10),
        (looks_random(stem), -40),
        (has_year(stem), 15),
    )
    return reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0) for c, w in parts]).cast("long")


def _common(a, b):
    """Code points that two names have in common at their starts."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n == 0, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.left(a, i) == F.left(b, i))))


def sibling_scores(entries: DataFrame) -> DataFrame:
    """``(path, siblings, sibling_score)``: how well each entry fits into its folder.

    Folders are reduced to statistics once, combined before their shuffle, and joined back;
    an entry's own share is taken out of them. No entry is compared with another one.
    """
    path = F.col("path")
    rows = entries.select(
        "path", paths.parent(path).alias("folder"), paths.file_name(path).alias("name"), F.coalesce(F.lower(paths.extension(path)), F.lit("\0")).alias("ext"),
        F.contains(path, F.lit(" - ")).cast("int").alias("dash"), F.contains(path, F.lit("_")).cast("int").alias("under"),
    )
    size = F.octet_length("name")
    folders = rows.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.sum("dash").alias("dashes"), F.sum("under").alias("unders"), F.sum(size).alias("sizes"), F.min("name").alias("first")
    )
    kinds = rows.groupBy("folder", "ext").agg(F.count(F.lit(1)).alias("alike"))
    joined = rows.join(folders, "folder").join(kinds, ["folder", "ext"])
    others = F.col("n") - 1
    # Starts of names that more than half of a folder shares: at most two for each length.
    most = F.least(F.length("name"), F.lit(20))
    starts = rows.where(F.length("name") > 0).select("folder", F.explode(F.transform(F.sequence(F.lit(1), most), lambda i: F.left("name", i))).alias("start"))
    shared = starts.groupBy("folder", "start").agg(F.count(F.lit(1)).alias("k")).join(folders.select("folder", "n"), "folder")
    shared = shared.where(F.col("k") - 1 >= F.floor((F.col("n") - 1) / 2) + 1).groupBy("folder").agg(F.collect_list("start").alias("starts"))
    # The first name of a folder, and the one after it, against all others.
    second = joined.where(F.col("name") > F.col("first")).groupBy("folder").agg(F.min("name").alias("second"))
    sums = (
        joined.join(second, "folder")
        .groupBy("folder")
        .agg(
            F.sum(F.when(F.col("name") != F.col("first"), _common(F.col("first"), F.col("name"))).otherwise(0)).alias("to_first"),
            F.sum(F.when(~F.col("name").isin(F.col("first"), F.col("second")), _common(F.col("second"), F.col("name"))).otherwise(0)).alias("to_second"),
        )
    )
    full = joined.join(shared, "folder", "left").join(sums, "folder", "left")
    prefix = F.coalesce(F.array_max(F.transform(F.filter("starts", lambda s: F.startswith(F.col("name"), s)), lambda s: F.length(s))), F.lit(0))
    rest = F.when(F.col("name") == F.col("first"), F.col("to_second")).otherwise(F.col("to_first") - _common(F.col("first"), F.col("name")))
    fit = F.floor(rest / (others - 1))
    majority = F.floor(others / 2) + 1
    dashes, unders = F.col("dashes") - F.col("dash"), F.col("unders") - F.col("under")
    mean = (F.col("sizes") - size) / others
    off = F.abs(size - mean)
    alike = F.col("alike") - 1
    score = (
        F.when(alike >= others * 0.5, 25).when((F.col("ext") != "\0") & (alike == 0), -30).otherwise(0)
        + F.when(F.col("dash") == 0, 0).when(dashes >= majority, 20).when(dashes < 2, -15).otherwise(0)
        + F.when(F.col("under") == 0, 0).when(unders >= majority, 15).when(unders < 2, -15).otherwise(0)
        + F.when(prefix >= 4, 20).when((prefix == 0) & (others >= 3) & (fit >= 4), -25).otherwise(0)
        + F.when(off < mean * 0.3, 10).when(off > mean * 1.5, -15).otherwise(0)
    )
    return full.select("path", others.cast("long").alias("siblings"), F.when(others < 2, 0).otherwise(score).cast("long").alias("sibling_score"))


def scored_members(members: DataFrame, entries: DataFrame, weights=None) -> DataFrame:
    """``members(group_id, path, ...)`` with the parts of their scores and ``score``.

    Parts are weighted in hundredths, truncated towards zero.
    """
    w = {**WEIGHTS, **(weights or {})}
    known = entries.select("path", "depth", "readonly", "mtime_s")
    joined = members.select("group_id", "size_bytes", "path").join(known, "path").join(sibling_scores(entries).select("path", "sibling_score"), "path", "left")
    joined = written(joined, "scored")
    latest = joined.groupBy("group_id").agg(F.max("mtime_s").alias("latest"))
    joined = joined.join(latest, "group_id")
    path = F.col("path")
    part = lambda c, k: (c * w[k] / 100).cast("long")
    joined = joined.withColumns({"path_score": path_score(path, F.col("depth")), "name_score": name_score(path), "sibling_score": F.coalesce("sibling_score", F.lit(0))})
    return joined.withColumn(
        "score",
        part(F.col("path_score"), "path")
        + part(F.col("name_score"), "name")
        + part(F.col("sibling_score"), "siblings")
        + F.when(paths.lower_extension(path).isin(*D.DERIVED_EXTENSIONS), w["derived"]).otherwise(0)
        + F.when(F.col("readonly"), w["readonly"]).otherwise(0)
        + F.when(F.col("mtime_s") < F.col("latest"), w["older"]).otherwise(0),
    )


def _order(strategy: str):
    """What to keep the least of."""
    path = F.col("path")
    return {
        "smart": -F.col("score"),
        "oldest": F.coalesce("mtime_s", F.lit(0)),
        "newest": -F.coalesce("mtime_s", F.lit(0)),
        "shallowest": F.col("depth").cast("long"),
        "shortest-path": F.octet_length("path").cast("long"),
        "canonical": -F.col("path_score"),
        "manual": F.lit(0).cast("long"),
    }[strategy], paths.components(path)


def _best(strategy: str):
    value, order = _order(strategy)
    return F.min(F.struct(value.alias("v"), order.alias("o"), F.col("path").alias("p")))


def keepers(scored: DataFrame, strategy: str = "smart") -> DataFrame:
    """``(group_id, keeper_path)``; of equals, the first path component by component."""
    return scored.groupBy("group_id").agg(_best(strategy_named(strategy)).alias("b")).select("group_id", F.col("b.p").alias("keeper_path"))


def keepers_by_strategy(scored: DataFrame) -> DataFrame:
    """``(group_id, strategy, keeper_path)`` for every strategy, in one pass."""
    best = scored.groupBy("group_id").agg(*[_best(s).alias(f"b{i}") for i, s in enumerate(STRATEGIES)])
    each = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(f"b{i}.p").alias("keeper_path")) for i, s in enumerate(STRATEGIES)])
    return best.select("group_id", F.inline(each))


def with_keeper(members: DataFrame, entries: DataFrame, strategy: str = "smart") -> DataFrame:
    """Scored members with ``keeper_path`` and ``is_keeper``."""
    scored = written(scored_members(members, entries), "members")
    out = scored.join(keepers(scored, strategy), "group_id")
    return out.withColumn("is_keeper", F.col("path") == F.col("keeper_path"))
