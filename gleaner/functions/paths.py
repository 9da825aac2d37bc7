"""Parts of paths. ``path`` arguments are columns of absolute paths with ``/``."""

from __future__ import annotations

from pyspark.sql import functions as F

_EXTENSION = r"^.+\.([^.]*)$"


def file_name(path):
    return F.regexp_extract(path, r"([^/]+)/*$", 1)


def extension(path):
    """What follows the last dot of the name; null without a dot, or with only a leading one."""
    name = file_name(path)
    return F.when(name.rlike(_EXTENSION), F.regexp_extract(name, _EXTENSION, 1))


def lower_extension(path):
    return F.coalesce(F.lower(extension(path)), F.lit(""))


def file_stem(path):
    """The name without its extension; ``.bashrc`` stays whole."""
    name = file_name(path)
    return F.when(name.rlike(_EXTENSION), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)


def short_stem(path):
    """The name up to its last dot, wherever that is: that of ``.bashrc`` is empty."""
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def parent(path):
    return F.regexp_replace(path, r"/[^/]+/*$", "")


def under(path, prefix):
    """Whether ``path`` is ``prefix`` or lies below it, component by component."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def components(path):
    """An array by which paths sort component by component."""
    return F.split(path, "/")


def with_extension(path, new):
    """The path with another extension in place of its own, if it has one."""
    return F.concat_ws("/", parent(path), F.concat(file_stem(path), F.lit("."), new))


def normalised(path, case_sensitive: bool = True):
    out = F.replace(path, F.lit("\\"), F.lit("/"))
    return out if case_sensitive else F.lower(out)
