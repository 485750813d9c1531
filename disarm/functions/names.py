"""File-name column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last path element; trailing slashes are ignored, an empty path is ``.``, a path of slashes is ``/``."""
    trimmed = F.rtrim(path, F.lit("/"))
    of_folder = F.when(trimmed == "", "/").otherwise(F.substring_index(trimmed, "/", -1))
    return (
        F.when(path == "", ".")
        .when(F.endswith(path, F.lit("/")), of_folder)
        .otherwise(F.substring_index(path, "/", -1))
    )


def extension(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path element, or an empty string."""
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
