"""Predicates of a search scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import suffix
from ..schema import Orientation, SearchRequest


def oriented(orientation: Orientation) -> Column | None:
    w, h = F.col("width"), F.col("height")
    return {Orientation.ALL: None, Orientation.LANDSCAPE: w > h, Orientation.PORTRAIT: w < h, Orientation.SQUARE: w == h}[orientation]


def has_extension(extension: str, name: str = "name") -> Column:
    """The text after the last dot of the name, in any case; % and _ are only themselves."""
    return F.lower(suffix(name)) == extension.lower()


def scope(request: SearchRequest) -> Column | None:
    """Folder, favorites, orientation and extension, all of them."""
    wanted = []
    if request.extension:
        wanted.append(has_extension(request.extension))
    if request.favorites:
        wanted.append(F.col("favorite"))
    if request.folder:
        wanted.append(F.col("folder") == request.folder)
    if (shape := oriented(request.orientation)) is not None:
        wanted.append(shape)
    return reduce(lambda a, b: a & b, wanted) if wanted else None


def without_subject(request: SearchRequest) -> Column | None:
    """All but the item, or the file, that the search starts from."""
    wanted = []
    if request.similar_id is not None:
        wanted.append(F.col("id") != request.similar_id)
    if request.reference_path:
        wanted.append(F.col("path") != request.reference_path)
    return reduce(lambda a, b: a & b, wanted) if wanted else None


def overlapping(folders: DataFrame, path: str = "path") -> DataFrame:
    """Pairs (outer, inner) of folders where one holds the other, in any case.

    Each folder is joined to its own ancestors on equality, so the join is a
    hash join over path prefixes, not a comparison of all pairs.
    """
    rows = folders.select(F.col(path).alias("inner"), F.regexp_replace(F.lower(path), "/+$", "").alias("_low"))
    parts = F.split("_low", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    up = rows.filter(F.size(parts) > 1).select("inner", F.explode(ancestors).alias("_up"))
    outer = rows.select(F.col("inner").alias("outer"), "_low")
    return up.join(outer, F.col("_up") == F.col("_low")).select("outer", "inner")
