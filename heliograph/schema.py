"""Tables, enumerations and value types of the catalog."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: vector models: the two current ones, then older ones whose vectors are still comparable
CURRENT_MODELS = ("cpu-v3", "gpu-v3")
OLDER_MODELS = ("legacy-v1", "previous-v2")
APPEARANCE_VERSION = 1
DIMENSIONS = 64
PAGE = 300
NOTES_LIMIT, CATALOG_TEXT_LIMIT = 16_000, 700
LEAST_NORM = 1e-12
#: columns that full-text search reads, with their weights (fixed values)
TEXT_COLUMNS = (("name", 8.0), ("search_name", 8.0), ("tags", 0.25), ("ocr", 2.0), ("notes", 6.0))
TRUSTED_COLUMNS = ("name", "search_name", "notes")

ITEMS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("path", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("search_name", T.StringType()),
        T.StructField("thumb", T.StringType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("favorite", T.BooleanType()),
        T.StructField("tags", T.StringType()),
        T.StructField("ocr", T.StringType()),
        T.StructField("notes", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)
APPEARANCES = T.StructType(
    [
        T.StructField("photo_id", T.LongType()),
        T.StructField("modified", T.LongType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("version", T.IntegerType()),
        T.StructField("descriptor", T.ArrayType(T.FloatType())),
    ]
)
THUMBNAILS = T.StructType([T.StructField("key", T.StringType()), T.StructField("data", T.BinaryType())])
FOLDERS = T.StructType([T.StructField("path", T.StringType())])


class Mode(Enum):
    HYBRID = "hybrid"
    VISUAL = "visual"
    TEXT = "text"


class Sort(Enum):
    RELEVANCE = "relevance"
    NEWEST = "newest"
    OLDEST = "oldest"
    NAME = "name"
    LARGEST = "largest"


class Similarity(Enum):
    SUBJECT = "subject"
    APPEARANCE = "appearance"
    SHAPE = "shape"
    COLOR = "color"


class Orientation(Enum):
    ALL = 0
    LANDSCAPE = 1
    PORTRAIT = 2
    SQUARE = 3


@dataclass(frozen=True)
class SearchRequest:
    """What is asked; the first ten fields decide whether a cursor can go on."""

    query: str = ""
    folder: str = ""
    reference_path: str = ""
    similar_id: int | None = None
    favorites: bool = False
    orientation: Orientation = Orientation.ALL
    mode: Mode = Mode.HYBRID
    similarity: Similarity = Similarity.SUBJECT
    sort: Sort = Sort.RELEVANCE
    extension: str = ""
    limit: int = PAGE
    offset: int = 0
    cursor: int = 0
    generation: int = 0

    def identity(self) -> tuple:
        return (self.query, self.folder, self.reference_path, self.similar_id, self.favorites, self.orientation, self.mode, self.similarity, self.sort, self.extension)

    @property
    def text(self) -> str:
        return self.query.strip()

    @property
    def has_reference(self) -> bool:
        return self.similar_id is not None or bool(self.reference_path)


@dataclass
class SearchResult:
    generation: int
    cursor: int
    offset: int
    total: int
    ranked: bool
    status: str
    page: DataFrame | None = None
    error: bool = False
    elapsed_ms: float = 0.0
    details: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Catalog:
    """The tables of a library; appearances, thumbnails and folders may be missing, and so may the full-text index."""

    items: DataFrame
    appearances: DataFrame | None = None
    thumbnails: DataFrame | None = None
    folders: DataFrame | None = None
    index: Any = None
