"""Zero-shot labels: the nearest of a bank of label vectors, if near enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V

MOST, LEAST, BEHIND = 3, 0.23, 0.045
#: what images are labelled with, in the order of the bank, and the text that is embedded for each (fixed values)
PROMPT = "a photo of "
NAMES = (
    "a person", "a group of people", "a portrait", "a child", "a family", "a wedding", "a concert", "a sports event", "an astronaut", "a rocket",
    "outer space", "a dog", "a cat", "a bird", "a horse", "wildlife", "an insect", "flowers", "a tree", "a forest",
    "a mountain", "a beach", "the ocean", "a lake", "a river", "a waterfall", "snow", "a desert", "a sunset", "the night sky",
    "a city", "a street", "a building", "a house", "an interior room", "a kitchen", "a bedroom", "an office", "a car", "a motorcycle",
    "a bicycle", "an airplane", "a train", "a boat", "food", "a cup of coffee", "a drink", "a dessert", "fruit", "vegetables",
    "a computer", "a phone", "a camera", "electronics", "a book", "a document", "a receipt", "a screenshot", "a website", "a chart",
    "a map", "a handwritten note", "a drawing", "a painting", "a cartoon", "anime", "a logo", "a product", "clothing", "shoes",
    "jewelry", "furniture", "a garden", "a bridge", "a road", "a farm", "a swimming pool", "a reflection", "a texture", "a pattern",
    "a toy", "a game", "a colorful abstract design", "a black and white photo", "an aerial view", "a close-up photo", "an underwater scene", "a rainy scene", "a dark scene", "a bright sunny scene",
)


def embedded_bank(embed_text: Callable[[str], list[float] | None], names: tuple[str, ...] = NAMES) -> list[tuple[str, list[float]]]:
    """The bank that a text model makes of the names; names it can't embed are left out."""
    pairs = [(name, embed_text(PROMPT + name)) for name in names]
    return [(name, v) for name, v in pairs if v is not None]


def mean_bank(vectors: DataFrame, label: str, vector: str, dimensions: int) -> DataFrame:
    """label and the mean vector of its rows, at length 1: one aggregation, no exploded places."""
    places = ", ".join(f"avg(CAST(`{vector}`[{k}] AS DOUBLE))" for k in range(dimensions))
    means = vectors.groupBy(label).agg(F.expr(f"array({places})").alias("_mean"))
    return means.select(F.col(label).cast("string").alias("name"), V.normalized("_mean").alias("bank"))


def zero_shot(items: DataFrame, bank: list[tuple[str, list[float]]], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and labels: up to MOST names, best first, of scores of at least LEAST and within BEHIND of the best.

    The bank is a fixed list of labels, so it is a constant of the plan: a batch of items is multiplied with all of it
    at once, without a join.  Ties go to the earlier label.
    """
    names = F.array(*[F.lit(name) for name, _ in bank]).cast("array<string>")
    scores = F.transform(V.products(vector, [v for _, v in bank]), lambda s, i: F.struct((-s).alias("s"), i.alias("i"), F.get(names, i).alias("name")))
    best = F.slice(F.array_sort(F.filter(scores, lambda x: ~F.isnan(x["s"]))), 1, MOST)
    rows = items.select(key, F.coalesce(best, F.array().cast("array<struct<s:double,i:int,name:string>>")).alias("best"))
    good = F.filter("best", lambda x: -x["s"] >= F.greatest(F.lit(LEAST), -F.col("best")[0]["s"] - F.lit(BEHIND)))
    return rows.select(key, F.array_join(F.transform(good, lambda x: x["name"]), ", ").alias("labels"))
