"""Menu listings of a burger festival: derivation, filters, feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text
from gleaner.operators.publish import multi_facet, price_range

#: Dietary labels and the flags that grant them; the second flag of a pair means "on request".
DIETARY = (("Dairy Free", "dairyFree"), ("Vegan", "vegan"), ("Vegetarian", "vegetarian"), ("Nut Free", "nutFree"), ("Gluten Free", "glutenFree"))


def to_burgers(raw: DataFrame) -> DataFrame:
    """Feed rows from raw menu rows; flags that a row lacks count as false."""
    flag = lambda name: F.col(name) if name in raw.columns else F.lit(False)
    pairs = [(label, flag(name), flag(f"{name}Possible")) for label, name in DIETARY]
    return raw.select(
        "id", "name", "image", "description", text.meal_available(F.col("availableForLunch"), F.col("availableForDinner")).alias("mealAvailable"), "price", "beerMatchPrice", "beerMatch",
        F.col("venue").alias("venue"), text.protein_text(F.col("mainProtein")).alias("mainProtein"), F.coalesce("sidesIncluded", F.lit(False)).alias("sidesIncluded"), text.dietary(*pairs).alias("dietaryRequirements"),
    )


def sessions(starts: Column, asof: Column) -> Column:
    """Session starts to the minute, those to come; rows without a time are left out."""
    times = F.transform(starts, lambda s: F.date_trunc("MINUTE", s))
    return F.sort_array(F.filter(times, lambda t: t.isNotNull() & (t >= asof)))


def burger_filters(burgers: DataFrame) -> dict[str, DataFrame]:
    """Facets: dietary labels, beer matches and proteins in order, and the price range."""
    return {
        "dietaryRequirements": multi_facet(burgers, F.col("dietaryRequirements")),
        "beerMatch": multi_facet(burgers, F.array("beerMatch")),
        "proteins": multi_facet(burgers, F.split("mainProtein", ",")),
        "priceRange": price_range(burgers),
    }


def publish_burgers(burgers: DataFrame, path: str) -> None:
    burgers.orderBy("name").write.mode("overwrite").json(f"{path}/burgers")
    for name, rows in burger_filters(burgers).items():
        rows.coalesce(1).write.mode("overwrite").json(f"{path}/filters/{name}")
