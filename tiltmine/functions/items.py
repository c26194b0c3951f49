"""Items: ``category:level1:level2...`` strings, and transactions of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPISODE, DURATION = "episode", "duration"


def prefixes(category: str, *levels: Column) -> Column:
    """An item for each prefix of a hierarchy, down to the first level that is missing."""
    found, there, path = [], F.lit(True), F.lit(category)
    for level in levels:
        text = level.cast("string")
        there = there & text.isNotNull() & (text != "")
        path = F.concat(path, F.lit(":"), F.coalesce(text, F.lit("")))
        found.append(F.when(there, path))
    return F.array_compact(F.array(*found))


def location_items(location: Column) -> Column:
    """location(continent, country, region, city, isp): three levels, and the provider by country; the city is no item."""
    isp = F.when(location["isp"].isNotNull() & location["country"].isNotNull(), F.concat_ws(":", F.lit("isp"), location["country"], location["isp"]))
    return F.concat(prefixes("location", location["continent"], location["country"], location["region"]), F.array_compact(F.array(isp)))


def agent_items(agent: Column) -> Column:
    """agent(platform, browser_name, version_major, version_minor, is_mobile): four levels, and whether it is mobile."""
    mobile = F.when(F.coalesce(agent["is_mobile"], F.lit(False)), F.lit("ua:isMobile"))
    return F.concat(prefixes("ua", agent["platform"], agent["browser_name"], agent["version_major"], agent["version_minor"]), F.array_compact(F.array(mobile)))


def status_items(status: Column) -> Column:
    """``status:<code>`` for all but 200."""
    return F.array_compact(F.array(F.when(status != 200, F.concat(F.lit("status:"), status.cast("string")))))


def item(category: str, value: Column) -> Column:
    """An item, or null without a value."""
    return F.concat(F.lit(f"{category}:"), value.cast("string"))


def transaction(*parts: Column) -> Column:
    """Arrays of items together: distinct, sorted, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(*parts))))


def to_transactions(views: DataFrame, speed_of) -> DataFrame:
    """A row per episode of each page view: its items (line columns are kept).

    ``views`` has episodes, url, status, location, agent; ``speed_of(df)`` adds ``speed`` to rows with name and duration_ms.
    """
    shared = F.concat(F.array(item("url", F.col("url"))), status_items(F.col("status")), location_items(F.col("location")), agent_items(F.col("agent")))
    rows = views.withColumn("shared", shared).withColumn("e", F.explode("episodes")).withColumn("name", F.col("e.name")).withColumn("duration_ms", F.col("e.duration_ms")).drop("e")
    own = F.array(item(EPISODE, F.col("name")), item(DURATION, F.col("speed")))
    return speed_of(rows).withColumn("items", transaction(own, F.col("shared"))).drop("shared", "episodes")


def episode_of(items: Column) -> Column:
    """The first item of the episode category; null without one."""
    return F.try_element_at(F.filter(items, lambda x: x.startswith(EPISODE)), F.lit(1))


def circumstances_of(items: Column) -> Column:
    """The items beside the episode."""
    return F.array_remove(items, episode_of(items))


def hierarchy(items: DataFrame, column: str = "item", without: tuple[str, ...] = (DURATION, "url")) -> DataFrame:
    """(path, parent, label, depth): every prefix of every item once, in the order of upper-cased paths."""
    parts = F.filter(F.split(F.col(column), ":"), lambda x: x != "")
    rows = items.select(parts.alias("parts")).where(F.size("parts") > 0).where(~F.element_at("parts", 1).isin(*without))
    paths = rows.select(F.explode(F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.slice(F.col("parts"), F.lit(1), i))).alias("p")).distinct()
    return paths.select(
        F.array_join("p", ":").alias("path"), F.when(F.size("p") > 1, F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), ":")).alias("parent"), F.element_at("p", -1).alias("label"), F.size("p").alias("depth")
    ).orderBy(F.upper("path"), "path")


def complete(tree: DataFrame, typed: str) -> DataFrame:
    """Paths of a hierarchy that continue what was typed after the last comma, in any case."""
    last = typed.rsplit(",", 1)[-1].strip()
    return tree.where(F.upper("path").startswith(last.upper())).select("path").orderBy(F.upper("path"), "path")
