"""Threshold files: ragged rows ``name,speed,max[,speed,max...],last speed``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiltmine.functions.discretize import OPEN_END

# Fast and acceptable bounds in milliseconds of the episodes known by default.
DEFAULT = """\
totaltime,fast,300,acceptable,2000,slow
pageready,fast,300,acceptable,2000,slow
domready,fast,150,acceptable,1000,slow
backend,fast,100,acceptable,500,slow
frontend,fast,100,acceptable,1500,slow
headerjs,fast,100,acceptable,1000,slow
footerjs,fast,100,acceptable,1000,slow
css,fast,100,acceptable,500,slow
DrupalBehaviors,fast,100,acceptable,200,slow
gaTrackerAttach,fast,10,acceptable,20,slow
tabs,fast,10,acceptable,20,slow
filefieldValidateAutoAttach,fast,10,acceptable,20,slow
HierarchicalSelect,fast,10,acceptable,20,slow
tableDrag,fast,10,acceptable,20,slow
collapse,fast,10,acceptable,20,slow
tableHeader,fast,10,acceptable,20,slow
insert,fast,10,acceptable,20,slow
ahah,fast,10,acceptable,20,slow
textarea,fast,10,acceptable,20,slow
ToThePointShowHideChangelog,fast,10,acceptable,20,slow
attachWysiwyg,fast,10,acceptable,20,slow
filefieldPreviewLinks,fast,10,acceptable,20,slow
filefieldAdmin,fast,10,acceptable,20,slow
filefieldButtons,fast,10,acceptable,20,slow
autocomplete,fast,50,acceptable,200,slow
"""


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """(episode, speed, max_ms) of the lines; rows without a speed are skipped."""
    parts = F.transform(F.split(F.trim(F.col(column)), ","), lambda x: F.trim(x))
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 2)
    pairs = F.transform(F.sequence(F.lit(2), F.size("p"), F.lit(2)), lambda i: F.struct(F.element_at("p", i).alias("speed"), F.coalesce(F.try_element_at("p", i + 1).try_cast("int"), F.lit(OPEN_END)).alias("max_ms")))
    return rows.select(F.element_at("p", 1).alias("episode"), F.explode(pairs).alias("b")).select("episode", "b.speed", "b.max_ms")


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(spark.read.text(path))


def default(spark: SparkSession) -> DataFrame:
    return parse(spark.createDataFrame([(line,) for line in DEFAULT.splitlines()], "value string"))
