"""Result tables: projections, the filter language, sorting."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiltmine.functions.items import circumstances_of, episode_of
from tiltmine.functions.patterns import glob_to_regex

SORT_KEYS = ("episode", "circumstances", "pct_slow", "n_slow")


def _episode(antecedent: Column) -> Column:
    found = episode_of(antecedent)
    return F.substring(found, F.instr(found, ":") + 1, F.length(found))


def _columns(rules: DataFrame, events: Column) -> DataFrame:
    return rules.withColumns({
        "episode": _episode(F.col("antecedent")), "circumstances": F.array_join(circumstances_of(F.col("antecedent")), ", "),
        "pct_slow": F.round(F.col("confidence") * 100, 2), "n_slow": F.col("support"), "pct_events": F.round(F.col("support") * 100 / events, 2),
    })


def mined(rules: DataFrame, events: int) -> DataFrame:
    """(episode, circumstances, pct_slow, n_slow, pct_events) of rules over a range with so many events."""
    return _columns(rules, F.lit(float(max(events, 1)))).select("episode", "circumstances", "pct_slow", "n_slow", "pct_events")


def _signed(x: Column) -> Column:
    return F.concat(F.when(x > 0, "+").otherwise(""), F.format_string("%.2f", F.round(x, 2)))


def compared(rules: DataFrame, older_events: int, newer_events: int, all_events: int) -> DataFrame:
    """The same of compared rules, with the changes signed; shares are of the events of the range a rule is from."""
    events = F.when(F.col("kind") == "newer", float(max(newer_events, 1))).when(F.col("kind") == "older", float(max(older_events, 1))).otherwise(float(max(all_events, 1)))
    out = _columns(rules, events)
    return out.withColumn("pct_slow_change", _signed(F.col("confidence_change") * 100)).withColumn("n_slow_change", _signed(F.col("support_change") * 100)).select(
        "episode", "circumstances", "pct_slow", "pct_slow_change", "n_slow", "pct_events", "n_slow_change", "kind"
    )


@dataclass(frozen=True)
class Filter:
    """``episode``: part of its name, in any case; ``circumstances``: wildcards that must all occur."""

    episode: str = ""
    circumstances: tuple[str, ...] = ()

    @classmethod
    def parse(cls, text: str) -> Filter:
        """Comma-separated terms; ``episode:x`` asks for an episode (the last one counts), others for circumstances."""
        episode, others = "", []
        for term in (t.strip() for t in text.split(",")):
            if term.lower().startswith("episode:"):
                episode = term.split(":", 1)[1]
            elif term:
                others.append(term)
        return cls(episode, tuple(others))

    def predicate(self) -> Column:
        test = F.contains(F.lower("episode"), F.lit(self.episode.lower())) if self.episode else F.lit(True)
        for glob in self.circumstances:
            test = test & F.col("circumstances").rlike("(?iu)" + glob_to_regex(glob, anchored=False))
        return test

    def apply(self, table: DataFrame) -> DataFrame:
        return table.where(self.predicate())


def sort(table: DataFrame, by: str = "pct_slow", ascending: bool = False) -> DataFrame:
    """Sorted by a column: episodes in any case, numbers as numbers."""
    if by not in table.columns:
        raise ValueError(f"no column {by}")
    key = F.upper(by) if by == "episode" else F.col(by)
    return table.orderBy(key.asc() if ascending else key.desc(), "episode", "circumstances")
