"""Result tables, filters, options, wildcards."""

import re

import pytest

from tiltmine.functions.patterns import glob_to_regex
from tiltmine.options import Options, epsilon_of, margin_of
from tiltmine.plans import report


@pytest.fixture(scope="module")
def table(spark):
    rules = spark.createDataFrame(
        [(["episode:css", "location:EU:BE"], ["duration:slow"], 30, 0.754321), (["ua:Win", "episode:Tabs"], ["duration:slow"], 7, 0.2)],
        "antecedent array<string>, consequent array<string>, support long, confidence double",
    )
    return report.mined(rules, 400)


def test_projection(table):
    assert {tuple(r) for r in table.collect()} == {("css", "location:EU:BE", 75.43, 30, 7.5), ("Tabs", "ua:Win", 20.0, 7, 1.75)}


@pytest.mark.parametrize(
    ("text", "want"),
    [("", {"css", "Tabs"}), ("episode:CS", {"css"}), ("episode:x, episode:tab", {"Tabs"}), ("eu:?e", {"css"}), ("LOCATION*be, eu", {"css"}), ("location, ua", set()), ("loc.tion", set())],
)
def test_filter(table, text, want):
    assert {r.episode for r in report.Filter.parse(text).apply(table).collect()} == want


def test_sort(table):
    assert [r.episode for r in report.sort(table, "episode", ascending=True).collect()] == ["css", "Tabs"]
    assert [r.n_slow for r in report.sort(table, "n_slow").collect()] == [30, 7]
    with pytest.raises(ValueError):
        report.sort(table, "nothing")


def test_compared(spark):
    rules = spark.createDataFrame(
        [(["episode:a"], ["s"], 30, 0.5, "both", 0.125, -0.05), (["episode:b"], ["s"], 4, 0.5, "newer", 1.0, 1.0), (["episode:c"], ["s"], 4, 0.5, "older", -1.0, -1.0)],
        "antecedent array<string>, consequent array<string>, support long, confidence double, kind string, confidence_change double, support_change double",
    )
    got = {r.episode: (r.pct_slow_change, r.n_slow_change, r.pct_events) for r in report.compared(rules, 100, 200, 300).collect()}
    assert got == {"a": ("+12.50", "-5.00", 10.0), "b": ("+100.00", "+100.00", 2.0), "c": ("-100.00", "-100.00", 4.0)}


def test_options():
    assert Options.from_dict({"sigma": 0.1, "unknown": 1}) == Options(sigma=0.1)
    assert Options.from_dict(Options().changed(confidence=0.5).to_dict()).confidence == 0.5
    assert epsilon_of(0.05, 0.2) == pytest.approx(0.04) and margin_of(0.05, 0.04) == pytest.approx(0.2)
    with pytest.raises(ValueError):
        Options(sigma=0.01, epsilon=0.02)


@pytest.mark.parametrize(
    ("glob", "text", "want"),
    [("a*c", "abbc", True), ("a?c", "ac", False), ("a.c", "abc", False), ("[ab]x*", "bxy", True), ("[!a]*", "ab", False), ("a[", "a[", True), ("*", "", True), ("x(1)", "x(1)", True)],
)
def test_globs(glob, text, want):
    assert bool(re.match(glob_to_regex(glob), text)) == want
