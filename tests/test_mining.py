"""Itemsets, rules and constraints on the ten-transaction fixture, and against brute force."""

from itertools import combinations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiltmine.operators import mining, rules
from tiltmine.operators.constraints import Constraints, Kind, defaults, with_consequent

TEN = ["ABCD", "AB", "AC", "ABC", "AD", "ACD", "CB", "BC", "CD", "CE"]


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame([(i, list(t)) for i, t in enumerate(TEN)], "tx_id int, items array<string>").cache()


def as_dict(sets):
    return {"".join(r["items"]): r["support"] for r in sets.collect()}


def test_frequent_itemsets(ten):
    assert as_dict(mining.frequent_itemsets(ten, 4)) == {"C": 8, "A": 6, "B": 5, "D": 4, "AC": 4, "BC": 4}


def test_first_batch_has_seventeen_sets(ten):
    assert mining.frequent_itemsets(ten, 0).count() == 17


@pytest.mark.parametrize(
    ("kind", "names", "want"),
    [
        (Kind.ANY, ["A"], {"A": 6, "AC": 4}),
        (Kind.ALL, ["A", "C"], {"AC": 4}),
        (Kind.NONE, ["A"], {"C": 8, "B": 5, "D": 4, "BC": 4}),
        (Kind.NOT_ALL, ["A", "C"], {"A": 6, "B": 5, "C": 8, "D": 4, "BC": 4}),
        (Kind.ANY, ["Z"], {}),
        (Kind.NONE, ["Z"], {"C": 8, "A": 6, "B": 5, "D": 4, "AC": 4, "BC": 4}),
        (Kind.ANY, ["[BD]*"], {"B": 5, "D": 4, "BC": 4}),
    ],
)
def test_constraints(ten, kind, names, want):
    assert as_dict(mining.frequent_itemsets(ten, 4, Constraints().add(kind, *names))) == want


def test_compat_passes_over_unknown_names(ten):
    assert len(as_dict(mining.frequent_itemsets(ten, 4, Constraints(compat=True).add(Kind.ANY, "Z")))) == 6


def test_wildcard_all_needs_every_match(ten):
    vocabulary = mining.item_support(ten).select("item")
    c = Constraints().add(Kind.ALL, "[AC]*")
    assert as_dict(c.filter(mining.frequent_itemsets(ten, 4), vocabulary)) == {"AC": 4}
    assert {r.item for r in c.items_of(Kind.ALL, vocabulary).collect()} == {"A", "C"}
    assert {r.name for r in vocabulary.toDF("name").select("name").collect()} > {r.item for r in c.items_of(Kind.ALL, vocabulary.toDF("name"), "name").collect()} == {"A", "C"}
    assert as_dict(Constraints().add(Kind.NOT_ALL, "[AC]*").filter(mining.frequent_itemsets(ten, 4), vocabulary)) == {"A": 6, "B": 5, "C": 8, "D": 4, "BC": 4}
    for kind in (Kind.ALL, Kind.NOT_ALL):
        assert as_dict(Constraints().add(kind, "[XY]*").filter(mining.frequent_itemsets(ten, 4), vocabulary)) == {}


def test_default_constraints():
    itemsets, consequent = defaults()
    both = with_consequent(itemsets, consequent)
    assert both.of[Kind.ANY] == {"episode:*", "duration:slow"} and itemsets.of[Kind.ANY] == {"episode:*"}


def test_rules(ten):
    sets = mining.frequent_itemsets(ten, 4)
    got = [(r.antecedent, r.consequent, r.support, r.confidence) for r in rules.mine(sets, sets, 0.8).collect()]
    assert got == [(["B"], ["C"], 4, 0.8)]


def test_support_of(ten, spark):
    wanted = spark.createDataFrame([(["C", "A"],), (["E", "A"],), (["B"],)], "items array<string>")
    assert as_dict(mining.support_of(ten, wanted)) == {"AC": 4, "AE": 0, "B": 5}


def test_repeated_items_count_once(spark):
    df = spark.createDataFrame([(["a", "a", "b"],), ([],), (None,)], "items array<string>")
    assert as_dict(mining.frequent_itemsets(df, 1)) == {"a": 1, "b": 1, "ab": 1}


def test_empty_table(spark):
    df = spark.createDataFrame([], "items array<string>")
    assert mining.frequent_itemsets(df, 1).count() == 0


def test_thresholds():
    assert mining.minimum_count(0.05, 20) == 1 and mining.minimum_count(0.05, 21) == 2 and mining.minimum_count(0.05, 20, strict=True) == 2


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sets(st.sampled_from("abcdef")), min_size=1, max_size=12), st.integers(1, 4))
def test_expansion_and_fp_growth_agree_with_brute_force(spark, baskets, least):
    from pyspark.ml.fpm import FPGrowth

    df = spark.createDataFrame([(sorted(b),) for b in baskets], "items array<string>")
    want = {}
    for k in range(1, 7):
        for c in combinations("abcdef", k):
            n = sum(set(c) <= b for b in baskets)
            if n >= least:
                want["".join(c)] = n
    assert as_dict(mining.frequent_itemsets(df, least)) == want
    full = df.where(F.size("items") > 0)
    if full.count() >= least:
        fp = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / full.count()).fit(full).freqItemsets
        assert {"".join(sorted(r["items"])): r.freq for r in fp.collect()} == want


@pytest.mark.parametrize(("literal", "expanded", "max_len"), [(256, 14, None), (256, 14, 2), (3, 14, None), (256, 2, None), (256, 2, 3), (3, 14, 3), (3, 2, 2)])
def test_every_way_gives_the_same_sets(spark, ten, monkeypatch, literal, expanded, max_len):
    want = {k: v for k, v in as_dict(mining.counted_subsets(ten)).items() if v >= 2 and len(k) <= (max_len or 9)}
    monkeypatch.setattr(mining, "LITERAL_ITEMS", literal)
    monkeypatch.setattr(mining, "EXPANDED_ITEMS", expanded)
    assert as_dict(mining.frequent_itemsets(ten, 2, max_len=max_len)) == want


def test_subsets_that_no_long_holds(spark):
    rows = spark.createDataFrame([([f"item{i:03d}" for i in range(s, s + 13)],) for s in (0, 50, 50, 90)], "items array<string>")
    got = mining.frequent_itemsets(rows, 2)
    assert got.count() == 2**13 - 1 and got.where("support <> 2").isEmpty()


def test_tree_size(ten):
    sets, ranked = mining.frequent_itemsets(ten, 1), mining.ranked_items(ten, 1)
    want = {"".join(sorted(s, key="CABDE".index)) for s in as_dict(sets)}
    nodes = {p[:i] for p in want for i in range(1, len(p) + 1)}
    leaves = {n for n in nodes if not any(m != n and m.startswith(n) for m in nodes)}
    assert tuple(mining.tree_size(sets, ranked).first()) == (len(want), len(nodes), len(leaves))
    few = sets.where("size(items) = 2 and array_contains(items, 'E')")
    assert tuple(mining.tree_size(few, ranked).first()) == (1, 2, 1)


def test_consequents_of_many_items(spark):
    sets = spark.createDataFrame([([f"i{i}", "z"], 5) for i in range(12_000)] + [(["z"], 50)], "items array<string>, support long")
    supports = sets.unionByName(spark.createDataFrame([([f"i{i}"], 5) for i in range(12_000)], "items array<string>, support long"))
    assert rules.mine(sets, supports, 0.1, Constraints().add(Kind.ANY, "i*")).count() == 12_000


def test_compare(spark):
    make = lambda rows: spark.createDataFrame([([a], ["s"], s, c) for a, s, c in rows], "antecedent array<string>, consequent array<string>, support long, confidence double")
    older, newer = make([("x", 10, 0.5), ("y", 5, 0.4)]), make([("x", 30, 0.8), ("z", 7, 0.3)])
    got = {r.antecedent[0]: (r.kind, r.support, round(r.confidence_change, 6), round(r.support_change, 6)) for r in rules.compare(older, newer, 100, 200).collect()}
    assert got == {"x": ("both", 30, 0.3, 0.05), "y": ("older", 5, -1.0, -1.0), "z": ("newer", 7, 1.0, 1.0)}
    assert [r.antecedent for r in rules.intersected(older, newer).collect()] == [["x"]]
    assert [r.antecedent for r in rules.only_in(newer, older).collect()] == [["z"]]


def test_multi_item_consequents(ten):
    sets = mining.frequent_itemsets(ten, 1)
    got = {("".join(r.antecedent), "".join(r.consequent)): (r.support, round(r.confidence, 6)) for r in rules.mine(sets, sets, 0.0).collect()}
    assert got["A", "CD"] == (2, round(2 / 6, 6)) and got["AD", "C"] == (2, round(2 / 3, 6))
    assert ("", "A") not in got
