"""State over batches: the seven-batch example, exact replay, idempotence."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tiltmine.functions import tilted
from tiltmine.operators import mining, windows
from tiltmine.operators.constraints import Constraints, Kind
from tiltmine.plans.analyst import Analyst
from tiltmine.options import Options
from tiltmine.plans.catalogue import FIXTURE, PRUNED, QUERIES
from tiltmine.plans.events import ingested
from tiltmine.streaming import state as streaming


HOURS = {"A": 68, "AB": 23, "AD": 43, "B": 25, "C": 29, "AC": 24, "ACD": 22, "BC": 4, "CD": 23, "D": 44}
AFTER_SEVEN = {k: {0: 0, 1: 0, 2: 0, 4: v} for k, v in HOURS.items()} | {"E": {0: 0, 1: 1, 2: 1}, "F": {0: 1, 1: 0, 2: 0}}


def batch(spark, b):
    return spark.createDataFrame([(i, sorted(set(t))) for i, t in enumerate(FIXTURE[b])], "line_id long, items array<string>")


def named(rows):
    out = {}
    for r in rows.collect():
        out.setdefault("".join(sorted(r.pattern)), {})[r.bucket] = r.support
    return out


@pytest.fixture(scope="module")
def pruned(spark, tmp_path_factory):
    state = streaming.PrunedState(spark, str(tmp_path_factory.mktemp("state")), 0.4, 0.05)
    counts = []
    for b in range(len(FIXTURE)):
        counts.append(state.process(batch(spark, b), b).select("pattern").distinct().count())
    return state, counts


def test_numbers_of_patterns(pruned):
    assert pruned[1] == [17, 17, 17, 17, 11, 11, 12]


def test_windows_after_seven_batches(pruned):
    assert named(pruned[0].windows(6)) == AFTER_SEVEN


def test_a_batch_run_again_changes_nothing(spark, pruned):
    before = named(pruned[0].windows(6))
    pruned[0].process(batch(spark, 6), 6)
    assert named(pruned[0].windows(6)) == before


def test_first_batch_with_constraints(spark, tmp_path):
    state = streaming.PrunedState(spark, str(tmp_path), 0.4, 0.05, Constraints().add(Kind.ANY, "A"))
    got = state.process(batch(spark, 0), 0)
    assert all("A" in r.pattern for r in got.collect()) and got.count() == 8


def test_exact_state_replays_to_the_batch_result(spark, tmp_path):
    rows = [(b, i, sorted(set(t))) for b, txs in enumerate(FIXTURE) for i, t in enumerate(txs)]
    tx = spark.createDataFrame(rows, "batch_id int, line_id long, items array<string>")
    exact = streaming.ExactState(spark, str(tmp_path), max_len=None)
    n = streaming.replay(tx, exact)
    exact.process(tx.where("batch_id = 2"), 2)
    assert n == 7
    key = lambda df: sorted((r.batch_id, "".join(sorted(r["items"])), r.support) for r in df.collect())
    assert key(exact.patterns()) == key(mining.by_batch(tx))
    a = Analyst(Options(sigma=0.4, epsilon=0.05)).load(exact.patterns(), exact.sizes())
    assert a.n == 7 and a.events("all") == 10 + 23 + 20 + 20 + 3


def test_pruned_is_within_exact(spark, pruned):
    state, _ = pruned
    exact = {}
    for b in range(7):
        for r in mining.counted_subsets(batch(spark, b)).collect():
            exact["".join(r["items"]), tilted.bucket_of(7, b)] = exact.get(("".join(r["items"]), tilted.bucket_of(7, b)), 0) + r.support
    for pattern, window in named(state.windows(6)).items():
        assert all(v <= exact.get((pattern, b), 0) for b, v in window.items())


def plain_pruned(batches, sigma, epsilon):
    """Pruned state in plain Python: {pattern, in the order of the item list: {bucket: support}} after all batches."""
    least = lambda share, x: math.ceil(round(share * x, 9))
    place, state, sizes = {}, {}, []

    def by_bucket(rows, n):
        out = Counter()
        for b, x in rows:
            if (k := tilted.bucket_of(n, b)) is not None:
                out[k] += x
        return out

    def shortened(rows, n):
        window, whole, cut, s, z = by_bucket(rows.items(), n), by_bucket(enumerate(sizes), n), None, 0, 0
        for k in sorted(window, reverse=True):
            s, z = s + window[k], z + whole[k]
            if window[k] >= least(sigma, whole[k]) or s >= least(epsilon, z):
                break
            cut = min((o for o in tilted.OFFSETS if o >= k), default=None)
        at = {b: tilted.bucket_of(n, b) for b in rows}
        return {b: x for b, x in rows.items() if at[b] is not None and (cut is None or at[b] < cut)}

    for b, txs in enumerate(batches):
        txs = [set(t) for t in txs]
        sizes.append(len(txs))
        minimum = max(1, int(round(epsilon * len(txs), 9)))
        support = Counter(i for t in txs for i in t)
        frequent = {i for i in support if support[i] >= minimum}
        for i in sorted(frequent - place.keys(), key=lambda i: (-support[i], i)):
            place[i] = len(place)
        known, updated, level = set(state), {}, {(i,) for i in frequent}
        while level:
            counts = {p: sum(set(p) <= t for t in txs) for p in level}
            counts = {p: c for p, c in counts.items() if c >= minimum}
            updated |= counts
            opened = [p for p in counts if b == 0 or (p in known and shortened(state[p] | {b: counts[p]}, b + 1))]
            level = {(i, *p) for p in opened for i in frequent if place[i] < place[p[0]]}
        for p in known | updated.keys():
            rows = state[p] if p in known else {x: 0 for x in range(4 * (b // 4), b)}
            state[p] = rows | {b: updated.get(p, 0)}
            if b and p in known:
                state[p] = shortened(state[p], b + 1)
        state = {p: rows for p, rows in state.items() if rows}
    return {p: dict(by_bucket(rows.items(), len(batches))) for p, rows in state.items()}


def test_the_plain_algorithm_has_the_windows_of_the_seven_batches():
    assert {"".join(sorted(p)): w for p, w in plain_pruned(FIXTURE, 0.4, 0.05).items()} == AFTER_SEVEN


def test_pruned_replay_of_all_events(spark):
    """The registered query against the plain algorithm, over the whole table."""
    sf = "/root/testdata/sf0.001"
    tx = windows.with_batches(ingested(spark, sf).select("event_id", windows.quarter(F.col("time_s"), PRUNED.batch_seconds).alias("quarter"), "items"))
    rows = tx.select("batch_id", "items").collect()
    batches = [[r["items"] for r in rows if r.batch_id == b] for b in range(max(r.batch_id for r in rows) + 1)]
    want = {"|".join(sorted(p)): w for p, w in plain_pruned(batches, PRUNED.sigma, PRUNED.epsilon).items()}
    got = {}
    for r in QUERIES["stream_pruned_replay"](spark, sf).collect():
        got.setdefault(r.pattern, {})[r.bucket] = r.support
    assert len(want) > 100 and got == want


def test_least_support_to_keep_a_window(spark):
    """Just at it a window stays, just below it droppable_tails drops it whole."""
    old = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", 1, 9), ("b", 4, 0), ("c", 4, 3)], "pattern string, bucket int, support long")
    sizes = spark.createDataFrame([(1, 10), (2, 10), (4, 40)], "bucket int, size long")
    least = {r.pattern: r.least for r in windows.least_to_keep(old, sizes, 20, 0.4, 0.1).collect()}
    assert least == {"a": 3, "b": 0, "c": 3}
    whole = sizes.union(spark.createDataFrame([(0, 20)], "bucket int, size long"))
    for less in (0, 1):
        now = spark.createDataFrame([(p, 0, max(0, n - less)) for p, n in least.items()], "pattern string, bucket int, support long")
        gone = {r.pattern for r in windows.droppable_tails(old.union(now), whole, 0.4, 0.1).collect() if r.drop_from == 0}
        assert gone == ({"a", "c"} if less else set())


def test_throughput():
    assert streaming.throughput({"processedRowsPerSecond": 10.0}, 8)["episodes_per_s"] == 80.0


def test_events_follow_batches(spark):
    tx = spark.createDataFrame([(0, 1, ["a"]), (0, 1, ["b"]), (1, 2, ["a"])], "batch_id int, event_id long, items array<string>")
    a = Analyst(Options(sigma=0.1, epsilon=0.1)).analyze(tx)
    assert a.events("all") == 2 and a.sizes.where(F.col("batch_id") == 0).first().ratio == 2.0
