"""What the findings of round 4 named: state of a key with any number of rows, names whose parts are common."""

import random

import numpy as np
import pandas as pd
import pytest
from gleaner.operators import gazetteer
from gleaner.streaming import state
from pyspark.sql import functions as F
from test_gazetteer import distance

HOUR = 3_600_000_000


class Handle:
    """A key's state and its timers."""

    def __init__(self):
        self.value, self.timers = None, set()

    def getValueState(self, *_):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def expected(rows, forget):
    out, last, banned = [], None, False
    for at, not_ban, tie in sorted((at, not ban, tie) for at, tie, ban in rows):
        if not not_ban:
            banned = True
            continue
        if not banned and (last is None or at - last > forget):
            out.append((at, tie))
        last = at
    return out, last, banned


@pytest.mark.parametrize("seed", range(6))
def test_a_key_holds_runs_not_rows(seed):
    rng = np.random.default_rng(seed)
    rows = [(int(t) * HOUR, i, bool(rng.random() < (0, 0.003)[seed % 2])) for i, t in enumerate(rng.integers(0, (400, 20_000)[seed % 3 > 0], 900))]
    rows.sort(key=lambda r: r[0] // (300 * HOUR))  # batches by time, rows of a batch in any order
    cuts = sorted({next((i for i, r in enumerate(rows) if r[0] >= at), len(rows)) for at in (0, 300 * HOUR, 6000 * HOUR, 10**18)})
    seen, handle, got = state.Seen(12 * HOUR), Handle(), []
    seen.init(handle)
    for a, b in zip(cuts, cuts[1:], strict=False):
        chunks = (pd.DataFrame(rows[i : min(i + 70, b)], columns=["at_", "tie_", "ban_"]) for i in range(a, b, 70))
        for out in seen.handleInputRows(("k",), chunks, None):
            got += zip(out["at_"], out["tie_"], strict=True)
    want, last, banned = expected(rows, 12 * HOUR)
    assert got == want and handle.value == (last, banned) and handle.timers <= {last // 1000 + 12 * 3_600_000 + 1}


def test_runs_don_t_grow_with_rows():
    runs, rng = tuple(np.empty(0, np.int64) for _ in range(3)), np.random.default_rng(1)
    for _ in range(50):
        runs = state.merge_runs(runs, rng.integers(0, 1000 * HOUR, 2000), np.arange(2000), 12 * HOUR)
    assert len(runs[0]) == 1 and runs[2][0] <= 1000 * HOUR


def test_state_stream_reads_no_column_into_one_row(spark, sf_dir, monkeypatch):
    """Its cuts came from an exact percentile, which holds every time in one task."""
    from gleaner.plans import file_queries

    monkeypatch.setattr(F, "percentile", lambda *_: pytest.fail("an exact percentile"))
    assert file_queries.state_stream(spark, sf_dir).count() > 0


def test_state_stream_of_few_and_odd_rows(spark, tmp_path):
    from gleaner.plans.file_queries import state_stream

    frame = spark.createDataFrame([(None, "2024-01-01", 1, "x"), (1, "2024-01-02", 1, "x"), (2, None, 1, "x"), (3, "2024-01-02", None, "x")], "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    for name, rows in (("odd", frame), ("none", frame.limit(0))):
        rows.write.parquet(str(tmp_path / name / "events.parquet"))
    assert [tuple(r) for r in state_stream(spark, str(tmp_path / "odd")).collect()] == [("x-1", 1)]
    assert state_stream(spark, str(tmp_path / "none")).count() == 0


def test_a_null_tie_comes_last_and_comes_back(spark, tmp_path):
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    spark.sql("select * from values ('a', timestamp'2024-01-01 00:00:00', cast(null as bigint)), ('a', timestamp'2024-01-01 00:00:00', 5), ('b', timestamp'2024-01-01 00:00:00', null) as t(key, ts, id)").write.parquet(path)
    got = state.unseen_stream(spark.readStream.schema("key string, ts timestamp, id long").parquet(path), "key", "ts", "id")
    state.run_once(got, out, f"{out}-state")
    assert {(r["key"], r["id"]) for r in spark.read.parquet(out).collect()} == {("a", 5), ("b", None)}


def test_few_names_are_compared(spark, monkeypatch):
    """Names of common syllables met by their rarest pairs of letters, so most were compared with most."""
    rng = random.Random(4)
    parts = ["ana", "bel", "cor", "dun", "els", "far", "gor", "hav", "ilo", "jor"]
    name = lambda: f"{rng.choice(parts)}{rng.choice(parts)} {''.join(rng.choice(parts) for _ in range(3))}".title()
    known = sorted({name() for _ in range(2000)})
    asked = [n[:i] + "x" + n[i + 1 :] for n in known[::5] for i in [rng.randrange(len(n))]]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    monkeypatch.setattr(F, "levenshtein", lambda *_: F.lit(0))  # so that all pairs compared come back
    got = gazetteer.close_names(frame(asked), frame(known))
    assert len(asked) <= got.count() < 20 * len(asked)


def test_names_with_common_parts_meet_by_their_rests(spark, monkeypatch):
    rng, tail = random.Random(6), " Street, Central, Town 6011, Land"
    known = sorted({f"{rng.randrange(1000, 1100)} {rng.choice('abcd')}{rng.choice('efgh')}ton{tail}" for _ in range(500)} | {f"{i} Lane" for i in range(20)})
    asked = [n[:i] + "x" * (i % 2) + n[i + 1 :] for n in known[::4] for i in [rng.randrange(len(n))]]
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = lambda: {tuple(r) for r in gazetteer.close_names(frame(asked), frame(known)).collect()}
    want = got()
    monkeypatch.setattr(gazetteer, "OFTEN", 20)
    assert got() == want and {(a, b) for a, b, _ in want} >= {(a, b) for a, b in zip(asked, known[::4], strict=True)}
    monkeypatch.setattr(F, "levenshtein", lambda *_: F.lit(0))
    few = len(got())
    monkeypatch.setattr(gazetteer, "OFTEN", 10_000)
    assert len(want) <= few < len(got()) / 2


@pytest.mark.parametrize("often", [1024, 3])
def test_no_pair_of_longer_names_is_lost(spark, monkeypatch, often):
    monkeypatch.setattr(gazetteer, "OFTEN", often)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab\U0001f600") for _ in range(n))
    known = {word(rng.randrange(6, 17)) for _ in range(120)} | {"", "aaaaaaaa", "aaaaaaaaaa", "Hall, 5 Main Street"}
    asked = set(known)
    for name in known:
        text = list(name)
        for _ in range(rng.randrange(1, 3)):
            at = rng.choice([0, len(text), rng.randrange(len(text) + 1)])
            text[at : at + rng.randrange(2)] = rng.choice(["", "a", "z"])
        asked.add("".join(text))
    frame = lambda names: spark.createDataFrame([(n,) for n in [*names, None]], "name string")
    got = {(r["name"], r["match"], r["distance"]) for r in gazetteer.close_names(frame(asked), frame(known)).collect()}
    assert got == {(a, b, d) for a in asked for b in known if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2}


def test_a_run_closes_its_state_when_it_is_committed(spark, tmp_path, monkeypatch):
    name, during = "spark.sql.streaming.stateStore.unloadOnCommit", []
    before, inner = spark.conf.get(name), state._run_once
    monkeypatch.setattr(state, "_run_once", lambda *a: during.append(spark.conf.get(name)) or inner(*a))
    path, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    for day, keys in ((1, "ab"), (2, "bc")):
        spark.createDataFrame([(k, f"2024-01-0{day}", day) for k in keys], "key string, ts string, id long").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)
        state.run_once(state.unseen_stream(spark.readStream.schema("key string, ts timestamp, id long").parquet(path), "key", "ts", "id"), out, f"{out}-state")
    assert during == ["true", "true"] and spark.conf.get(name) == before
    assert sorted((r["key"], r["id"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("c", 2)]
