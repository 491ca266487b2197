"""Ordered scans must give the same with hot keys cut into segments as without."""

import random

import pytest
from pyspark.sql import functions as F

from checks import load
from parley.operators import scan
from parley.operators.scan import Run, neighbours, positions, running
from tests import model as P

CUTS = [dict(), dict(hot_rows=3, seg_rows=2), dict(hot_rows=5, seg_rows=7)]


@pytest.fixture(scope="module")
def numbers(spark):
    rnd = random.Random(3)
    rows = []
    for key in range(6):
        for i in range([1, 2, 5, 30, 60, 200][key]):
            value = rnd.choice([None, rnd.randint(-9, 9)])
            rows.append((key, rnd.randint(0, 40) * 10, i, value))
    return rows, spark.createDataFrame(rows, "k long, x long, i long, v long").cache()


@pytest.mark.parametrize("cut", CUTS)
@pytest.mark.parametrize("reverse", [False, True])
def test_running_values(numbers, cut, reverse):
    rows, df = numbers
    v = F.col("v")
    runs = {
        "s": Run("sum", F.coalesce(v, F.lit(0))),
        "s0": Run("sum", F.coalesce(v, F.lit(0)), inclusive=False),
        "m": Run("max", v),
        "m0": Run("max", v, inclusive=False),
        "l": Run("last", v),
        "l0": Run("last", v, inclusive=False),
    }
    out = running(df, ["k"], ["x", "i"], runs, reverse=reverse, **cut)
    got = {(r.k, r.i): (r.s, r.s0, r.m, r.m0, r.l, r.l0) for r in out.collect()}
    assert len(got) == len(rows)
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]), reverse=reverse)
        for n, r in enumerate(group):
            upto = [g[3] for g in group[: n + 1] if g[3] is not None]
            before = [g[3] for g in group[:n] if g[3] is not None]
            want = (
                sum(upto),
                sum(before),
                max(upto, default=None),
                max(before, default=None),
                upto[-1] if upto else None,
                before[-1] if before else None,
            )
            assert got[(key, r[2])] == want


@pytest.mark.parametrize("cut", CUTS)
def test_positions_are_dense(numbers, cut):
    rows, df = numbers
    out = positions(df, ["k"], ["x", "i"], **cut)
    got = {(r.k, r.i): r.pos for r in out.collect()}
    for key in {r[0] for r in rows}:
        group = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        assert [got[(key, r[2])] for r in group] == list(range(len(group)))


@pytest.mark.parametrize("cut", CUTS + [dict(split=False)])
@pytest.mark.parametrize("speakers", [("A", "B"), ("A", "B", "C")])
@pytest.mark.parametrize("index_gaps", [False, True])
def test_neighbours(spark, cut, speakers, index_gaps):
    rows = P.conversations(11, speakers=speakers, max_len=60, index_gaps=index_gaps)
    df = spark.createDataFrame(rows, P.UTT_SCHEMA)
    got = {(r.conv_id, r.utt_idx): r for r in neighbours(df, **cut).collect()}
    assert len(got) == len(rows)
    for (conv,), lines in P.groups(rows, "conv_id").items():
        for i, me in enumerate(lines):
            r = got[(conv, me["utt_idx"])]
            same, other = P.mates(lines, i)
            for have, want in ((r.next_same, same), (r.next_other, other)):
                assert (have and have.utt_idx) == (want and want["utt_idx"])
                assert (have and have.n_tokens) == (want and want["n_tokens"])
            after = lines[i + 1] if i + 1 < len(lines) else None
            before = lines[i - 1] if i else None
            for have, want in ((r.next, after), (r.prev, before)):
                assert (have and (have.speaker, have.start_ms, have.end_ms)) == (
                    want and (want["speaker"], want["start_ms"], want["end_ms"])
                )
            assert r.next_is_last == (None if after is None else i + 2 == len(lines))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_no_carry_work_without_hot_keys(numbers):
    """Below the limit there is one exchange and no join."""
    _, df = numbers
    plan = final_plan(positions(df, ["k"], ["x", "i"]))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["wn_1_hot", "wn_5_hot", "jn_2_hot", "ds_9_hot", "ds_11_hot"])
def test_hot_keys_are_read_once(spark, name):
    """With hot keys the rows are scanned once; what segments inherit are tables of a few rows."""
    plan = final_plan(load()[0][name](spark, "/root/testdata/sf0.001"))
    assert 2 <= plan.count("FileScan") <= 3, plan


def test_rows_of_one_time_and_null_keys(spark):
    """A hot key whose rows all share one time stamp, and a hot null key."""
    rows = [(None if k % 2 else "a", 5, k) for k in range(400)]
    df = spark.createDataFrame(rows, "k string, x long, i long")
    got = {(r.k, r.i): r.pos for r in positions(df, ["k"], ["x", "i"], hot_rows=50, seg_rows=20).collect()}
    assert got == {(k, i): i // 2 for k, _, i in rows}


def _rows_of_tasks(df):
    return [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]


def test_known_rows_are_dealt_over_tasks(spark, monkeypatch):
    """What is written is tiny, so nothing but the number of rows says that one task is not enough."""
    monkeypatch.setattr(scan, "TASK_ROWS", 500)
    df = spark.range(4000).select((F.col("id") % 400).alias("k"), F.col("id").alias("x"))
    once = {"n": scan.Run("sum", F.lit(1).cast("long"))}
    for out in (
        scan.running(df, ["k"], ["x"], once, split=False, rows=4000),
        scan.running(df, ["k"], ["x"], once),
        scan.running(df, ["k"], ["x"], once, hot_rows=9, seg_rows=3),
    ):
        assert max(_rows_of_tasks(out)) < 1500
        assert out.agg(F.sum("n")).first()[0] == 400 * 55
    few = scan.running(df.limit(300), ["k"], ["x"], once, split=False, rows=300)
    assert few.agg(F.max("n")).first()[0] == 1


def test_key_counts(spark):
    rows = [(None,)] * 5 + [("a",)] * 4 + [("b",)] * 4 + [("c",)]
    df = spark.createDataFrame(rows, "k string")
    assert scan.key_counts(df, ["k"], 3) == (14, [(None, 5), ("a", 4), ("b", 4)])
    assert scan.key_counts(df.limit(0), ["k"], 3) == (0, [])
