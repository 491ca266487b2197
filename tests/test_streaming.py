"""Streaming operators over several triggers with rows out of order equal their batch forms."""

import random

import pandas as pd
import pytest

from parley.operators import dialogue as D
from parley.operators import utterances as U
from parley.operators.scan import neighbours
from parley.streaming import live
from parley.streaming import processors as S
from tests import model as P

FAR = 10_000_000_000


@pytest.fixture(scope="module")
def rows():
    return P.conversations(61, n_conv=6, max_len=50)


def run(spark, tmp, name, schema, batches, make):
    """Feed ``batches`` one file per trigger and return the rows written."""
    src = f"{tmp}/{name}_in"
    for i, batch in enumerate(batches):
        part = spark.createDataFrame(batch, schema).coalesce(1)
        part.write.mode("append").parquet(f"{src}/b{i:03d}")
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", 1)
        .option("latestFirst", "false")
        .parquet(f"{src}/*")
    )
    out = live.run_to_files(make(stream), f"{tmp}/{name}_out", f"{tmp}/{name}_state")
    return spark.read.parquet(out).collect()


def shuffled_batches(items, time, size, reach_ms, seed=1):
    """Rows in time order, each moved by less than ``reach_ms``, cut into batches."""
    rnd = random.Random(seed)
    order = sorted(items, key=lambda r: r[time] + rnd.randint(0, reach_ms))
    return [order[i : i + size] for i in range(0, len(order), size)]


def closing(schema_row, **values):
    row = {k: None for k in schema_row}
    row.update(values)
    return [row]


def test_utterances_equal_batch(spark, tmp_path, rows):
    toks = P.tokens_of(rows)
    end = closing(toks[0], conv_id=-1, utt_idx=0, tok_idx=0, speaker="A", start_ms=FAR, end_ms=FAR, text="")
    batches = shuffled_batches(toks, "start_ms", 150, 3000) + [end]
    got = run(spark, tmp_path, "u", P.TOK_SCHEMA, batches, lambda s: live.utterances(s, delay="5 seconds"))
    have = sorted((r.conv_id, r.start_ms, r.speaker, r.end_ms, r.n_tokens, r.text) for r in got if r.conv_id >= 0)
    batch = U.group_into_utterances(spark.createDataFrame(toks, P.TOK_SCHEMA)).collect()
    want = []
    for key, group in P.groups([r.asDict() for r in batch], "conv_id", "group_idx").items():
        group.sort(key=lambda t: (t["start_ms"], t["utt_idx"], t["tok_idx"]))
        text = "".join(t["text"] for t in group)
        want.append((key[0], group[0]["start_ms"], group[0]["speaker"], group[-1]["end_ms"], len(group), text))
    assert have == sorted(want)


@pytest.mark.parametrize("pause", [0, 70_000])
def test_tagger_equals_batch(spark, tmp_path, rows, pause):
    """Pauses of any length; a row without a speaker ends a conversation."""
    rows = [r | {"conv_id": f"c{r['conv_id']}"} for r in rows]
    rows = [r | {c: r[c] + r["utt_idx"] // 5 * pause for c in ("start_ms", "end_ms")} for r in rows]
    last = {}
    for r in rows:
        last[r["conv_id"]] = max(r["end_ms"], last.get(r["conv_id"], 0))
    blank = dict.fromkeys(rows[0])
    ends = [blank | dict(conv_id=c, start_ms=at + 1) for c, at in last.items()]
    batches = shuffled_batches(rows + ends, "start_ms", 30, 3000) + [[blank | dict(conv_id="end", start_ms=FAR)]]
    schema = P.UTT_SCHEMA.replace("conv_id long", "conv_id string")
    got = run(spark, tmp_path, "t", schema, batches, lambda s: live.tagged_utterances(s, delay="5 seconds"))
    have = {(r.conv_id, r.utt_idx): r.kind for r in got}
    near = neighbours(spark.createDataFrame(rows, schema)).withColumn("kind", D.boundary())
    want = {(r.conv_id, r.utt_idx): r.kind for r in near.collect()}
    assert have == want and len(got) == len(want)


def test_lines_wait_for_what_follows(spark, tmp_path, rows):
    """Without an end row or idle time the last line of a conversation stays open, however long nothing is said."""
    end = closing(rows[0], conv_id=-1, utt_idx=0, speaker="A", start_ms=FAR, end_ms=FAR, n_tokens=0, text="")
    got = run(spark, tmp_path, "w", P.UTT_SCHEMA, [rows, end], lambda s: live.tagged_utterances(s, idle=None))
    last = {}
    for r in rows:
        last[r["conv_id"]] = max(r["utt_idx"], last.get(r["conv_id"], -1))
    assert got and all(r.utt_idx < last[r.conv_id] for r in got)


EVENT = "conv_id string, seq long, start_ms long, end_ms long, kind string, speaker string, token string"


def asr(conv, seq, start, end, speaker, token):
    return dict(conv_id=conv, seq=seq, start_ms=start, end_ms=end, kind="asr", speaker=speaker, token=token)


def test_chunk_text_and_late_rows(spark, tmp_path):
    batches = [
        [asr("a", 1, 900, 2000, "A", "b"), asr("a", 2, 1500, 2001, "B", "c")],
        [asr("a", 0, 0, 1, "A", "a")],
        [asr("b", 0, 499000, 500000, "A", "z")],
        [asr("b", 1, 500050, 500100, "A", "z")],
        [asr("a", 3, 50, 100, "A", "late")],
        [asr("b", 2, 900000, 900001, "A", "y")],
    ]
    got = run(spark, tmp_path, "c", EVENT, batches, lambda s: live.chunk_text(s, delay="4 seconds"))
    texts = {(r.conv_id, r.k): r.text for r in got}
    assert texts[("a", 1)] == "<speaker_A>ab</speaker_A>"
    assert texts[("a", 2)] == "<speaker_B>c</speaker_B>"
    assert texts[("b", 1)] == "<speaker_A>zz</speaker_A>"
    assert not any("late" in t for t in texts.values())


def test_a_late_end_holds_back_what_follows(spark, tmp_path):
    """Chunks are counted from the first event, and an event counts with the largest end so far."""
    one = [asr("a", 0, 700, 5000, "A", "long"), asr("a", 1, 800, 900, "B", "x"), asr("a", 2, 1400, 1500, "B", "y")]
    far = [asr("b", 0, 10**9, 10**9 + 1, "A", "z")]
    got = run(spark, tmp_path, "h", EVENT, [one, far, far], live.chunk_text)
    assert [(r.k, r.text) for r in got if r.conv_id == "a"] == [
        (3, "<speaker_A>long</speaker_A><speaker_B>xy</speaker_B>")
    ]


def test_label_counts_by_window(spark, tmp_path):
    schema = "at long, label string"
    a = [dict(at=10, label="continuer"), dict(at=59_000, label=None), dict(at=61_000, label="continuer")]
    b = [dict(at=900_000, label="continuer")]
    c = [dict(at=901_000, label="continuer")]
    late = [dict(at=20, label="continuer")]
    end = [dict(at=FAR, label="x")]
    got = run(
        spark,
        tmp_path,
        "l",
        schema,
        [a, b, c, late, end],
        lambda s: live.label_counts(live.with_event_time(s, "at"), "60 seconds", "5 seconds"),
    )
    have = sorted((r.window_start.timestamp(), r.label, r.n) for r in got)
    assert have == [(0, "continuer", 1), (0, "non_backchannel", 1), (60, "continuer", 1), (900, "continuer", 2)]


def test_sessions_split_on_gap_only(spark, tmp_path):
    schema = P.TOK_SCHEMA
    mk = lambda i, s, at: dict(conv_id=1, utt_idx=0, tok_idx=i, speaker=s, start_ms=at, end_ms=at + 50, text="x")
    rows = [mk(0, "A", 0), mk(1, "B", 100), mk(2, "A", 900), mk(3, "A", 2500)]
    end = [dict(conv_id=-1, utt_idx=0, tok_idx=0, speaker="A", start_ms=FAR, end_ms=FAR, text="")]
    got = run(spark, tmp_path, "s", schema, [rows, end], live.sessions)
    have = sorted((r.speaker, r.start_ms, r.end_ms, r.n_tokens) for r in got if r.conv_id == 1)
    assert have == [("A", 0, 950, 2), ("A", 2500, 2550, 1), ("B", 100, 150, 1)]


class Store:
    """A state variable in memory that counts the rows read and written."""

    def __init__(self, cost, kind):
        self.cost, self.kind, self.data = cost, kind, {} if kind == "map" else []

    def exists(self):
        return bool(self.data)

    def clear(self):
        self.data = {} if self.kind == "map" else []

    def touched(self, value):
        # The rows of an array count one by one.
        self.cost["rows"] += max(1, sum(len(v) for v in value if isinstance(v, list)))
        return value

    def get(self):
        if self.kind == "value":
            return self.touched(self.data[0]) if self.data else None
        return iter([self.touched(v) for v in self.data])

    def update(self, value):
        self.data = [self.touched(value)]

    def appendList(self, values):
        self.data += [self.touched(v) for v in values]

    def getValue(self, key):
        return self.touched(self.data[key]) if key in self.data else None

    def updateValue(self, key, value):
        self.data[key] = self.touched(value)

    def removeKey(self, key):
        self.data.pop(key, None)

    def keys(self):
        return iter(list(self.data))

    def iterator(self):
        return iter([(k, self.touched(v)) for k, v in self.data.items()])


class Handle:
    def __init__(self):
        self.cost, self.timers, self.stores = {"rows": 0}, set(), []

    def _store(self, kind):
        self.stores.append(Store(self.cost, kind))
        return self.stores[-1]

    def getMapState(self, *_):
        return self._store("map")

    def getListState(self, *_):
        return self._store("list")

    def getValueState(self, *_):
        return self._store("value")

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(sorted(self.timers))

    def kept(self):
        return len(self.timers) + sum(len(s.data) for s in self.stores)


class Clock:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def drive(processor, rows, trigger, delay):
    """Rows of one conversation through a processor, ``trigger`` at a time; (output rows, cost of each trigger)."""
    handle, now, out, costs = Handle(), 0, [], []
    processor.init(handle)
    batches = [rows[i : i + trigger] for i in range(0, len(rows), trigger)]
    for batch in [*batches, [], []]:
        before, clock = handle.cost["rows"], Clock(now)
        if batch:
            assert not list(processor.handleInputRows(("c",), iter([pd.DataFrame(batch)]), clock))
        for at in sorted(t for t in handle.timers if t <= now):
            for frame in processor.handleExpiredTimer(("c",), clock, None):
                out += frame.to_dict("records")
            handle.timers.discard(at)
        costs.append(handle.cost["rows"] - before)
        now = max(now, max((r["start_ms"] for r in batch), default=FAR) + 1 - delay)
    return out, costs, handle


MANY = 100_000


def test_a_long_conversation_costs_the_same_per_row():
    """One speaker for the first half: lines that wait for another speaker are not read again and again."""
    lines = [
        dict(utt_idx=i, speaker="A" if i < MANY // 2 else "AB"[i % 2], start_ms=400 * i, end_ms=400 * i + 300, n_tokens=3, text="うん。", bc_label="continuer" if i % 3 == 0 else None)
        for i in range(MANY)
    ]
    end = dict.fromkeys(lines[0]) | dict(start_ms=400 * MANY)
    names = ["conv_id", *[c.split()[0] for c in S.Neighbours.LINE.split(", ")]]
    out, costs, handle = drive(S.Neighbours(names, 1500, "non_backchannel", None), [*lines, end], 1000, 10_000)
    assert len(out) == MANY and handle.kept() == 0
    assert max(costs[2:45]) < 2 * min(costs[2:45]) and sum(costs) < 12 * MANY
    got = {r["utt_idx"]: r for r in out}
    for i in [0, 1, 2, MANY // 2 - 3, MANY // 2, MANY - 3]:
        r, later = got[i], lines[i + 1 :]
        same = next((x["utt_idx"] for x in later if x["speaker"] == lines[i]["speaker"]), None)
        assert (r["next_speaker"], r["next_start"]) == (later[0]["speaker"], later[0]["start_ms"])
        assert r["same_utt_idx"] == same
        if lines[i]["bc_label"]:
            assert r["other_utt_idx"] == next(x["utt_idx"] for x in later if x["speaker"] != lines[i]["speaker"])


def test_a_long_utterance_costs_the_same_per_token():
    toks = [dict(utt_idx=0, tok_idx=i, speaker="A", start_ms=100 * i, end_ms=100 * i + 90, text=str(i % 10)) for i in range(MANY)]
    out, costs, handle = drive(S.Utterances(["conv_id", "speaker", "start_ms", "end_ms", "n_tokens", "text"], 1000), toks, 1000, 5000)
    assert len(out) == 1 and out[0]["n_tokens"] == MANY and out[0]["text"] == "0123456789" * (MANY // 10)
    assert max(costs[2:95]) < 2 * min(costs[2:95]) and sum(costs) < 8 * MANY and handle.kept() == 0


def test_a_long_chunk_costs_the_same_per_event():
    events = [dict(seq=i, start_ms=50 * i, end_ms=50 * i + 40, kind="asr", speaker="A", token="x") for i in range(MANY)]
    events.append(dict.fromkeys(events[0]) | dict(start_ms=50 * MANY))
    out, costs, handle = drive(S.Chunks(["conv_id", "k", "items"], 10**9, None), events, 1000, 5000)
    assert [(r["k"], len(r["items"])) for r in out] == [(1, MANY)]
    assert max(costs[2:95]) < 2 * min(costs[2:95]) and sum(costs) < 8 * MANY and handle.kept() == 0


@pytest.mark.parametrize("slow", [1, 7, 10**6])
def test_one_long_conversation_equals_batch(spark, tmp_path, slow):
    """100,000 tokens of one conversation over a few triggers; speakers change every ``slow`` tokens."""
    if slow == 7:
        n, size = 5_000, 700
    else:
        n, size = (MANY, 40_000) if slow > 7 else (3_000, 500)
    toks = [dict(conv_id=1, utt_idx=i // slow, tok_idx=i % slow, speaker="AB"[i // slow % 2], start_ms=100 * i, end_ms=100 * i + 90, text="t") for i in range(n)]
    end = closing(toks[0], conv_id=-1, utt_idx=0, tok_idx=0, speaker="A", start_ms=FAR, end_ms=FAR, text="")
    got = run(spark, tmp_path, "m", P.TOK_SCHEMA, shuffled_batches(toks, "start_ms", size, 3000) + [end], lambda s: live.utterances(s, delay="5 seconds"))
    have = sorted((r.start_ms, r.end_ms, r.n_tokens, r.speaker) for r in got if r.conv_id == 1)
    firsts = range(0, n, slow)
    assert have == [(100 * i, 100 * min(i + slow, n) - 10, min(slow, n - i), "AB"[i // slow % 2]) for i in firsts]


def state_rows(spark, tmp, name, schema, batches, make):
    """Rows left in the state store when all input is processed."""
    src = f"{tmp}/{name}_in"
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(f"{src}/b{i:03d}")
    stream = make(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/*"))
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp}/{name}_ck").trigger(availableNow=True).start()
    query.awaitTermination()
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_nothing_is_kept_of_a_conversation_that_has_ended(spark, tmp_path):
    """The row that moves the watermark is a conversation of its own: its one row and timer are all there is."""
    events = [asr("a", i, 700 * i, 700 * i + 500, "AB"[i % 2], "x") for i in range(50)]
    over = [dict(conv_id="a", seq=None, start_ms=40_000, end_ms=None, kind=None, speaker=None, token=None)]
    clock = [over[0] | dict(conv_id="z", start_ms=FAR)]
    alone = state_rows(spark, tmp_path, "none", EVENT, [clock], live.chunk_text)
    kept = state_rows(spark, tmp_path, "open", EVENT, [events, clock], lambda s: live.chunk_text(s, idle=None))
    assert kept > alone
    assert state_rows(spark, tmp_path, "over", EVENT, [events, over, clock], lambda s: live.chunk_text(s, idle=None)) == alone
    assert state_rows(spark, tmp_path, "idle", EVENT, [events, clock], lambda s: live.chunk_text(s, idle="1 hour")) == alone


def test_idle_conversations_are_settled(spark, tmp_path, rows):
    """After ``idle`` the lines that still wait are put out as at an end."""
    end = closing(rows[0], conv_id=-1, utt_idx=0, speaker="A", start_ms=FAR, end_ms=FAR, n_tokens=0, text="")
    got = run(spark, tmp_path, "i", P.UTT_SCHEMA, [rows, end], lambda s: live.tagged_utterances(s, idle="1 hour"))
    near = neighbours(spark.createDataFrame(rows, P.UTT_SCHEMA)).withColumn("kind", D.boundary())
    assert {(r.conv_id, r.utt_idx): r.kind for r in got} == {(r.conv_id, r.utt_idx): r.kind for r in near.collect()}


class Counted(Store):
    """A store that counts calls and keeps bytes as they come back from Spark."""

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "getValue", "updateValue", "removeKey"):
            self.cost["calls"] += 1
        return super().__getattribute__(name)


class CountedHandle(Handle):
    def __init__(self):
        super().__init__()
        self.cost["calls"] = 0

    def _store(self, kind):
        self.stores.append(Counted(self.cost, kind))
        return self.stores[-1]


def drive_together(processor, batches, delay):
    """Batches of rows with a ``conv_id`` through one state key; (output rows, the handle)."""
    handle, now, out = CountedHandle(), 0, []
    together = S.Together(processor, ["conv_id"])
    together.init(handle)
    for batch in [*batches, [], []]:
        clock = Clock(now)
        if batch:
            assert not list(together.handleInputRows((7,), iter([pd.DataFrame(batch)]), clock))
        for at in sorted(t for t in handle.timers if t <= now):
            for frame in together.handleExpiredTimer((7,), clock, None):
                out += frame.to_dict("records")
            handle.timers.discard(at)
        now = max(now, max((r["start_ms"] for r in batch), default=FAR) + 1 - delay)
    return out, handle


@pytest.mark.parametrize("kind", ["utterances", "neighbours", "chunks"])
def test_conversations_of_a_state_key_share_its_calls(kind):
    """As many calls to the state for 200 conversations as for few, and each has the rows that it has alone."""
    names = {
        "utterances": ["conv_id", "speaker", "start_ms", "end_ms", "n_tokens", "text"],
        "neighbours": ["conv_id", *[c.split()[0] for c in S.Neighbours.LINE.split(", ")]],
        "chunks": ["conv_id", "k", "items"],
    }[kind]

    def make():
        if kind == "utterances":
            return S.Utterances(names, 1000)
        return S.Neighbours(names, 1500, "non_backchannel", 10**8) if kind == "neighbours" else S.Chunks(names, 2000, 10**8)

    def rows_of(conv):
        for i in range(40):
            at = 700 * i + conv % 13 * 100 + (i // 9) * 3000
            yield dict(
                conv_id=conv, utt_idx=i, tok_idx=0, seq=i, kind="asr", speaker="AB"[(i * 7 + conv) % 5 // 3], start_ms=at, end_ms=at + 600,
                n_tokens=2, text=f"{conv}.{i}", token=f"{conv}.{i}", bc_label="continuer" if (i + conv) % 4 == 0 else None,
            )

    def cut(rows):
        rows = sorted(rows, key=lambda r: r["start_ms"])
        return [[r for r in rows if lo <= r["start_ms"] < lo + 9000] for lo in range(0, 45_000, 9000)]

    def plain(rows):
        return sorted(repr([S.plain(v) if not isinstance(v, list) else v for v in r.values()]) for r in rows)

    calls = {}
    for n in (4, 200):
        out, handle = drive_together(make(), cut([r for c in range(n) for r in rows_of(c)]), 5000)
        calls[n] = handle.cost["calls"]
        assert handle.kept() == 0
    alone = []
    for c in range(200):
        mine, one, now = cut(rows_of(c)), Handle(), 0
        processor = make()
        processor.init(one)
        whole = cut([r for k in range(200) for r in rows_of(k)])
        for batch, all_rows in [*zip(mine, whole), ([], []), ([], [])]:
            clock = Clock(now)
            if batch:
                processor.handleInputRows((c,), iter([pd.DataFrame(batch)]), clock)
            for at in sorted(t for t in one.timers if t <= now):
                for frame in processor.handleExpiredTimer((c,), clock, None):
                    alone += frame.to_dict("records")
                one.timers.discard(at)
            now = max(now, max((r["start_ms"] for r in all_rows), default=FAR) + 1 - 5000)
    assert plain(out) == plain(alone) and len(out) > 200
    assert calls[200] <= calls[4] + 8


def test_a_long_list_is_added_to_in_pieces():
    """Long utterances lie in pieces by themselves; what is written a row does not grow, and nothing is left."""
    toks = [dict(conv_id="x", utt_idx=0, tok_idx=i, speaker="A", start_ms=100 * i, end_ms=100 * i + 90, text=str(i % 10)) for i in range(20_000)]
    out, handle = drive_together(S.Utterances(["conv_id", "speaker", "start_ms", "end_ms", "n_tokens", "text"], 1000), [toks[i : i + 500] for i in range(0, len(toks), 500)], 5000)
    assert [(r["n_tokens"], r["text"]) for r in out] == [(20_000, "0123456789" * 2000)]
    assert handle.kept() == 0


def test_conversation_numbers_keep_their_value(spark, tmp_path):
    """Numbers past 2^53 beside a null one."""
    mk = lambda c, at: dict(conv_id=c, utt_idx=0, tok_idx=0, speaker="A", start_ms=at, end_ms=at + 50, text="x")
    ids = [2**60 + 1, 2**60, None, -3]
    end = [mk(-1, FAR)]
    got = run(spark, tmp_path, "k", P.TOK_SCHEMA, [[mk(c, 100) for c in ids], end], live.utterances)
    assert sorted(str(r.conv_id) for r in got if r.conv_id != -1) == sorted(map(str, ids))
