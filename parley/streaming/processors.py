"""Stateful processors: rows of one conversation in order of time, however many come in one trigger.

Rows wait in a map, a block of time per entry, and are handed on, in order, a slot of time at once when the
watermark has passed the slot's end. What a processor keeps beyond that lives in values, maps and lists
of its own, which are added to and not rewritten: a new row costs the same whether the conversation has a
hundred rows or a million. A key has one timer, at the next time at which something can happen.

``Together`` runs such a processor for many conversations under one state key, so that a trigger costs a few
calls to the state store for all of them and not twenty or more for each.

Needs a state store with column families, see ``live.prepared``.
"""

import io
import pickle
import sys

import pandas as pd
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql.streaming import StatefulProcessor

SLOT_MS = 1000
BLOCK_MS = 30 * SLOT_MS
FLUSH = 10_000  # rows of an output frame
INLINE = 64  # items of a list that lie with the conversation's other state


def slot_end(ms):
    """End of the slot that holds a time."""
    return (ms // SLOT_MS + 1) * SLOT_MS


def plain(value):
    """A cell as a plain Python value, null as None."""
    if value is None or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


class InOrder(StatefulProcessor):
    """Base: hands rows on in order. ``fields`` are (name, type) of the columns kept, ``start_ms`` first."""

    fields = ()

    def order(self, row):
        """Sort key of the rows of a slot."""
        return row

    def settle(self, key, groups, until):
        """Output rows, given (slot end, rows) groups; no further row starts before ``until``."""
        raise NotImplementedError

    def init(self, handle):
        self.handle, self.done = handle, None
        row = ",".join(f"{name}:{kind}" for name, kind in self.fields)
        self.waiting = handle.getMapState("waiting", "slot long", f"rows array<struct<{row}>>")
        self.open_state(handle)

    def close(self):
        pass

    def handleInputRows(self, key, rows, timerValues):
        now, blocks = timerValues.getCurrentWatermarkInMs(), {}
        for frame in rows:
            for row in zip(*self.columns(frame, now)):
                blocks.setdefault(row[0] // BLOCK_MS, []).append(row)
        for block, new in blocks.items():
            held = self.waiting.getValue((block,))
            self.waiting.updateValue((block,), ([*(tuple(r) for r in held[0]), *new] if held else new,))
        if blocks:
            self.handle.registerTimer(slot_end(min(row[0] for row in blocks[min(blocks)])))
        return iter(())

    def columns(self, frame, now, keys=()):
        """The key columns and the fields of a frame, without the rows that come behind the watermark."""
        frame = frame[frame["start_ms"] >= now]
        return [self.cells(frame[name], kind) for name, kind in (*((k, None) for k in keys), *self.fields)]

    def cells(self, column, kind):
        if column.dtype.kind in "iu":
            return column.tolist()
        return [v if type(v) is str else self.cell(v, kind) for v in column]

    @staticmethod
    def cell(value, kind):
        value = plain(value)
        return int(value) if value is not None and kind in ("long", "bigint", "int") else value

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, now):  # the first of a key's timers did the work of all
            return
        self.done = (key, now)
        yield from self.frames(self.expired(key, now))

    def expired(self, key, now):
        """Output rows of a conversation with a timer that has run out."""
        until = now // SLOT_MS * SLOT_MS
        for row in self.settle(key, self.released(until), until):
            yield (*key, *row)

    def frames(self, rows):
        out = []
        for row in rows:
            out.append(row)
            if len(out) >= FLUSH:
                yield pd.DataFrame(out, columns=self.names, dtype=object)
                out = []
        if out:
            yield pd.DataFrame(out, columns=self.names, dtype=object)

    def released(self, until):
        """(slot end, ordered rows) of the slots that no further row can come into."""
        blocks, self.ahead = sorted(block for (block,) in self.waiting.keys()), None
        for block in blocks:
            if block * BLOCK_MS >= until:
                self.ahead = self.ahead or slot_end(min(r[0] for r in self.waiting.getValue((block,))[0]))
                break
            rows = [tuple(r) for r in self.waiting.getValue((block,))[0]]
            later = [r for r in rows if r[0] >= until]
            if later:
                self.waiting.updateValue((block,), (later,))
                self.ahead = self.ahead or slot_end(min(r[0] for r in later))
            else:
                self.waiting.removeKey((block,))
            slots = {}
            for row in rows:
                if row[0] < until:
                    slots.setdefault(slot_end(row[0]), []).append(row)
            for end in sorted(slots):
                yield end, sorted(slots[end], key=self.order)

    def wake(self, *times):
        """A timer at the first of these times and of the next slot that holds rows."""
        times = [t for t in (*times, self.ahead) if t is not None]
        if times:
            self.handle.registerTimer(min(times))

    def forget(self):
        """Drop the timers of a conversation that is over, if nothing waits."""
        if self.ahead is None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)


class Utterances(InOrder):
    """One utterance is open at a time: its bounds are a value, its texts a list that is appended to."""

    fields = [("start_ms", "long"), ("utt_idx", "long"), ("tok_idx", "long"), ("end_ms", "long"), ("speaker", "string"), ("text", "string")]

    def __init__(self, names, gap_ms):
        self.names, self.gap_ms = names, gap_ms

    def open_state(self, handle):
        self.bounds = handle.getValueState("bounds", "speaker string, start long, last long, n long")
        self.texts = handle.getListState("texts", "text string")

    def order(self, row):
        return row[:3]

    def settle(self, key, groups, until):
        held = self.bounds.get()
        open_, stored, fresh = list(held) if held else None, held is not None, []

        def closed():
            before = [t for (t,) in self.texts.get()] if stored else []
            return (*open_, "".join(before + fresh))

        for _, rows in groups:
            for start, _, _, end, speaker, text in rows:
                if open_ and open_[0] == speaker and start - open_[2] <= self.gap_ms:
                    open_[2], open_[3] = end, open_[3] + 1
                else:
                    if open_:
                        yield closed()
                    open_, stored, fresh = [speaker, start, end, 1], False, []
                fresh.append(text or "")
        if open_ and slot_end(open_[2] + self.gap_ms) <= until:
            yield closed()
            open_ = None
        if held and not (open_ and stored):
            self.texts.clear()
        if not open_:
            if held:
                self.bounds.clear()
            return self.wake()
        self.bounds.update(tuple(open_))
        if fresh:
            self.texts.appendList([(t,) for t in fresh])
        self.wake(slot_end(open_[2] + self.gap_ms))


class Neighbours(InOrder):
    """Lines with the next line, and the next of the same and of another speaker, as far as rules look.

    A line that is settled leaves. A settled line that only waits for another speaker moves to a list
    that is read once, when that speaker comes. A row without a speaker ends the conversation, as does
    event time without a row for ``idle_ms``; whatever waits is then put out as it is.
    """

    fields = [
        ("start_ms", "long"),
        ("utt_idx", "long"),
        ("speaker", "string"),
        ("end_ms", "long"),
        ("n_tokens", "long"),
        ("text", "string"),
        ("bc_label", "string"),
    ]
    LINE = (
        "utt_idx long, speaker string, start_ms long, end_ms long, n_tokens long, text string, bc_label string, "
        "next_speaker string, next_start long, next_end long, "
        + ", ".join(f"{w}_utt_idx long, {w}_start_ms long, {w}_end_ms long, {w}_n_tokens long" for w in ("same", "other"))
    )
    # Places in a line: what it is, its next line, its mates.
    IDX, SPEAKER, START, END, LABEL, NEXT, SAME, OTHER = 0, 1, 2, 3, 6, 7, 10, 14

    def __init__(self, names, horizon_ms, no_label, idle_ms):
        self.names, self.horizon_ms, self.no_label, self.idle_ms = names, horizon_ms, no_label, idle_ms

    def open_state(self, handle):
        self.lines = handle.getMapState("lines", "at long", self.LINE)
        self.stuck = handle.getListState("stuck", self.LINE)

    def order(self, row):
        return row[0], row[2] is None, -1 if row[1] is None else row[1]

    def settle(self, key, groups, until):
        stored = {at: list(line) for (at,), line in self.lines.iterator()}
        lines = {at: list(line) for at, line in stored.items()}  # in order; the last one has no next line
        lines = dict(sorted(lines.items()))
        stuck, fresh = self.stuck.exists(), []
        for end, rows in groups:
            for start, idx, speaker, stop, n, text, label in rows:
                if speaker is None:
                    yield from self.ended(lines, stuck, fresh)
                    lines, stuck, fresh = {}, False, []
                    continue
                last = next(reversed(lines.values()), None)
                if last and last[self.SPEAKER] != speaker and (stuck or fresh):
                    for line in self.taken(stuck, fresh):
                        yield (*line[: self.OTHER], idx, start, stop, n)
                    stuck, fresh = False, []
                for line in lines.values():
                    if line is last:
                        line[self.NEXT : self.NEXT + 3] = speaker, start, stop
                    mate = self.SAME if line[self.SPEAKER] == speaker else self.OTHER
                    if line[mate] is None:
                        line[mate : mate + 4] = idx, start, stop, n
                lines[next(reversed(lines), -1) + 1] = [idx, speaker, start, stop, n, text, label, *[None] * 11]
            yield from self.settled(lines, fresh, end)
        yield from self.settled(lines, fresh, until)
        last = next(reversed(lines.values()), None)
        if last and self.idle_ms is not None and last[self.START] + self.idle_ms < until and self.ahead is None:
            yield from self.ended(lines, stuck, fresh)
            lines, stuck, fresh = {}, False, []
        for at in stored:
            if at not in lines:
                self.lines.removeKey((at,))
        for at, line in lines.items():
            if stored.get(at) != line:
                self.lines.updateValue((at,), tuple(line))
        if fresh:
            self.stuck.appendList([tuple(line) for line in fresh])
        if not lines:
            return self.forget()
        wake = [slot_end(line[self.END] + self.horizon_ms) for line in lines.values() if line is not last]
        wake += [slot_end(last[self.START] + self.idle_ms)] if self.idle_ms is not None else []
        self.wake(*[t for t in wake if t > until])

    def settled(self, lines, fresh, until):
        """Lines whose look-ahead is over and whose next line is known; ``fresh`` gets the stuck ones."""
        for at, line in list(lines.items()):
            if line[self.END] + self.horizon_ms < until and line[self.NEXT + 1] is not None:
                del lines[at]
                if line[self.OTHER] is None and line[self.LABEL] not in (None, "", self.no_label):
                    fresh.append(line)
                else:
                    yield tuple(line)

    def taken(self, stuck, fresh):
        if stuck:
            yield from map(list, self.stuck.get())
            self.stuck.clear()
        yield from fresh

    def ended(self, lines, stuck, fresh):
        for line in [*self.taken(stuck, fresh), *lines.values()]:
            yield tuple(line)


class Chunks(InOrder):
    """Events counted into chunks; the open chunk's events are a list that is appended to.

    A row without a kind ends the conversation, as does event time without a row for ``idle_ms``: the open
    chunk is put out and nothing of the conversation is kept.
    """

    fields = [("start_ms", "long"), ("seq", "long"), ("end_ms", "long"), ("kind", "string"), ("speaker", "string"), ("token", "string")]
    ITEM = "seq long, kind string, speaker string, token string"

    def __init__(self, names, chunk_ms, idle_ms):
        self.names, self.chunk_ms, self.idle_ms = names, chunk_ms, idle_ms

    def open_state(self, handle):
        self.head = handle.getValueState("head", "begin long, reach long, k long, last long")
        self.items = handle.getListState("items", self.ITEM)

    def order(self, row):
        return row[3] is None, -1 if row[1] is None else row[1]

    def settle(self, key, groups, until):
        held = self.head.get()
        head, stored, fresh = list(held) if held else None, self.items.exists(), []

        def chunk():
            names = [c.split()[0] for c in self.ITEM.split(", ")]
            items = [*(tuple(i) for i in self.items.get()), *fresh] if stored else fresh
            return head[2], [dict(zip(names, i)) for i in items]

        for _, rows in groups:
            for start, seq, end, kind, speaker, token in rows:
                if kind is None:
                    if stored or fresh:
                        yield chunk()
                    head, fresh = None, []
                    stored = stored and self.items.clear() is not None
                    continue
                head = head or [start, end, 1, start]
                head[1], head[3] = max(head[1], end), start
                k = max(1, -((head[0] - head[1]) // self.chunk_ms))
                if k != head[2] and (stored or fresh):
                    yield chunk()
                    fresh, stored = [], stored and self.items.clear() is not None
                head[2] = k
                fresh.append((seq, kind, speaker, token))
        # What is still to come starts after the border, and so ends in a later chunk.
        if (stored or fresh) and head[0] + head[2] * self.chunk_ms < until:
            yield chunk()
            fresh, stored = [], stored and self.items.clear() is not None
        if head and self.idle_ms is not None and not (stored or fresh) and self.ahead is None and head[3] + self.idle_ms < until:
            head = None
        if head is None:
            if held:
                self.head.clear()
            return self.forget()
        self.head.update(tuple(head))
        if fresh:
            self.items.appendList(fresh)
        border = slot_end(head[0] + head[2] * self.chunk_ms) if fresh or stored else None
        idle = slot_end(head[3] + self.idle_ms) if self.idle_ms is not None else None
        self.wake(border, idle)


class Held:
    """A state variable of the conversation that is open on a shelf: a value or a map."""

    def __init__(self, shelf, name):
        self.shelf, self.name = shelf, name

    def get(self):
        return self.shelf.open.get(self.name)

    def update(self, value):
        self.shelf.open[self.name] = value

    def clear(self):
        self.shelf.open.pop(self.name, None)

    def iterator(self):
        return iter(list(self.shelf.open.get(self.name, {}).items()))

    def updateValue(self, at, value):
        self.shelf.open.setdefault(self.name, {})[at] = value

    def removeKey(self, at):
        entries = self.shelf.open[self.name]
        del entries[at]
        if not entries:
            self.clear()


class HeldList:
    """A list: its last items lie with the conversation's other state, pieces of over ``INLINE`` by themselves."""

    def __init__(self, shelf, name):
        self.shelf, self.name = shelf, name

    def exists(self):
        return self.name in self.shelf.open

    def at(self, n):
        return repr(self.shelf.key), self.name, n

    def appendList(self, items):
        pieces, last = self.shelf.open.get(self.name, (0, []))
        last = last + items
        if len(last) > INLINE:
            self.shelf.pieces.updateValue(self.at(pieces), (pickle.dumps(last),))
            pieces, last = pieces + 1, []
        self.shelf.open[self.name] = pieces, last

    def get(self):
        pieces, last = self.shelf.open.get(self.name, (0, []))
        for n in range(pieces):
            yield from pickle.loads(bytes(self.shelf.pieces.getValue(self.at(n))[0]))
        yield from last

    def clear(self):
        for n in range(self.shelf.open.pop(self.name, (0, []))[0]):
            self.shelf.pieces.removeKey(self.at(n))


class HeldBlocks:
    """The waiting rows, by block of time: a page of the store has the rows of all conversations in a block."""

    def __init__(self, shelf):
        self.shelf = shelf

    def keys(self):
        return [(block,) for block in self.shelf.open.get("blocks", ())]

    def getValue(self, at):
        return (self.shelf.page(at[0])[self.shelf.key],)

    def updateValue(self, at, value):
        self.shelf.page(at[0])[self.shelf.key] = value[0]
        self.shelf.changed.add(at[0])

    def removeKey(self, at):
        del self.shelf.page(at[0])[self.shelf.key]
        self.shelf.changed.add(at[0])
        self.shelf.open["blocks"].discard(at[0])
        if not self.shelf.open["blocks"]:
            del self.shelf.open["blocks"]


class Shelf:
    """The state of the conversations of one state key; to a processor, the handle of the one that is open."""

    def __init__(self, handle):
        self.handle = handle
        self.all = handle.getValueState("conversations", "state binary")
        self.waiting = handle.getMapState("pages", "block long", "rows binary")
        self.pieces = handle.getMapState("pieces", "conversation string, name string, piece long", "items binary")

    def load(self):
        held = self.all.get()
        self.states = pickle.loads(bytes(held[0])) if held else {}
        self.pages, self.changed = {}, set()

    def store(self):
        for block in self.changed:
            page = self.pages[block]
            if page:
                self.waiting.updateValue((block,), (pickle.dumps(page),))
            else:
                self.waiting.removeKey((block,))
        if self.states:
            self.all.update((pickle.dumps(self.states),))
        else:
            self.all.clear()

    def add(self, block, rows):
        """Rows by conversation, written behind those that the block has."""
        held = self.waiting.getValue((block,))
        self.waiting.updateValue((block,), ((bytes(held[0]) if held else b"") + pickle.dumps(rows),))

    def page(self, block):
        if block not in self.pages:
            page, written = {}, io.BytesIO(self.waiting.getValue((block,))[0])
            while written.tell() < len(written.getbuffer()):
                for key, rows in pickle.load(written).items():
                    page.setdefault(key, []).extend(rows)
            self.pages[block] = page
        return self.pages[block]

    def turn_to(self, key):
        self.key, self.open = key, self.states.setdefault(key, {})

    def next_timer(self):
        return min((min(s["timers"]) for s in self.states.values() if "timers" in s), default=None)

    def getMapState(self, name, *_):
        return HeldBlocks(self) if name == "waiting" else Held(self, name)

    def getListState(self, name, *_):
        return HeldList(self, name)

    def getValueState(self, name, *_):
        return Held(self, name)

    def registerTimer(self, at):
        self.open.setdefault("timers", set()).add(at)

    def deleteTimer(self, at):
        self.open["timers"].discard(at)
        if not self.open["timers"]:
            del self.open["timers"]

    def listTimers(self):
        return iter(self.open.get("timers", ()))


class Together(StatefulProcessor):
    """A processor run for each of the conversations of a state key; ``keys`` are the columns that tell them apart.

    What is small of all of them is one value, waiting rows are a page for each block of time: both are read
    and written once a trigger. Long lists stay by themselves and are added to.
    """

    def __init__(self, each, keys):
        self.each, self.keys = each, keys

    def init(self, handle):
        self.handle, self.done, self.shelf = handle, None, Shelf(handle)
        self.each.init(self.shelf)

    def close(self):
        pass

    def handleInputRows(self, key, rows, timerValues):
        now, n, blocks = timerValues.getCurrentWatermarkInMs(), len(self.keys), {}
        for frame in rows:
            for row in zip(*self.each.columns(frame, now, self.keys)):
                blocks.setdefault(row[n] // BLOCK_MS, {}).setdefault(row[:n], []).append(row[n:])
        if not blocks:
            return iter(())
        shelf = self.shelf
        shelf.load()
        before, seen = shelf.next_timer(), set()
        for block in sorted(blocks):
            shelf.add(block, blocks[block])
            for conversation, new in blocks[block].items():
                shelf.turn_to(conversation)
                shelf.open.setdefault("blocks", set()).add(block)
                if conversation not in seen:
                    seen.add(conversation)
                    shelf.registerTimer(slot_end(min(row[0] for row in new)))
        shelf.store()
        first = shelf.next_timer()
        if before is None or first < before:
            self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        if self.done == (key, now):
            return
        self.done = (key, now)
        self.shelf.load()
        yield from self.each.frames(self.expired(now))
        self.shelf.store()
        first = self.shelf.next_timer()
        if first is not None:
            self.handle.registerTimer(first)
        else:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)

    def expired(self, now):
        shelf = self.shelf
        due = [k for k, s in shelf.states.items() if min(s.get("timers", [now + 1])) <= now]
        for conversation in due:
            shelf.turn_to(conversation)
            yield from self.each.expired(conversation, now)
            for at in [t for t in shelf.listTimers() if t <= now]:
                shelf.deleteTimer(at)
            if not shelf.open:
                del shelf.states[conversation]


# Workers need not have this package installed.
register_pickle_by_value(sys.modules[__name__])
