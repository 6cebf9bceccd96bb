"""Operators whose semantics are sequential: logs replayed in order, one machine for each key.

Rows are dealt by key and sorted within partitions, so a machine reads its log as a stream of batches and
holds its own state only: the keys of a cache, the queue of a limiter, the buffer of a store. The sort
spills; no log is held as a whole.
"""

from __future__ import annotations

import bisect
import heapq
from collections import OrderedDict, deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Row = dict
#: Rows of a result that are handed on together.
HANDED = 1 << 16


class Machine:
    """Takes the rows of one key in order; each row, and the end of the log, may give rows."""

    def feed(self, row: Row) -> list[tuple]:
        return []

    def close(self) -> list[tuple]:
        return []


def replay(log: DataFrame, by: str, order: list[str], make: Callable[[], Machine], schema: str) -> DataFrame:
    """The rows that a machine of each value of ``by`` gives, under ``schema`` (columns without the key, which comes first)."""
    kind, columns = dict(log.dtypes)[by], [c for c in log.columns if c != by]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine, out = None, None, []

        def handed() -> pd.DataFrame:
            frame = pd.DataFrame(out, columns=[by, *names])
            out.clear()
            return frame

        for frame in frames:
            for k, *values in zip(frame[by], *[frame[c] for c in columns], strict=True):
                if machine is None or k != key:
                    if machine is not None:
                        out += [(key, *r) for r in machine.close()]
                    key, machine = k, make()
                out += [(key, *r) for r in machine.feed(dict(zip(columns, values, strict=True)))]
                if len(out) >= HANDED:
                    yield handed()
        if machine is not None:
            out += [(key, *r) for r in machine.close()]
        if out:
            yield handed()

    return log.where(f"`{by}` IS NOT NULL").repartition(by).sortWithinPartitions(by, *order).mapInPandas(run, f"`{by}` {kind}, {schema}")


class Lru(Machine):
    """A cache of at most ``budget`` bytes: get, set and delete with key and bytes."""

    def __init__(self, budget: int, keys_only: bool = False):
        self.budget, self.keys_only = budget, keys_only
        self.held: OrderedDict[str, int] = OrderedDict()
        self.total = 0

    def feed(self, row: Row) -> list[tuple]:
        key, size, held = row["key"], row["bytes"], self.held
        hit = key in held
        if row["op"] == "get":
            if hit:
                held.move_to_end(key)
        else:
            self.total -= held.pop(key, 0)
            if row["op"] == "set" and size <= self.budget:
                while self.total + size > self.budget:
                    self.total -= held.popitem(last=False)[1]
                held[key] = size
                self.total += size
        return [] if self.keys_only else [(row["seq"], hit, self.total)]

    def close(self) -> list[tuple]:
        return [(k,) for k in self.held] if self.keys_only else []


class Flushes(Machine):
    """Numbers the flush of each write: one starts when the bytes since the last reach ``threshold``."""

    def __init__(self, threshold: int, size: str, columns: list[str]):
        self.threshold, self.size, self.columns = threshold, size, columns
        self.flush = self.held = 0

    def feed(self, row: Row) -> list[tuple]:
        out = (*[row[c] for c in self.columns], self.flush)
        self.held += row[self.size]
        if self.held >= self.threshold:
            self.flush, self.held = self.flush + 1, 0
        return [out]


class Fold(Machine):
    """A reducer over values in order; one row at the end."""

    def __init__(self, reducer: Callable, start, value: str):
        self.reducer, self.state, self.value = reducer, start, value

    def feed(self, row: Row) -> list[tuple]:
        self.state = self.reducer(self.state, row[self.value])
        return []

    def close(self) -> list[tuple]:
        return [(self.state,)]


class Boundary(Machine):
    """A binary search for the first block with code in [low, high], over a log of (block, has code); a block is as its last entry says.

    It holds the blocks at which the answer changes. Where code comes and goes it finds what the search would find.
    """

    def __init__(self, block: str, has_code: str, low: int, high: int):
        self.block, self.has_code, self.low, self.high = block, has_code, low, high
        self.changes: list[int] = []  # code is there after an odd number of them

    def feed(self, row: Row) -> list[tuple]:
        if bool(row[self.has_code]) != bool(len(self.changes) % 2):
            if self.changes and self.changes[-1] == row[self.block]:
                self.changes.pop()
            else:
                self.changes.append(row[self.block])
        return []

    def _at(self, block: int) -> bool:
        return bool(bisect.bisect_right(self.changes, block) % 2)

    def close(self) -> list[tuple]:
        low, high, found = self.low, self.high, None
        if not self._at(high):
            return [(None,)]
        while low <= high:
            middle = (low + high) // 2
            if self._at(middle):
                found, high = middle, middle - 1
            else:
                low = middle + 1
        return [(found,)]


class Shared(Machine):
    """Calls with one id: those that begin while a leader is under way share its result."""

    def __init__(self, start: str, end: str):
        self.start, self.end, self.lead, self.until = start, end, None, None

    def feed(self, row: Row) -> list[tuple]:
        if self.lead is None or row[self.start] >= self.until:
            self.lead, self.until = row[self.start], row[self.end]
        return [(row[self.start], row[self.end], self.lead)]


class Limiter(Machine):
    """A token bucket and a cap on requests under way; lower priorities first, FIFO among equals, none last. No rate: only the first burst starts."""

    def __init__(self, burst: int, per_second: float, slots: int):
        self.burst, self.slots, self.step = burst, slots, 1e6 / per_second if per_second > 0 else float("inf")
        self.waiting: list = []
        self.running: list = []
        self.now, self.tokens, self.stamp = 0.0, float(burst), 0.0

    def _until(self, time: float) -> list[tuple]:
        """Admit what can start before ``time``; requests that arrive then come first."""
        out = []
        while self.waiting and self.now < time:
            while self.running and self.running[0] <= self.now:
                heapq.heappop(self.running)
            self.tokens, self.stamp = min(self.burst, self.tokens + (self.now - self.stamp) / self.step), self.now
            if len(self.running) >= self.slots:
                self.now = max(self.now, self.running[0])
            elif self.tokens < 1 - 1e-9:
                self.now += (1 - self.tokens) * self.step
            else:
                _, seq, duration = heapq.heappop(self.waiting)
                self.tokens -= 1
                heapq.heappush(self.running, self.now + duration)
                out.append((seq, round(self.now)))
        return out

    def feed(self, row: Row) -> list[tuple]:
        out = self._until(row["arrival_us"])
        self.now = max(self.now, row["arrival_us"])
        priority = float("inf") if pd.isna(row["priority"]) else row["priority"]
        heapq.heappush(self.waiting, (priority, row["seq"], row["duration_us"]))
        return out

    def close(self) -> list[tuple]:
        return self._until(float("inf"))


class Debounce(Machine):
    """Writes to one key with instant upstream and free tokens: due at min(last + debounce, first + max_delay), dropped if stale by then."""

    def __init__(self, debounce: int, max_delay: int, staleness: int):
        self.debounce, self.max_delay, self.staleness = debounce, max_delay, staleness
        self.first = self.last = self.seq = None
        self.n = 0

    def _settle(self, until: float) -> list[tuple]:
        if self.first is None or (due := min(self.last + self.debounce, self.first + self.max_delay)) > until:
            return []
        self.first = None
        return [(due, self.seq, self.n)] if due - self.last <= self.staleness else []

    def feed(self, row: Row) -> list[tuple]:
        out = self._settle(row["at"] - 1)
        if self.first is None:
            self.first, self.n = row["at"], 0
        self.last, self.seq, self.n = row["at"], row["seq"], self.n + 1
        return out

    def close(self) -> list[tuple]:
        return self._settle(float("inf"))


#: The number of no flush: after all others.
NO_FLUSH = float("inf")


class Buffered:
    """A key's buffered write. ``order`` is its place among the keys of the buffer; ``mark`` numbers the times it waits, 0 while it is under way."""

    __slots__ = ("seq", "first", "last", "version", "duration", "order", "mark")

    def __init__(self, first: int, order: int):
        self.first, self.order, self.version, self.mark = first, order, 0, 0


class DebouncedWriter(Machine):
    """A store's write buffer over all its keys: deadlines, one write under way for each key, a token bucket, a timeout, staleness, flushes.

    Rows have at, seq, key, op (set, delete, flush) and duration of the write upstream. Rows given: seq, outcome
    (written, timeout, stale, flushed), started and ended. Within one millisecond ends come first, then operations,
    then new writes. Tokens are counted in thousandths.

    Keys that wait lie in heaps by deadline and by age, and those that may be written in one by flush and deadline,
    so a step costs the logarithm of the buffer. A write to a key raises its values; its entries follow once they are
    least. What is no longer in the buffer, or waits anew, is passed over.
    """

    def __init__(self, options):
        self.o = options
        self.buffer: dict[str, Buffered] = {}
        self.under_way: dict[str, tuple] = {}  # started, seq, version, duration
        self.flushes: dict[int, tuple[int, dict[str, int], int]] = {}  # by number: seq, versions by key, asked at
        self.blocks: dict[str, deque[int]] = {}  # the flushes that wait for a key, oldest first
        self.due: list[tuple] = []  # deadline, order, mark, key
        self.age: list[tuple] = []  # last, order, mark, key
        self.ready: list[tuple] = []  # (flush, deadline), order, mark, key
        self.ends: list[tuple] = []  # end, key
        self.marks = self.orders = self.asked = 0
        self.now, self.tokens, self.stamp = 0, options.burst * 1000, 0

    def _resolve(self, key: str, version: int) -> list[tuple]:
        out, waiting = [], self.blocks.get(key)
        while waiting and self.flushes[waiting[0]][1][key] <= version:  # later flushes wait for later versions
            number = waiting.popleft()
            seq, keys, asked = self.flushes[number]
            del keys[key]
            if not keys:
                del self.flushes[number]
                out.append((seq, "flushed", asked, self.now))
        if waiting is not None and not waiting:
            del self.blocks[key]
        return out

    def _wait(self, key: str, entry: Buffered) -> None:
        self.marks += 1
        entry.mark, due = self.marks, self._deadline(entry)
        heapq.heappush(self.due, (due, entry.order, entry.mark, key))
        heapq.heappush(self.age, (entry.last, entry.order, entry.mark, key))
        if key in self.blocks:
            heapq.heappush(self.ready, ((self.blocks[key][0], due), entry.order, entry.mark, key))

    def _top(self, heap: list[tuple]) -> tuple | None:
        """The least entry of a heap with its present value."""
        while heap:
            at, order, mark, key = heap[0]
            entry = self.buffer.get(key)
            if entry is None or entry.mark != mark:
                heapq.heappop(heap)
                continue
            value = entry.last if heap is self.age else self._deadline(entry)
            if heap is self.ready:
                value = (at[0], value)
            if value == at:
                return heap[0]
            if heap is self.ready and at[0] == NO_FLUSH and value[1] > self.now:
                heapq.heappop(heap)
                heapq.heappush(self.due, (value[1], order, mark, key))
            else:
                heapq.heapreplace(heap, (value, order, mark, key))
        return None

    def _end(self) -> list[tuple]:
        out = []
        while self.ends and self.ends[0][0] <= self.now:
            _, key = heapq.heappop(self.ends)
            started, seq, version, duration = self.under_way.pop(key)
            late = duration >= self.o.timeout
            entry = self.buffer.get(key)
            if entry and entry.version == version:
                del self.buffer[key]
                entry = None
            elif entry and not late:
                entry.first = entry.last
            out.append((seq, "timeout" if late else "written", started, self.now))
            out += self._resolve(key, version)
            if entry:
                self._wait(key, entry)
        return out

    def _deadline(self, entry: Buffered) -> int:
        return min(entry.last + self.o.debounce, entry.first + self.o.max_delay)

    def _pump(self) -> list[tuple]:
        out = []
        while (old := self._top(self.age)) and self.now - old[0] > self.o.max_staleness:
            entry = self.buffer.pop(old[-1])
            out.append((entry.seq, "stale", entry.first, self.now))
            out += self._resolve(old[-1], entry.version)
        while True:
            while (least := self._top(self.due)) and least[0] <= self.now:
                due, order, mark, key = heapq.heappop(self.due)
                if key not in self.blocks:  # else it is there with its flush
                    heapq.heappush(self.ready, ((NO_FLUSH, due), order, mark, key))
            best = self._top(self.ready)
            if best is None:
                return out
            self.tokens, self.stamp = min(self.o.burst * 1000, self.tokens + (self.now - self.stamp) * self.o.per_second), self.now
            if self.tokens < 1000:
                return out
            self.tokens -= 1000
            key, entry = best[-1], self.buffer[best[-1]]
            entry.mark = 0
            self.under_way[key] = (self.now, entry.seq, entry.version, entry.duration)
            heapq.heappush(self.ends, (self.now + min(entry.duration, self.o.timeout), key))
            if entry.duration <= 0:
                out += self._end()

    def _next(self) -> float:
        """The next time at which something may happen by itself."""
        times = [self.ends[0][0]] if self.ends else []
        if least := self._top(self.due):
            times.append(least[0])
        if old := self._top(self.age):
            times.append(old[0] + self.o.max_staleness + 1)
        if self._top(self.ready) and self.o.per_second > 0:
            times.append(self.now + max(1, -int(-(1000 - self.tokens) // self.o.per_second)))
        return min(times, default=float("inf"))

    def _until(self, time: float) -> list[tuple]:
        """All that happens before ``time``."""
        out = self._pump()
        while (at := self._next()) < time:
            self.now = at
            out += self._end() + self._pump()
        return out

    def feed(self, row: Row) -> list[tuple]:
        out = []
        if row["at"] > self.now:
            out = self._until(row["at"])
            self.now = row["at"]
            out += self._end()
        if row["op"] == "flush":
            if self.buffer:
                self.asked += 1
                self.flushes[self.asked] = (row["seq"], {k: e.version for k, e in self.buffer.items()}, self.now)
                for key, entry in self.buffer.items():
                    if key in self.blocks:
                        self.blocks[key].append(self.asked)
                        continue
                    self.blocks[key] = deque([self.asked])
                    if key not in self.under_way:
                        heapq.heappush(self.ready, ((self.asked, self._deadline(entry)), entry.order, entry.mark, key))
            else:
                out.append((row["seq"], "flushed", self.now, self.now))
            return out
        key = row["key"]
        entry = self.buffer.get(key)
        if entry is None:
            self.orders += 1
            entry = self.buffer[key] = Buffered(self.now, self.orders)
        entry.seq, entry.last, entry.version, entry.duration = row["seq"], self.now, entry.version + 1, row["duration"]
        if entry.version == 1:
            self._wait(key, entry)
        return out

    def close(self) -> list[tuple]:
        return self._until(float("inf"))
