"""Exact sliding frames in linear-logarithmic time: counts, sums, distinct, most frequent and ranked values with eviction."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

SPAN = 8  # a chunk of a key is so many times as long as the frames that reach into it
LOAD = 512  # values of a block of a multiset


class Count:
    """How many values, null ones apart."""

    def __init__(self):
        self.n = 0

    def add(self, ts: int, value) -> None:
        self.n += 1

    def drop(self, ts: int, value) -> None:
        self.n -= 1

    def result(self):
        return self.n


class Sum(Count):
    def add(self, ts: int, value) -> None:
        self.n += value

    def drop(self, ts: int, value) -> None:
        self.n -= value


class Distinct:
    def __init__(self):
        self.held: dict = {}

    def add(self, ts: int, value) -> None:
        self.held[value] = self.held.get(value, 0) + 1

    def drop(self, ts: int, value) -> None:
        left = self.held[value] - 1
        if left:
            self.held[value] = left
        else:
            del self.held[value]

    def result(self):
        return len(self.held)


class Top:
    """The most frequent value; ties go to the one whose first time in the frame is earliest, then to the smaller.

    Each change of a value's count or first time puts its rank on a heap; ranks that no longer hold are thrown away when
    they come up, and all of them when they are most of the heap.
    """

    def __init__(self):
        self.times, self.heap = {}, []

    def _rank(self, value) -> tuple:
        own = self.times[value]
        return -len(own), own[0], value

    def _push(self, value) -> None:
        heapq.heappush(self.heap, self._rank(value))
        if len(self.heap) > 64 + 4 * len(self.times):
            self.heap = [self._rank(v) for v in self.times]
            heapq.heapify(self.heap)

    def add(self, ts: int, value) -> None:
        self.times.setdefault(value, deque()).append(ts)
        self._push(value)

    def drop(self, ts: int, value) -> None:
        own = self.times[value]
        own.popleft()
        if own:
            self._push(value)
        else:
            del self.times[value]

    def result(self):
        while self.heap:
            value = self.heap[0][2]
            if value in self.times and self.heap[0] == self._rank(value):
                return value
            heapq.heappop(self.heap)
        return None


class Multiset:
    """Sorted values in blocks; a Fenwick tree over the sizes of the blocks finds the value of a rank."""

    def __init__(self, load: int = LOAD):
        self.load, self.blocks, self.tops, self.tree, self.n = load, [], [], [], 0

    def _resize(self) -> None:
        self.blocks = [b for b in self.blocks if b]
        self.tops = [b[-1] for b in self.blocks]
        self.tree = [0] + [len(b) for b in self.blocks]
        for i in range(1, len(self.tree)):
            up = i + (i & -i)
            if up < len(self.tree):
                self.tree[up] += self.tree[i]

    def _shift(self, block: int, by: int) -> None:
        self.n += by
        i = block + 1
        while i < len(self.tree):
            self.tree[i] += by
            i += i & -i

    def add(self, value) -> None:
        if not self.blocks:
            self.blocks = [[value]]
            self.n += 1
            self._resize()
            return
        i = min(bisect_left(self.tops, value), len(self.tops) - 1)
        own = self.blocks[i]
        insort(own, value)
        self.tops[i] = own[-1]
        self._shift(i, 1)
        if len(own) > 2 * self.load:
            self.blocks[i : i + 1] = [own[: self.load], own[self.load :]]
            self._resize()

    def remove(self, value) -> None:
        i = bisect_left(self.tops, value)
        own = self.blocks[i]
        del own[bisect_left(own, value)]
        self._shift(i, -1)
        if own:
            self.tops[i] = own[-1]
        else:
            self._resize()

    def at(self, rank: int):
        """The value of a rank, from 0."""
        i, step = 0, 1 << (len(self.tree) - 1).bit_length()
        while step:
            if i + step < len(self.tree) and self.tree[i + step] <= rank:
                i += step
                rank -= self.tree[i]
            step >>= 1
        return self.blocks[i][rank]


class P95(Multiset):
    """The sorted value at max(0, n * 95 // 100 - 1)."""

    def add(self, ts: int, value) -> None:
        Multiset.add(self, value)

    def drop(self, ts: int, value) -> None:
        self.remove(value)

    def result(self):
        return float(self.at(max(0, self.n * 95 // 100 - 1))) if self.n else 0.0


KINDS = {"count": (Count, LongType()), "sum": (Sum, LongType()), "distinct": (Distinct, LongType()), "top": (Top, StringType()), "p95": (P95, DoubleType())}


@dataclass(frozen=True)
class Slide:
    """A result over the last `width` ms of a key: `kind` of the column's values that are not null.

    The frame of an event holds all events of its key from ts - width (without the boundary if not closed) up to ts, those
    of the same time included.
    """

    name: str
    kind: str
    column: str
    width: int
    closed: bool = True


class Frames:
    """The frames of one key as time goes on: add what comes, in order of time, then ask at a time."""

    def __init__(self, slides: list[Slide]):
        self.slides = slides
        self.held = [(deque(), KINDS[s.kind][0](), s.width if s.closed else s.width - 1) for s in slides]

    def put(self, i: int, ts: int, value) -> None:
        queue, own, _ = self.held[i]
        queue.append((ts, value))
        own.add(ts, value)

    def add(self, ts: int, values: tuple) -> None:
        for i, value in enumerate(values):
            if value is not None:
                self.put(i, ts, value)

    def at(self, ts: int) -> tuple:
        """The results at ts; what is older than a frame leaves it for good."""
        for queue, own, width in self.held:
            while queue and queue[0][0] < ts - width:
                own.drop(*queue.popleft())
        return tuple(own.result() for _, own, _ in self.held)


def slide(events: DataFrame, key: str, slides: list[Slide], ts: str = "ts_ms", span: int = SPAN) -> DataFrame:
    """events with a column for each Slide. An event without time has the results of an empty frame; null keys are one key.

    A key is cut in chunks of `span` times the widest frame, and the events that reach into the next chunk go there too, to
    fill its frames: at most 1/span of a steady stream more rows, and a busy key is as many tasks as it has chunks. A
    task reads its chunks in order of time and holds the events of the frames and of one time, so its memory is that of
    the frames; an event enters and leaves each frame once, at logarithmic cost at most.
    """
    schema = StructType([*events.schema.fields, *[StructField(s.name, KINDS[s.kind][1]) for s in slides]])
    length = span * max(s.width for s in slides)
    own, last = F.floor(F.col(ts) / length), F.floor((F.col(ts) + max(s.width for s in slides)) / length)
    dealt = events.withColumn("_chunk", F.explode(F.when(F.col(ts).isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(own, last)))).withColumn("_own", F.col("_chunk").isNull() | (F.col("_chunk") == own))
    names, columns, width = schema.names, [s.column for s in slides], len(events.columns)
    new = list(to_arrow_schema(StructType(schema.fields[width:])))

    def run(batches):
        at, frames, peers = None, None, 0  # (key, chunk, ts) of the events that wait for their results, and how many wait
        waiting, done = deque(), deque()

        def close():
            if peers:
                result = frames.at(at[2]) if at[2] is not None else Frames(slides).at(0)
                done.extend([result] * peers)

        def emit(final: bool):
            while waiting and (final or len(done) >= waiting[0].num_rows):
                batch = waiting.popleft()
                got = [done.popleft() for _ in range(batch.num_rows)]
                cols = [pa.array(c, f.type) for c, f in zip(zip(*got), new)] if got else [pa.array([], f.type) for f in new]
                keep = batch.column("_own")
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *cols], names=names).filter(keep)

        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            values = zip(*[batch.column(c).to_pylist() for c in columns])
            for k, c, t, v in zip(batch.column(key).to_pylist(), batch.column("_chunk").to_pylist(), batch.column(ts).to_pylist(), values):
                if at != (k, c, t):
                    close()
                    if at is None or at[:2] != (k, c):
                        frames = Frames(slides)
                    at, peers = (k, c, t), 0
                peers += 1
                if t is not None:
                    frames.add(t, v)
            yield from emit(False)
        close()
        yield from emit(True)

    return dealt.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", ts).mapInArrow(run, schema)
