"""Framing: the top-level objects of JSON files of any layout and size, damaged ones included.

A file is read in Spark's own blocks, cut at every `}`. A block is one sequential run of a small automaton,
which knows strings, open braces and, for each open brace, how many brackets are open inside it. A block's
effect on the state before it is short: what it closes, which commas would have to stand in an array, and
what it leaves open. Effects of the blocks of a file are computed side by side and folded, one row each; with
the state each block starts from known, all blocks are framed at once. Files of one block, which most
are, start from the empty state and take one pass.

Damage shows where the grammar does not allow what comes: an object may follow a colon, and a comma or a
bracket in an array; a string may be followed by a comma, a colon or a closing mark, and ends at the end of
its line. An object that begins anywhere else is a record of its own, and the record it seemed to be in is
broken off. So a bad record costs itself, and what is nested in a sound record never becomes a record.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from millrace.session import materialized

DEEP = 4
"""Sound records nested up to so many levels are recognised by one pattern, deeper ones mark by mark."""

LEVELS = 1_000
"""A block tells no more closing braces than so many of what is open before it; parsers stop there too."""

LOOSE_BYTES = 1 << 20
"""Text outside any object is rejected in parts of about so many bytes."""

BLOCKS_AT_ONCE = 100_000
"""States of blocks sent to every task at once; with more blocks, files are framed in several parts."""

SPACE = b" \t\r\n"
UNCLOSED, OUTSIDE = "unclosed", "outside any object"

_WS = rb"[ \t\r\n]*+"
_TEXT = rb'(?:[^"\\\n]++|\\[^\n])*+'
_STRING = b'"' + _TEXT + b'"'
_SCALAR = rb'[^\s,:{}\[\]"]++'


def _sound_object(levels: int) -> re.Pattern:
    """An object by the grammar, nested up to `levels` deep."""
    value = _STRING + b"|" + _SCALAR
    for _ in range(levels):
        item = b"(?:" + value + b")" + _WS
        whole = rb"\{" + _WS + b"(?:" + _STRING + _WS + b":" + _WS + item + b"(?:," + _WS + rb"|(?=\})))*+\}"
        array = rb"\[" + _WS + b"(?:" + item + b"(?:," + _WS + rb"|(?=\])))*+\]"
        value = b"|".join([_STRING, _SCALAR, whole, array])
    return re.compile(whole)


SOUND = _sound_object(DEEP)
MARK = re.compile(rb'["{}\[\]]')
STRING = re.compile(_STRING)
REST_OF_STRING = re.compile(_TEXT + b'"')
STRING_TO_END = re.compile(b'"' + _TEXT + rb"\\?\Z")
REST_TO_END = re.compile(_TEXT + rb"\\?\Z")
FOLLOWS = re.compile(_WS + rb"([,:}\]]|\Z)")

MORE, CLOSED, BROKEN, ENDED = "more", "closed", "broken", "ended"


class Framer:
    """Takes the bytes of one block as they come and gives its items: (offset, text, reason), with no reason
    for an object. `frames` is the state the block starts from: the open brackets in each open brace."""

    def __init__(self, offset: int = 0, frames: tuple[int, ...] = (), in_string: bool = False):
        self.offset = offset
        self.frames = list(frames)
        self.in_string = in_string
        self.data = b""
        self.parts: list[bytes] = []
        self.look = self.waiting = self.least = 0
        self.resuming = bool(frames) or in_string
        self.file_ends = False
        # Blocks, as files, begin behind a closing brace or behind nothing.
        self.previous = ord("}")
        self.items: list[tuple[int, str, str | None]] = []
        self.carried: tuple[str, str] | None = None
        """What the block adds to the record that was open before it, and how that ended."""
        self.left: tuple[int, str] | None = None
        """A record still open at the end of the block."""

    def feed(self, data: bytes) -> None:
        self.parts.append(data)
        self.waiting += len(data)
        if self.waiting >= self.least:
            self._run(False)

    def finish(self, file_ends: bool) -> None:
        """The block is over."""
        self.file_ends = file_ends
        self._run(True)

    # -- what a subclass may watch ---------------------------------------------------

    def outside(self, mark: bytes) -> None:
        """A bracket or a closing brace where no record that began in this block is open."""

    def begins(self, previous: int) -> None:
        """A record begins; `previous` is the byte before it."""

    def broke(self) -> None:
        """A record that began in this block is broken off by another."""

    # -- the automaton ---------------------------------------------------------------

    def _run(self, ends: bool) -> None:
        data = self.data + b"".join(self.parts)
        self.parts, self.least = [], 0
        start, look = 0, self.look
        if self.resuming:
            start = look = self._resume(data, ends)
            if start is None:
                return
        while True:
            found = MARK.search(data, look)
            if not found:
                break
            mark, here = found.group(), found.start()
            if mark == b'"':
                look = self._string(data, here, ends)
                if look is None:
                    return self._keep(data, start, here)
                if look < 0:
                    self.in_string, look = True, len(data)
                continue
            if mark != b"{":
                self.outside(mark)
                look = here + 1
                continue
            whole = SOUND.match(data, here)
            if whole:
                verdict, end, frames = CLOSED, whole.end(), []
            else:
                frames = [0]
                verdict, end = self._walk(data, here + 1, frames, ends)
                if verdict == MORE:
                    return self._keep(data, start, here)
            self._loose(data, start, here)
            self.begins(self._before(data, here))
            if verdict == ENDED:
                self.frames = frames
                if not self.file_ends:
                    self.left = (self.offset + here, _text(data[here:]))
                    return self._keep(data, len(data))
            if verdict == BROKEN:
                self.broke()
            # A lone brace that ends a file is no record that was begun.
            if verdict != ENDED or data[here:].rstrip(SPACE) != b"{":
                self._add(here, data[here:end], None if verdict == CLOSED else UNCLOSED)
            look = start = end
        if ends or len(data) - start > LOOSE_BYTES:
            self._loose(data, start, len(data))
            start = len(data)
        self._keep(data, start, len(data))

    def _keep(self, data: bytes, start: int, look: int | None = None) -> None:
        """Hold on to what is not settled, looked through up to `look`; go on when the rest has doubled."""
        look = start if look is None else look
        self.previous = self._before(data, start)
        self.data, self.look = data[start:], look - start
        self.offset += start
        self.waiting = len(self.data)
        self.least = self.waiting + len(data) - look

    def _before(self, data: bytes, at: int) -> int:
        """The byte before `at` that is no space."""
        at -= 1
        while at >= 0 and data[at] in SPACE:
            at -= 1
        return data[at] if at >= 0 else self.previous

    def _string(self, data: bytes, here: int, ends: bool) -> int | None:
        """Where to go on behind the quote at `here`: behind its string, or behind the quote alone if what
        follows the string shows that it is none. None: only more text can tell; -1: the string goes on
        beyond the block."""
        closed = STRING.match(data, here)
        if closed:
            follows = FOLLOWS.match(data, closed.end())
            if follows and not follows.group(1) and not ends:
                return None
            return closed.end() if follows else here + 1
        if STRING_TO_END.match(data, here):
            if not ends:
                return None
            return here + 1 if self.file_ends else -1
        return here + 1

    def _walk(self, data: bytes, at: int, frames: list[int], ends: bool) -> tuple[str, int]:
        """Go on in a record with `frames` open until it closes or is broken off."""
        while True:
            found = MARK.search(data, at)
            if not found:
                return (ENDED if ends else MORE), len(data)
            mark, here = found.group(), found.start()
            at = here + 1
            if mark == b'"':
                at = self._string(data, here, ends)
                if at is None:
                    return MORE, len(data)
                if at < 0:
                    self.in_string = True
                    return ENDED, len(data)
            elif mark == b"{":
                previous = self._before(data, here)
                if previous != ord(":") and not (previous in b",[" and frames[-1] > 0):
                    return BROKEN, here
                frames.append(0)
            elif mark == b"}":
                frames.pop()
                if not frames:
                    return CLOSED, at
            else:
                frames[-1] += 1 if mark == b"[" else -1

    def _resume(self, data: bytes, ends: bool) -> int | None:
        """Finish the record, or the string, that was open before the block; where it ends."""
        frames, at = list(self.frames), 0
        if self.in_string:
            closed = REST_OF_STRING.match(data)
            if closed:
                follows = FOLLOWS.match(data, closed.end())
                if follows and not follows.group(1) and not ends:
                    return self._keep(data, 0)
                at = closed.end() if follows else 0
            elif REST_TO_END.match(data):
                if not ends:
                    return self._keep(data, 0)
                if not self.file_ends:
                    self.carried = (_text(data), "") if frames else None
                    return self._keep(data, len(data))
        was, self.in_string = self.in_string, False
        if not frames:
            self.resuming = False
            return at
        verdict, end = self._walk(data, at, frames, ends)
        if verdict == MORE:
            self.in_string = was
            return self._keep(data, 0)
        self.resuming = False
        self.frames = []
        if verdict == ENDED:
            self.frames = frames
            self.carried = (_text(data), UNCLOSED if self.file_ends else "")
            return self._keep(data, len(data))
        self.carried = (_text(data[:end]), CLOSED if verdict == CLOSED else UNCLOSED)
        return end

    def _add(self, here: int, raw: bytes, reason: str | None) -> None:
        if reason:
            raw = raw.rstrip(SPACE)
        self.items.append((self.offset + here, _text(raw), reason))

    def _loose(self, data: bytes, start: int, end: int) -> None:
        """Reject the text between records, but for separators."""
        text = data[start:end].strip(SPACE + b",[]")
        if text:
            self._add(start + data[start:end].index(text), text, OUTSIDE)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


class Effect(Framer):
    """What a block does to the state before it. Of each brace that was open before, as far as the block
    reaches: the least balance of brackets at a comma before an object (None without one), and the balance in
    all. `settled`: something in the block ends every record before it."""

    def __init__(self, in_string: bool):
        super().__init__(in_string=in_string)
        self.levels: list[list[int | None]] = [[None, 0]]
        self.settled = False

    def outside(self, mark: bytes) -> None:
        if self.settled:
            return
        if mark == b"}":
            if len(self.levels) <= LEVELS:
                self.levels.append([None, 0])
        else:
            self.levels[-1][1] += 1 if mark == b"[" else -1

    def begins(self, previous: int) -> None:
        if self.settled or previous == ord(":"):
            return
        if previous in b",[":
            least, balance = self.levels[-1]
            self.levels[-1][0] = balance if least is None else min(least, balance)
        else:
            self.settled = True

    def broke(self) -> None:
        self.settled = True

    def _add(self, here: int, raw: bytes, reason: str | None) -> None:
        pass


def after(frames: list[int], effect: dict) -> tuple[list[int], bool]:
    """(open braces behind a block that starts with `frames` open, whether the record open before is still)."""
    held = list(frames)
    for i, level in enumerate(effect["levels"]):
        if i and held:
            held.pop()
        if not held or (level["least"] is not None and held[-1] + level["least"] <= 0):
            return list(effect["frames"]), False
        held[-1] += level["balance"]
    if effect["settled"]:
        return list(effect["frames"]), False
    return held + list(effect["frames"]), True


# In Spark


class Runs:
    """Rows of pieces, which come in the order of the file, as runs of one block each."""

    def __init__(self, make):
        self.make, self.at, self.worker = make, None, None

    def take(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Framer]]:
        """(path and block, worker that has been fed) of every block."""
        for batch in batches:
            values, paths, blocks, sizes, packed = (c.to_pylist() for c in batch.columns)
            first = 0
            for i in range(1, len(paths) + 1):
                if i < len(paths) and paths[i] == paths[first] and blocks[i] == blocks[first]:
                    continue
                own = (paths[first], blocks[first])
                if own != self.at:
                    if self.at:
                        yield self._done()
                    self.at, self.worker = own, self.make(*own)
                    self.size, self.packed, self.seen, self.held = sizes[first], packed[first], 0, None
                self._feed(values[first:i])
                first = i
        if self.at:
            yield self._done()

    def _feed(self, values: list[bytes]) -> None:
        # The last piece is held back: whether a brace ends it shows only when another follows.
        whole = ([] if self.held is None else [self.held]) + values
        self.held = whole.pop()
        if whole:
            data = b"}".join(whole) + b"}"
            self.seen += len(data)
            self.worker.feed(data)

    def _done(self) -> tuple[tuple[str, int], Framer]:
        start = getattr(self.worker, "start", 0)
        self.seen += len(self.held) + 1
        if self.packed:
            # The size on disk says nothing here; a brace is taken to be there unless nothing is before it.
            closed, file_ends = bool(self.held.strip(SPACE)), True
        else:
            closed, file_ends = start + self.seen <= self.size, start + self.seen >= self.size
        self.worker.feed(self.held + (b"}" if closed else b""))
        self.worker.finish(file_ends)
        return self.at, self.worker


ITEMS = pa.schema(
    [("path", pa.string()), ("position", pa.int64()), ("body", pa.string()), ("reason", pa.string())]
    + [("open_block", pa.int64()), ("block", pa.int64())]
)
EFFECTS = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("in_string", pa.bool_()), ("bytes", pa.int64())]
    + [("frames", pa.list_(pa.int32())), ("ends_in_string", pa.bool_()), ("settled", pa.bool_())]
    + [("levels", pa.list_(pa.struct([("least", pa.int32()), ("balance", pa.int32())])))]
)
STATES = pa.schema(
    [("path", pa.string()), ("block", pa.int64()), ("start", pa.int64()), ("in_string", pa.bool_())]
    + [("frames", pa.list_(pa.int32())), ("open_block", pa.int64())]
)


def framed(pieces: DataFrame, blockwise: int, compressed: str) -> DataFrame:
    """`path`, `position` (the byte the text begins at), `body`, `reason` (NULL for an object) of every top-level
    object and of whatever is none. `pieces` have `value`, `path`, `size`, `block`, `length`: the pieces of each
    block of each file, in order. Files above `blockwise` bytes, and those of several blocks, are framed block by
    block; `compressed` is a pattern of paths."""
    named = pieces.select(
        F.col("value").cast("binary"), "path", "block", "size", F.col("path").rlike(compressed).alias("packed"), "length"
    )
    divided = (F.col("size") > blockwise) | (F.col("length") < F.col("size"))
    columns = ["value", "path", "block", "size", "packed"]
    spark = pieces.sparkSession
    # No smaller file is ever divided; the bound prunes whole files from the scan.
    least = min(_bytes(spark, "spark.sql.files.maxPartitionBytes"), _bytes(spark, "spark.sql.files.openCostInBytes"), blockwise)
    large = named.where((F.col("size") > least) & divided & ~F.col("packed")).select(columns)
    if large.isEmpty():
        return named.select(columns).mapInArrow(_items({}), from_arrow_schema(ITEMS)).select("path", "position", "body", "reason")
    effects = large.mapInArrow(_effects, from_arrow_schema(EFFECTS))
    states = effects.groupBy("path").applyInArrow(_states, from_arrow_schema(STATES))
    states = materialized(states, "block-states")
    blocks = max(1, states.count())
    parts = -(-blocks // BLOCKS_AT_ONCE)
    part_of = F.pmod(F.xxhash64("path"), F.lit(parts))
    items = None
    for k in range(parts):
        known = {(r[0], r[1]): tuple(r[2:]) for r in states.where(part_of == k).collect()}
        own = named.where(part_of == k).select(columns).mapInArrow(_items(known), from_arrow_schema(ITEMS))
        items = own if items is None else items.unionByName(own)
    # A record over several blocks: its texts, one for each block, meet by the block it began in.
    joined = items.where("open_block IS NOT NULL").groupBy("path", "open_block").agg(
        F.min("position").alias("position"),
        F.array_sort(F.collect_list(F.struct("block", "body", "reason"))).alias("texts"),
    )
    last = F.element_at("texts", -1)["reason"]
    across = joined.select(
        "path",
        "position",
        F.regexp_replace(F.array_join(F.transform("texts", lambda t: t["body"]), ""), r"\s+\z", "").alias("body"),
        F.when(last != CLOSED, UNCLOSED).alias("reason"),
    )
    return items.where("open_block IS NULL").select("path", "position", "body", "reason").unionByName(across)


def framed_bodies(bodies: DataFrame, row_id: str, body: str) -> DataFrame:
    """`row_id`, `position`, `body`, `reason` as `framed` gives them, for texts in a column. Every row is framed by
    itself, repeated ids too; NULL and blank texts give nothing."""
    text, ends = F.col(body), F.col(body).endswith("}")
    pieces = bodies.where(text.isNotNull()).select(
        F.when(ends, F.substring(text, F.lit(1), F.length(text) - 1)).otherwise(text).cast("binary").alias("value"),
        F.col(row_id).cast("string").alias("path"),
        F.monotonically_increasing_id().alias("block"),
        F.octet_length(text).cast("long").alias("size"),
        F.lit(False).alias("packed"),
    )
    items = pieces.mapInArrow(_items({}), from_arrow_schema(ITEMS))
    kind = bodies.schema[row_id].dataType
    # A record that never closes is given as one that a next block might close; there is none.
    open_end = F.when(F.col("open_block").isNotNull(), UNCLOSED)
    return items.select(
        F.col("path").cast(kind).alias(row_id), "position", "body", F.coalesce(open_end, "reason").alias("reason")
    )


def _bytes(spark, name: str) -> int:
    """A size setting, as bytes."""
    text = spark.conf.get(name).strip().lower()
    found = re.fullmatch(r"(\d+)\s*([kmgt]?)i?b?", text)
    return int(found.group(1)) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[found.group(2)]


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two rows for every block: its effect if it starts outside a string, and inside one."""

    class Both:
        def __init__(self, *_):
            self.each = [Effect(False), Effect(True)]
            self.bytes = 0

        def feed(self, data):
            self.bytes += len(data)
            for e in self.each:
                e.feed(data)

        def finish(self, _file_ends):
            # Whether the file ends here is known when blocks are folded.
            for e in self.each:
                e.finish(False)

    runs = Runs(Both)
    for (path, block), both in runs.take(batches):
        rows = [
            {
                "path": path,
                "block": block,
                "in_string": inside,
                "bytes": runs.seen,
                "frames": e.frames,
                "ends_in_string": e.in_string,
                "settled": e.settled,
                "levels": [{"least": a, "balance": b} for a, b in e.levels],
            }
            for inside, e in zip((False, True), both.each)
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=EFFECTS)


def _states(effects: pa.Table) -> pa.Table:
    """Fold the effects of the blocks of one file, one after the other."""
    blocks: dict[int, dict[bool, dict]] = {}
    for row in effects.to_pylist():
        blocks.setdefault(row["block"], {})[row["in_string"]] = row
    rows, start, in_string, frames, open_block = [], 0, False, [], None
    for block in sorted(blocks):
        own = blocks[block][in_string]
        rows.append(
            {"path": own["path"], "block": block, "start": start, "in_string": in_string, "frames": frames, "open_block": open_block}
        )
        frames, still = after(frames, own)
        in_string = own["ends_in_string"]
        open_block = open_block if still else block if frames else None
        start += own["bytes"]
    return pa.Table.from_pylist(rows, schema=STATES)


def _items(known: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(path, block):
            start, in_string, frames, open_block = known.get((path, block), (0, False, (), None))
            framer = Framer(start, tuple(frames), in_string)
            framer.start, framer.open_block = start, open_block
            return framer

        for (path, block), done in Runs(make).take(batches):
            rows = [(path, at, body, reason, None, block) for at, body, reason in done.items]
            if done.carried and done.open_block is not None:
                body, verdict = done.carried
                rows.append((path, done.start, body, verdict, done.open_block, block))
            if done.left:
                rows.append((path, *done.left, "", block, block))
            columns = list(zip(*rows)) if rows else [()] * len(ITEMS)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, ITEMS)], schema=ITEMS)

    return run

