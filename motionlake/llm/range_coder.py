"""Adaptive context-mixing range coder for small whole numbers, such as the places of token ids in a frequency list.

A block is coded by itself: its models start afresh, and its header has its
length and the CRC-32 of its numbers. For every number three models are mixed
into one distribution:

- Order 2 and order 1: the two numbers before, and the one before, name the
  number that followed last, and how often running that was right.
- Order 0: numbers fall into classes that double in size, and callers number
  frequent ids first, so that a class holds ids about as frequent. A class's
  share is its frequency in the block so far, given the class of the number
  before, and is spread evenly over its numbers.

The weights of the mixture are learned: the share of order 2, and of what is
left that of order 1, follows how often each was right at the confidence that
both have now. Order 0 gets the rest. A carry-propagating range coder with
32-bit words codes the number in that distribution.

Many blocks are coded side by side as numpy lanes, one number of each at a step.
Arithmetic is all in integers, so decoding repeats it exactly.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR3"
HEADER = struct.Struct("<4sII")
#: Cells of each of orders 1 and 2 in a block.
SLOTS = 1 << 12
#: Bits of the mixture's total and of the learned weights.
TOTAL = 16
ODDS = 12
#: Levels of confidence of a cell.
LEVELS = 4
CLASSES = 16
#: Numbers must be below this: so many do the classes hold.
MOST = (1 << CLASSES) - 1
#: Steps after which the classes' shares are reckoned anew (and at the powers of two before).
REFRESH = 256
#: Blocks that are coded side by side.
LANES = 2048
_LOW = np.uint32(0xFFFF)
_U16 = np.uint32(16)
_U64 = [np.uint64(k) for k in range(65)]
#: The class of each number, and the first number of each class.
_CLASS = np.concatenate([np.full(1 << k, k, np.int64) for k in range(CLASSES)])
_FIRST = (1 << np.arange(CLASSES, dtype=np.int64)) - 1
#: What a cell gains, by its level and whether its guess was right: a level more or less.
_GAIN = np.array([[0, 1], [-1, 1], [-1, 1], [-1, 0]], np.int64).ravel().astype(np.uint32) << _U16
#: Where a weight moves, after a wrong guess and after a right one: at most 7/8 and 7/8 of the rest, so that every class keeps a share.
_GOAL = np.array([1 << (ODDS - 7), 7 << (ODDS - 3)], np.int32)


class _Lanes:
    """The models of k blocks. A cell holds a guess in its low 16 bits and the level of confidence above them."""

    def __init__(self, k: int):
        lane = np.arange(k, dtype=np.int64)
        self.cell_base = np.stack((lane * SLOTS, lane * SLOTS + k * SLOTS))
        self.cells = np.zeros(2 * k * SLOTS, np.uint32)
        self.odds_base = np.stack((lane * LEVELS * LEVELS, (lane + k) * LEVELS * LEVELS))
        self.odds = np.full(2 * k * LEVELS * LEVELS, 1 << (ODDS - 4), np.int32)
        # by the class before (one more: none yet), the classes' counts, and where their shares of 2**16 begin and how large they are
        self.class_base = lane * (CLASSES + 1)
        self.seen = np.ones(k * (CLASSES + 1) * CLASSES, np.int32)
        self.begin = np.zeros((k * (CLASSES + 1), CLASSES), np.uint32)
        self.size = np.zeros((k * (CLASSES + 1), CLASSES), np.uint32)
        self.row = self.class_base + CLASSES
        self.last = np.zeros(k, np.int64)
        self.context = np.zeros((2, k), np.int64)

    def tick(self, t: int) -> None:
        """Shares from counts, none below 64 of 2**16, when they are due."""
        if t % REFRESH == 0 or t < REFRESH and t & (t - 1) == 0:
            seen = self.seen.reshape(-1, CLASSES)
            np.multiply(seen, np.uint32((1 << TOTAL) - 64 * CLASSES), out=self.size, casting="unsafe")
            self.size //= seen.sum(axis=1, dtype=np.uint32)[:, None]
            self.size += np.uint32(64)
            np.cumsum(self.size[:, :-1], axis=1, out=self.begin[:, 1:])

    def predict(self, n: int) -> None:
        """For the first n lanes: both guesses, their shares and where each begins; below them order 0 has `rest`."""
        self.at = self.context[:, :n] + self.cell_base[:, :n]
        self.cell = self.cells.take(self.at)
        self.guess = self.cell & _LOW
        self.level = self.cell >> _U16
        self.place = self.odds_base[:, :n] + (self.level[0] * np.uint32(LEVELS) + self.level[1])
        self.weight = self.odds.take(self.place)
        self.first = self.weight[0].astype(np.uint32) << np.uint32(TOTAL - ODDS)
        self.rest = np.uint32(1 << TOTAL) - self.first
        self.second = self.rest * self.weight[1].astype(np.uint32)
        self.second >>= np.uint32(ODDS)
        self.rest -= self.second

    def update(self, n: int, x: np.ndarray, right: np.ndarray, kind: np.ndarray) -> None:
        """Learn the numbers x (int64) of the first n lanes; right: where each order's guess is x; kind: the class of each number."""
        step = _GOAL.take(right)
        step -= self.weight
        step >>= 5
        step += self.weight
        self.odds[self.place] = step
        move = self.level << np.uint32(1)
        move += right
        self.cell += _GAIN.take(move)
        np.copyto(self.cell, x, where=move == 0, casting="unsafe")
        self.cells[self.at] = self.cell
        self.seen[self.row[:n] * CLASSES + kind] += 1
        np.add(self.class_base[:n], kind, out=self.row[:n])
        two = self.last[:n] * 2531
        two += x * 17
        two &= SLOTS - 1
        self.context[0, :n] = two
        np.bitwise_and(x, SLOTS - 1, out=self.context[1, :n])
        self.last[:n] = x


def _in_order(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Lanes from long to short, and how many lanes have a number at each step."""
    order = np.argsort(-np.array(lengths), kind="stable")
    n = np.array(lengths)[order]
    return order, np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), side="left")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of numbers below MOST to its coded bytes."""
    return [x for part in _parts(blocks) for x in _encode(part)]


def decode(coded: list[bytes]) -> list[np.ndarray]:
    """Coded blocks back to their numbers (uint16); ValueError if a block is damaged."""
    return [x for part in _parts(coded) for x in _decode(part)]


def _parts(blocks: list) -> list[list]:
    """Parts of LANES blocks at most, as even as can be."""
    n = -(-len(blocks) // LANES)
    return [blocks[len(blocks) * k // n : len(blocks) * (k + 1) // n] for k in range(n)]


def _encode(blocks: list[np.ndarray]) -> list[bytes]:
    order, active = _in_order([len(b) for b in blocks])
    k, steps = len(blocks), len(active)
    ids = np.zeros((steps, k), np.uint16)
    for lane, b in enumerate(order.tolist()):
        ids[: len(blocks[b]), lane] = blocks[b]
    if ids.size and int(ids.max()) >= MOST:
        raise ValueError("a number is out of range")
    models = _Lanes(k)
    low, width = np.zeros(k, np.uint64), np.full(k, (1 << 64) - 1, np.uint64)
    words = np.zeros((k, steps + 4), np.uint32)
    flat, row = words.ravel(), np.arange(k, dtype=np.int64) * (steps + 4)
    used = row.copy()
    for t in range(steps):
        n = int(active[t])
        x = ids[t, :n].astype(np.int64)
        models.tick(t)
        models.predict(n)
        right = models.guess == x
        kind = _CLASS.take(x)
        place = models.row[:n] * CLASSES
        place += kind
        start = models.begin.take(place)
        start *= models.rest
        start >>= _U16
        part = models.size.take(place)
        part *= models.rest
        part >>= _U16
        rank = x - _FIRST.take(kind)
        deep = kind.astype(np.uint64)
        for hit, begin, share in ((right[1], models.rest, models.second), (right[0], models.rest + models.second, models.first)):
            np.copyto(start, begin, where=hit)
            np.copyto(part, share, where=hit)
        hit = right[0] | right[1]
        np.copyto(deep, 0, where=hit)
        np.copyto(rank, 0, where=hit)
        unit = width[:n] >> _U64[TOTAL]
        now = unit * start
        unit *= part
        unit >>= deep
        now += unit * rank.view(np.uint64)
        now += low[:n]
        over = now < low[:n]
        if over.any():
            for lane in np.flatnonzero(over).tolist():
                _carry(flat, int(used[lane]), int(row[lane]))
        out = np.flatnonzero(unit <= _LOW_HALF)
        some = now.take(out)
        where = used.take(out)
        flat[where] = some >> _U64[32]
        where += 1
        used[out] = where
        some <<= _U64[32]
        now[out] = some
        unit[out] = unit.take(out) << _U64[32]
        low[:n] = now
        width[:n] = unit
        models.update(n, x, right, kind)
    result: list[bytes] = [b""] * k
    used -= row
    for lane, b in enumerate(order.tolist()):
        tail = np.array([int(low[lane]) >> 32, int(low[lane]) & 0xFFFFFFFF], np.uint32)
        body = np.concatenate((words[lane, : used[lane]], tail)).astype("<u4").tobytes() if len(blocks[b]) else b""
        result[b] = HEADER.pack(MAGIC, len(blocks[b]), zlib.crc32(np.asarray(blocks[b]).astype("<u4").tobytes())) + body
    return result


_LOW_HALF = np.uint64((1 << 32) - 1)


def _carry(words: np.ndarray, used: int, first: int) -> None:
    while used > first:
        used -= 1
        words[used] = (int(words[used]) + 1) & 0xFFFFFFFF
        if words[used]:
            return


def _decode(coded: list[bytes]) -> list[np.ndarray]:
    heads = [HEADER.unpack_from(c) if len(c) >= HEADER.size else (b"", 0, 0) for c in coded]
    if any(h[0] != MAGIC for h in heads):
        raise ValueError("not a coded block")
    order, active = _in_order([h[1] for h in heads])
    k, steps = len(coded), len(active)
    longest = max((len(c) for c in coded), default=0) // 4 + 3
    words = np.zeros((k, longest), np.uint64)
    for lane, b in enumerate(order.tolist()):
        w = np.frombuffer(coded[b], "<u4", (len(coded[b]) - HEADER.size) // 4, HEADER.size)
        words[lane, : len(w)] = w
    models = _Lanes(k)
    code, width = words[:, 0] << np.uint64(32) | words[:, 1], np.full(k, (1 << 64) - 1, np.uint64)
    flat, last = words.ravel(), np.arange(1, k + 1, dtype=np.int64) * longest - 1
    used = last - (longest - 3)
    ids = np.zeros((steps, k), np.uint16)
    top = np.uint64((1 << TOTAL) - 1)
    row_of = np.arange(k, dtype=np.int64) * CLASSES
    for t in range(steps):
        n = int(active[t])
        models.tick(t)
        models.predict(n)
        unit = width[:n] >> _U64[TOTAL]
        v = code[:n] // unit
        np.minimum(v, top, out=v)
        v = v.astype(np.uint32)
        edges = models.begin.take(models.row[:n], axis=0)
        edges *= models.rest[:, None]
        edges >>= _U16
        kind = np.bitwise_count((edges <= v[:, None]).view(np.uint64))
        kind = (kind[:, 0] + kind[:, 1]).astype(np.int64)
        kind -= 1
        start = edges.ravel().take(row_of[:n] + kind)
        part = models.size.take(models.row[:n] * CLASSES + kind)
        part *= models.rest
        part >>= _U16
        deep = kind.astype(np.uint64)
        above = models.rest + models.second
        hit1, hit2 = v >= models.rest, v >= above
        np.copyto(deep, 0, where=hit1)
        for hit, begin, share in ((hit1, models.rest, models.second), (hit2, above, models.first)):
            np.copyto(start, begin, where=hit)
            np.copyto(part, share, where=hit)
        left = code[:n] - unit * start
        unit *= part
        unit >>= deep
        rank = left // unit
        left -= rank * unit
        more = np.flatnonzero(unit <= _LOW_HALF)
        where = used.take(more)
        left[more] = left.take(more) << _U64[32] | flat.take(np.minimum(where, last.take(more)))
        where += 1
        used[more] = where
        unit[more] = unit.take(more) << _U64[32]
        code[:n] = left
        width[:n] = unit
        x = rank.view(np.int64)
        x += _FIRST.take(kind)
        np.copyto(x, models.guess[1], where=hit1)
        np.copyto(x, models.guess[0], where=hit2)
        np.minimum(x, MOST - 1, out=x)
        models.update(n, x, models.guess == x, _CLASS.take(x))
        ids[t, :n] = x
    result: list[np.ndarray] = [np.zeros(0, np.uint16)] * k
    for lane, b in enumerate(order.tolist()):
        result[b] = ids[: heads[b][1], lane].copy()
        if zlib.crc32(result[b].astype("<u4").tobytes()) != heads[b][2]:
            raise ValueError("a block's checksum doesn't match")
    return result
