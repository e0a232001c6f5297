"""External induced suffix sorting with common-prefix lengths.

Suffixes of a text are sorted as in induced sorting: a suffix is S-type if it is less than the next one, else L-type, and
S* if S-type after an L-type. Sorted S* suffixes induce the L-type ones in ascending order of first symbols, these the
S-type ones in descending order. Suffix tuples (position, length of the common prefix with the tuple before) wait in
priority queues keyed by first symbol and order of arrival. A tuple's common prefix is one more than the least one among
the tuples scanned between the two that induced it and its predecessor.

S* suffixes are sorted by recursion: their substrings are sorted by the same induction and named, and the suffixes of the
string of names are sorted in the same way again, until the names fit in memory and are sorted there by doubling ranks. The
names that two neighbours share give the start of their common prefix, symbols the rest; nothing is hashed.

Bytes have a queue each and are scanned a bucket at a time. Names are too many for that: their tuples wait by ranges of names
and are put in order a range at a time, one by one.

Texts, types, names and sorted S* suffixes are arrays in a ``Scratch``, tuples in queues and runs are its blocks: both are
kept in memory up to its limit and in unnamed files of the task beyond.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections import defaultdict
from collections.abc import Iterator

import numpy as np

#: Bytes that a sort keeps in memory, besides the blocks at work.
MEMORY = 64 << 20
#: Symbols up to which each has a queue of its own.
NARROW = 1024
_NEVER = np.iinfo(np.int32).max


class Scratch:
    """Arrays and blocks of tuples, in memory up to a limit, then in unnamed files in ``folder``, which go with the process.

    A task that is run again sorts again; no other task reads these files.
    """

    def __init__(self, memory: int = MEMORY, folder: str | None = None):
        self.memory, self.folder = memory, folder if folder and os.path.isdir(folder) else None
        self.held, self.end, self.file, self.spilled = 0, 0, None, 0
        self.chunk = max(256, min(1 << 18, memory // 256))

    def array(self, n: int, kind) -> np.ndarray:
        """Zeros; ``release`` it when it is done with."""
        size = n * np.dtype(kind).itemsize
        if self.held + size <= self.memory or not size:
            self.held += size
            return np.zeros(n, kind)
        self.spilled += size
        with tempfile.TemporaryFile(dir=self.folder) as file:
            file.truncate(size)
            return np.memmap(file, kind, "r+", shape=(n,))

    def release(self, *arrays: np.ndarray) -> None:
        self.held -= sum(x.nbytes for x in arrays if not isinstance(x, np.memmap))

    def put(self, *columns: np.ndarray) -> tuple:
        size = sum(x.nbytes for x in columns)
        if self.held + size <= self.memory:
            self.held += size
            return columns
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder)
        self.file.seek(self.end)
        for x in columns:
            self.file.write(x.tobytes())
        self.end += size
        self.spilled += size
        return self.end - size, len(columns[0]), [x.dtype for x in columns]

    def take(self, block: tuple) -> tuple[np.ndarray, ...]:
        """A block's columns; it is gone afterwards."""
        if isinstance(block[0], np.ndarray):
            self.held -= sum(x.nbytes for x in block)
            return block
        at, n, kinds = block
        self.file.seek(at)
        return tuple(np.frombuffer(self.file.read(n * k.itemsize), k) for k in kinds)

    def take_all(self, blocks: list[tuple], backwards: bool = False) -> Iterator[tuple[np.ndarray, ...]]:
        """The columns of a list of blocks, small ones joined; the list is used up. Backwards, rows are in reversed order."""
        blocks.reverse()
        while blocks:
            got = [self.take(blocks.pop(0 if backwards else -1))]
            while blocks and sum(len(x[0]) for x in got) < self.chunk:
                got.append(self.take(blocks.pop(0 if backwards else -1)))
            if backwards:
                yield tuple(np.concatenate([x[k][::-1] for x in got]) for k in range(len(got[0])))
            else:
                yield got[0] if len(got) == 1 else tuple(np.concatenate([x[k] for x in got]) for k in range(len(got[0])))

    def close(self) -> None:
        if self.file:
            self.file.close()


class _Induction:
    """One scan: feeds tuples in scan order and pushes what they induce to the queues."""

    def __init__(self, sorter: Sorter, s_type: bool, with_prefixes: bool):
        self.sorter, self.s_type, self.with_prefixes = sorter, s_type, with_prefixes
        self.queues: dict[int, list[tuple]] = defaultdict(list)
        if with_prefixes:
            self.least = np.full(sorter.symbols, _NEVER, np.int32)  # since the last push, by symbol
            self.fresh = np.ones(sorter.symbols, bool)

    def pop(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What waits for a symbol and what is pushed meanwhile, in order of arrival."""
        while symbol in self.queues:
            yield from self.sorter.scratch.take_all(self.queues.pop(symbol))

    def feed(self, positions: np.ndarray, prefixes: np.ndarray) -> None:
        sorter = self.sorter
        before = positions - 1
        ok = before >= 0
        ok[ok] = sorter.s_type[before[ok]] == self.s_type
        if self.with_prefixes and not ok.any():
            self.least = np.minimum(self.least, prefixes.min())
            return
        symbol = np.full(len(positions), -1, np.int64)
        symbol[ok] = sorter.text[before[ok]]
        order = np.argsort(symbol, kind="stable")
        found, starts = np.unique(symbol[order], return_index=True)
        stops = np.append(starts[1:], len(order))
        for d, a, b in zip(found.tolist(), starts.tolist(), stops.tolist(), strict=True):
            if d < 0:
                continue
            at = order[a:b]
            made = np.zeros(len(at), np.int16)
            if self.with_prefixes:
                # least common prefix in (previous one, this one] of the scan
                cuts = np.empty(len(at), np.int64)
                cuts[0] = 0
                cuts[1:] = at[:-1] + 1
                low = np.minimum.reduceat(prefixes[: at[-1] + 1], cuts).astype(np.int32)
                low[0] = min(low[0], self.least[d])
                made = np.minimum(low + 1, sorter.depth).astype(np.int16)
                if self.fresh[d]:
                    made[0], self.fresh[d] = 0, False
                tail = prefixes[at[-1] + 1 :]
                self.least[d] = tail.min() if len(tail) else _NEVER
            self.queues[d].append(sorter.scratch.put(before[at], made))
        if self.with_prefixes:
            rest = np.ones(len(self.least), bool)
            rest[found[found >= 0]] = False
            self.least[rest] = np.minimum(self.least[rest], prefixes.min())


class _NameQueue:
    """Positions by symbol, least first or greatest first, then by order of arrival; symbols of other ranges than the one at work wait in blocks."""

    def __init__(self, scratch: Scratch, symbols: int, sign: int):
        self.scratch, self.sign, self.shift = scratch, sign, max(0, symbols.bit_length() - 10)
        self.buffers: dict[int, list[int]] = {}
        self.blocks: dict[int, list[tuple]] = {}
        self.now, self.heap, self.lists = -1, [], {}

    def push(self, symbol: int, position: int) -> None:
        r = symbol >> self.shift
        if r != self.now:
            buffer = self.buffers.setdefault(r, [])
            buffer += (symbol, position)
            if len(buffer) >= 512:
                self.blocks.setdefault(r, []).append(self.scratch.put(np.array(self.buffers.pop(r), np.int64)))
        elif symbol in self.lists:
            self.lists[symbol].append(position)
        else:
            self.lists[symbol] = [position]
            heapq.heappush(self.heap, self.sign * symbol)

    def first(self, other: int | None) -> int | None:
        """The next symbol, if there is one in a range no later than that of the other symbol, from which tuples may still come."""
        while not self.heap:
            waiting = self.blocks.keys() | self.buffers.keys()
            if not waiting:
                return None
            following = min(waiting) if self.sign > 0 else max(waiting)
            if other is not None and self.sign * following > self.sign * (other >> self.shift):
                return None
            self.now = following
            for (block,) in self.scratch.take_all(self.blocks.pop(self.now, [])):
                for symbol, position in block.reshape(-1, 2).tolist():
                    self.push(symbol, position)
            buffer = self.buffers.pop(self.now, [])
            for symbol, position in zip(buffer[::2], buffer[1::2], strict=True):
                self.push(symbol, position)
        return self.sign * self.heap[0]

    def pop(self) -> list[int]:
        return self.lists.pop(self.sign * heapq.heappop(self.heap))


class Sorter:
    """Suffixes of a text of symbols 0 (last, nowhere else) and up, to a depth of ``depth`` symbols, 32767 at most.

    n is the length of the text; the array has eight bytes more.
    """

    def __init__(self, text: np.ndarray, n: int, depth: int, scratch: Scratch):
        self.text, self.n, self.depth, self.scratch = text, n, depth, scratch
        self.per = 8 // text.itemsize
        self.words = np.ndarray((n + 1,), "<u8", text, 0, (text.itemsize,))
        self.symbols = 1 + max(int(text[a : a + scratch.chunk].max()) for a in range(0, n, scratch.chunk))
        self.s_type = scratch.array(n, bool)
        stars, after, is_s = 0, 0, True
        for a in reversed(range(0, n, scratch.chunk)):
            part = text[a : min(n, a + scratch.chunk)].astype(np.int64)
            step = np.sign(np.append(part[1:], after) - part)
            if a + len(part) == n:
                step[-1] = 1
            at = np.minimum.accumulate(np.where(step != 0, np.arange(len(part)), len(part))[::-1])[::-1]
            self.s_type[a : a + len(part)] = np.append(step > 0, is_s)[at]
            after, is_s = part[0], self.s_type[a]
        star = self._stars()
        self.star = scratch.array(sum(map(len, star)), np.int64)
        for part in self._stars():
            self.star[stars : stars + len(part)] = part
            stars += len(part)

    def _stars(self) -> Iterator[np.ndarray]:
        for a in range(1, self.n, self.scratch.chunk):
            b = min(self.n, a + self.scratch.chunk)
            yield np.flatnonzero(self.s_type[a:b] & ~self.s_type[a - 1 : b - 1]) + a

    def _chunks(self, n: int) -> Iterator[slice]:
        return (slice(a, min(n, a + self.scratch.chunk)) for a in range(0, n, self.scratch.chunk))

    def common(self, a: np.ndarray, b: np.ndarray, known: np.ndarray | int = 0) -> np.ndarray:
        """Common prefix lengths of pairs of different suffixes, up to depth; ``known`` symbols are known to agree."""
        out = np.minimum(np.zeros(len(a), np.int64) + known, self.depth)
        left = np.flatnonzero(out < self.depth)
        bits = 8 * self.text.itemsize
        while len(left):
            x = self.words[a[left] + out[left]] ^ self.words[b[left] + out[left]]
            same = x == 0
            first = np.log2((x & (~x + np.uint64(1))).astype(np.float64), out=np.zeros(len(x)), where=~same).astype(np.int64) // bits
            out[left] += np.where(same, self.per, first)
            left = left[same & (out[left] < self.depth)]
        return np.minimum(out, self.depth).astype(np.int16)

    def _equal(self, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether text[a:a + length] is text[b:b + length]."""
        out = np.ones(len(a), bool)
        done, left = 0, np.arange(len(a))
        while len(left):
            x = self.words[a[left] + done] ^ self.words[b[left] + done]
            rest = np.minimum(length[left] - done, self.per).astype(np.uint64)
            differ = x << (np.uint64(64) - rest * np.uint64(8 * self.text.itemsize)) != 0
            out[left[differ]] = False
            done += self.per
            left = left[~differ & (length[left] > done)]
        return out

    def _ascend(self, star: np.ndarray, prefixes: np.ndarray | None) -> dict[int, list[tuple]]:
        """L-type suffixes by first symbol; star has S* suffixes in order, or just by first symbols and without prefixes."""
        with_prefixes = prefixes is not None
        scan = _Induction(self, False, with_prefixes)
        out: dict[int, list[tuple]] = defaultdict(list)
        at = 0
        for c in range(self.symbols):
            last = None
            for positions, own in scan.pop(c):
                scan.feed(positions, own)
                out[c].append(self.scratch.put(positions, own))
                last = positions[-1:]
            while at < len(star) and self.text[star[at]] == c:
                mine = star[at : at + self.scratch.chunk]
                mine = np.array(mine[: np.searchsorted(self.text[mine], c, "right")])
                own = np.array(prefixes[at : at + len(mine)]) if with_prefixes else np.zeros(len(mine), np.int16)
                if with_prefixes and (last is not None or not at or self.text[star[at - 1]] != c):
                    own[0] = self.common(last, mine[:1])[0] if last is not None else 0
                last, at = None, at + len(mine)
                scan.feed(mine, own)
        return out

    def _descend(self, ascending: dict[int, list[tuple]], with_prefixes: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes but the sentinel in descending order: positions, common prefixes with the one before."""
        scan = _Induction(self, True, with_prefixes)
        for c in range(self.symbols - 1, 0, -1):
            last = None
            for positions, own in scan.pop(c):
                scan.feed(positions, own)
                yield positions, own
                last = positions[-1:]
            kept = None  # the common prefix of the last one with what comes next
            for positions, own in self.scratch.take_all(ascending.pop(c, []), backwards=True):
                if kept is None:
                    kept = self.common(last, positions[:1])[0] if with_prefixes and last is not None else 0
                turned = np.append(np.int16(kept), own[:-1])
                kept = own[-1]
                scan.feed(positions, turned)
                yield positions, turned

    def _scan_names(self, star: np.ndarray) -> Iterator[np.ndarray]:
        """All suffixes but the sentinel in descending order, as ``_descend`` gives them after ``_ascend``, for many symbols and without prefixes."""
        text, s_type, scratch = self.text, self.s_type, self.scratch
        runs: list[tuple] = []
        queue, out, at = _NameQueue(scratch, self.symbols, 1), [], 0
        while True:
            s = int(text[star[at]]) if at < len(star) else None
            c = queue.first(s)
            if c is not None and (s is None or c <= s):
                found = queue.pop()
                out += found
                if len(out) >= scratch.chunk:
                    runs.append(scratch.put(np.array(out, np.int64)))
                    out = []
            elif s is not None:
                found, at = [int(star[at])], at + 1
            else:
                break
            for p in found:
                if p and not s_type[p - 1]:
                    queue.push(int(text[p - 1]), p - 1)
        runs.append(scratch.put(np.array(out, np.int64)))

        def backwards() -> Iterator[int]:
            for (block,) in scratch.take_all(runs, backwards=True):
                yield from block.tolist()

        queue, out, ascending = _NameQueue(scratch, self.symbols, -1), [], backwards()
        up = next(ascending, None)
        while True:
            s = None if up is None else int(text[up])
            c = queue.first(s)
            if c is not None and (s is None or c >= s):
                found = queue.pop()
            elif up is not None:
                found, up = [up], next(ascending, None)
            else:
                break
            out += found
            if len(out) >= scratch.chunk:
                yield np.array(out, np.int64)
                out = []
            for p in found:
                if p and s_type[p - 1]:
                    queue.push(int(text[p - 1]), p - 1)
        yield np.array(out, np.int64)

    def _suffixes(self, star: np.ndarray) -> Iterator[np.ndarray]:
        """All suffixes but the sentinel in descending order, from S* suffixes in order or by first symbols."""
        if self.symbols > NARROW:
            yield from self._scan_names(star)
        else:
            for positions, _ in self._descend(self._ascend(star, None), False):
                yield positions

    def _by_first_symbol(self) -> np.ndarray:
        cursor = self.scratch.array(self.symbols + 1, np.int64)
        for part in self._chunks(len(self.star)):
            np.add.at(cursor, self.text[self.star[part]].astype(np.int64) + 1, 1)
        np.cumsum(cursor, out=cursor)
        out = self.scratch.array(len(self.star), np.int64)
        for part in self._chunks(len(self.star)):
            star = self.star[part]
            symbol = self.text[star].astype(np.int64)
            order = np.argsort(symbol, kind="stable")
            found, starts, n = np.unique(symbol[order], return_index=True, return_counts=True)
            out[cursor[symbol[order]] + np.arange(len(order)) - np.repeat(starts, n)] = star[order]
            cursor[found] += n
        self.scratch.release(cursor)
        return out

    def _names(self) -> tuple[np.ndarray, int]:
        """The rank of each S* substring, in the text's order, and the number of different ones; the sentinel has rank 0."""
        unsorted, scratch, m = self._by_first_symbol(), self.scratch, len(self.star)
        names = scratch.array(m + 2, np.int32)  # two more for reading eight bytes at the end
        below, before = 0, None
        for positions in self._suffixes(unsorted):
            first = (positions > 0) & self.s_type[positions] & ~self.s_type[positions - 1]
            positions = positions[first]
            if not len(positions):
                continue
            nth = np.searchsorted(self.star, positions)
            length = self.star[np.minimum(nth + 1, m - 1)] - positions + 1
            if before is None:
                before = positions[:1], length[:1]
            greater, long = np.append(before[0], positions[:-1]), np.append(before[1], length[:-1])
            same = long == length
            same[same] = self._equal(positions[same], greater[same], length[same])
            rank = below + np.cumsum(~same)
            names[nth] = rank  # from the greatest down, turned round below
            below, before = int(rank[-1]), (positions[-1:], length[-1:])
        for part in self._chunks(m - 1):
            names[part] = below + 1 - names[part]
        names[m - 1 :] = 0
        scratch.release(unsorted)
        return names, below + 2

    def _doubled(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes of the string of names in order, to depth, and the names that each shares with the one before: in memory."""
        rank, ranks, step = names.astype(np.int64), [], 1
        while True:
            ranks.append(rank.astype(np.int32))
            if rank.max() == len(rank) - 1 or step > self.depth:  # a name covers a symbol of its own at least
                break
            key = rank << 32
            key[: len(rank) - step] += rank[step:] + 1
            by = np.argsort(key, kind="stable")
            new = np.ones(len(by), bool)
            new[1:] = key[by[1:]] != key[by[:-1]]
            rank = np.empty(len(by), np.int64)
            rank[by] = np.cumsum(new) - 1
            step *= 2
        order = np.argsort(rank, kind="stable")
        x, y, shared = order[:-1].copy(), order[1:].copy(), np.zeros(len(order), np.int64)
        for k in reversed(range(len(ranks))):
            same = np.flatnonzero(ranks[k][x] == ranks[k][y])
            same = same[np.maximum(x[same], y[same]) + (1 << k) < len(rank)]
            shared[same + 1] += 1 << k
            x[same] += 1 << k
            y[same] += 1 << k
        return order, shared

    def _sorted_star(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of S* suffixes in order, to depth, and the names that each shares with the one before, to depth."""
        names, kinds = self._names()
        scratch, m = self.scratch, len(self.star)
        order, shared = scratch.array(m, np.int64), scratch.array(m, np.int64)
        if kinds == m:
            for part in self._chunks(m):
                order[names[part]] = np.arange(part.start, part.stop)
        elif m * 64 <= max(scratch.memory, 64 * 256):
            order[:], shared[:] = self._doubled(np.array(names[:m]))
        else:
            inner, at = Sorter(names, m, self.depth, scratch), m
            known = inner._sorted_star()
            scratch.release(known[1])
            for positions in inner._suffixes(inner._placed(known[0])):
                order[at - len(positions) : at] = positions[::-1]
                at -= len(positions)
            order[0] = m - 1
            for part in self._chunks(m - 1):
                shared[part.start + 1 : part.stop + 1] = inner.common(np.array(order[part]), np.array(order[part.start + 1 : part.stop + 1]))
            scratch.release(known[0], inner.s_type, inner.star)
        scratch.release(names)
        return order, shared

    def _placed(self, order: np.ndarray) -> np.ndarray:
        """Numbers of S* suffixes to positions, in place."""
        for part in self._chunks(len(order)):
            order[part] = self.star[order[part]]
        return order

    def descending(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes but the sentinel in descending order, to depth, in chunks: positions and common prefixes with the one before.

        For texts of up to NARROW symbols.
        """
        order, shared = self._sorted_star()
        m = len(order)
        prefixes = self.scratch.array(m, np.int16)
        for part in self._chunks(m - 1):
            one, two = np.array(order[part]), np.array(order[part.start + 1 : part.stop + 1])
            known = self.star[np.minimum(two + shared[part.start + 1 : part.stop + 1], m - 1)] - self.star[two]
            prefixes[part.start + 1 : part.stop + 1] = self.common(self.star[one], self.star[two], known)
        self.scratch.release(shared)
        yield from self._descend(self._ascend(self._placed(order), prefixes), True)
        self.scratch.release(order, prefixes)


def repeated(segments: list[bytes], width: int, memory: int = MEMORY, folder: str | None = None) -> list[np.ndarray]:
    """For each segment, whether the ``width`` bytes from each position occur in another place of any segment too."""
    scratch = Scratch(memory, folder)
    sizes = np.array([len(s) for s in segments], np.int64)
    ends = np.cumsum(sizes + 1)
    n = int(ends[-1]) + 1 if len(ends) else 1
    text = scratch.array(n + 4, np.int16)  # 0 at the end, 1 between segments, then bytes
    for s, end in zip(segments, ends.tolist(), strict=True):
        text[end - 1 - len(s) : end - 1] = np.frombuffer(s, np.uint8)
        text[end - 1 - len(s) : end - 1] += 2
        text[end - 1] = 1
    found = scratch.array(n + width, bool)
    if len(segments):
        last = np.zeros(1, np.int64)
        for positions, prefixes in Sorter(text, n, width, scratch).descending():
            long = prefixes >= width
            found[positions[long]] = True
            found[np.append(last, positions[:-1])[long]] = True
            last = positions[-1:]
    out = []
    for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
        own = np.array(found[end - 1 - size : end - 1])
        own[max(0, size - width + 1) :] = False
        out.append(own)
    scratch.close()
    return out
