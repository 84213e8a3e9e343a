"""Suffixes of one shard in order, with the lengths that neighbours share, by external induced sorting.

A position is of type S if its suffix is smaller than the next one, else of type L; S* positions are those of type S behind one of
type L.  From the order of the S* suffixes that of all L suffixes follows in one ascending pass (a suffix i - 1 lies in the bucket of
its first character in the order of suffix i), and from that the order of all S suffixes in one descending pass.  The same two
passes, begun with S* positions by their first character alone, sort the substrings between S* positions; these get names, and if
names repeat, the string of names, at most half as long, is sorted the same way.

A pass takes its tuples (rank of the next suffix, position, length shared with the tuple before) from a queue with a bucket for
each character, or range of characters, in which tuples wait on disk once they exceed a bound.  Ranks are given in ascending
order, so the queue of one character yields them sorted; a range of characters is sorted when its turn comes.  The shared
lengths travel with the tuples: that of i - 1 and its neighbour is one more than the least one between their next suffixes.

In memory are a piece of tuples, the queue up to its bound, and a few numbers a character.  The text, the names and the ranks are
mapped files, as far as they are large."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import numpy as np

_SEED = np.uint64(1) << np.uint64(32)
_LAST = np.uint64((1 << 32) - 1)
_TUPLE = (np.dtype("<u4"), np.dtype("<u4"), np.dtype("u1"))  # rank, position, shared


def room(n: int, kind: type, bound: int) -> np.ndarray:
    """An array of zeros, a mapped file if it is larger than ``bound`` bytes."""
    if n * np.dtype(kind).itemsize <= bound:
        return np.zeros(n, kind)
    with tempfile.TemporaryFile() as file:  # the mapping keeps the file
        file.truncate(n * np.dtype(kind).itemsize)
        return np.memmap(file, kind, "r+", shape=(n,))


class Buckets:
    """Tuples by bucket, in the order in which they are put, on disk once all that are held take more than ``bound`` bytes."""

    def __init__(self, n: int, bound: int):
        self.pieces: list[list] = [[] for _ in range(n)]
        self.bound, self.held, self.file, self.spilled = bound, 0, None, 0

    def put(self, bucket: int, *columns: np.ndarray) -> None:
        self.pieces[bucket].append(columns)
        self.held += sum(x.nbytes for x in columns)
        if self.held > self.bound:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for pieces in self.pieces:
            held = [p for p in pieces if not isinstance(p[0], int)]
            if held:
                at, n = self.file.tell(), sum(len(p[0]) for p in held)
                for column in zip(*held):
                    for x in column:
                        self.file.write(np.ascontiguousarray(x).data)
                pieces[:] = [p for p in pieces if isinstance(p[0], int)] + [(at, n)]
                self.spilled += n
        self.held = 0

    def _read(self, at: int, n: int, low: int, high: int) -> tuple:
        out = []
        for kind in _TUPLE:
            self.file.seek(at + low * kind.itemsize)
            out.append(np.frombuffer(self.file.read((high - low) * kind.itemsize), kind))
            at += n * kind.itemsize
        return tuple(out)

    def take(self, bucket: int, most: int, backwards: bool = False) -> Iterator[tuple]:
        """The bucket's tuples in pieces of at most ``most``, those that are put meanwhile included; they go."""
        pieces, end = self.pieces[bucket], -1 if backwards else 0
        while pieces:
            if isinstance(pieces[end][0], int):
                at, n = pieces.pop(end)
                for low in range(0, n, most)[:: -1 if backwards else 1]:
                    part = self._read(at, n, low, min(n, low + most))
                    yield tuple(x[::-1] for x in part) if backwards else part
                continue
            held, n = [], 0
            while pieces and not isinstance(pieces[end][0], int) and (not held or n + len(pieces[end][0]) <= most):
                held.append(pieces.pop(end))
                n += len(held[-1][0])
            self.held -= sum(x.nbytes for p in held for x in p)
            whole = tuple(np.concatenate(x) for x in zip(*held[:: -1 if backwards else 1]))
            yield tuple(x[::-1] for x in whole) if backwards else whole

    def take_all(self, bucket: int) -> tuple:
        parts = list(self.take(bucket, 1 << 62))
        return tuple(np.concatenate(x) for x in zip(*parts)) if parts else tuple(np.empty(0, k) for k in _TUPLE)


class Alphabet:
    """Blocks of neighbouring characters that hold at most ``most`` positions together, or one character."""

    def __init__(self, text: np.ndarray, size: int, most: int):
        count = np.zeros(size, np.int64)
        for at in range(0, len(text), most):
            count += np.bincount(text[at : at + most], minlength=size)
        if size <= 256:
            self.low = np.arange(size + 1)
        else:
            upto, cuts = np.concatenate([[0], np.cumsum(count)]), [0]
            while cuts[-1] < size:
                cuts.append(max(cuts[-1] + 1, int(np.searchsorted(upto, upto[cuts[-1]] + most, side="right")) - 1))
            self.low = np.array(cuts)
        self.size, self.n = size, len(self.low) - 1
        self.of = np.repeat(np.arange(self.n, dtype=np.uint16 if self.n < 1 << 16 else np.int64), np.diff(self.low))


def _first_places(new: np.ndarray) -> np.ndarray:
    """For each place the last one up to it where something new begins."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Shared:
    """The least shared length since the last tuple that went to each bucket."""

    def __init__(self, buckets: int, cap: int):
        self.cap, self.least = cap, np.full(buckets, -1, np.int16)

    def of(self, shared: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
        """Shared lengths of new tuples: ``at`` are the rows they come from, sorted by bucket ``to``, then row."""
        new = np.ones(len(at), bool)
        new[1:] = to[1:] != to[:-1]
        least = np.empty(len(at), np.int16)
        first = np.flatnonzero(new)
        before = self.least[to[first]]
        least[first] = np.where(before < 0, -1, np.minimum(before, np.minimum.accumulate(shared)[at[first]]))
        inner = np.flatnonzero(~new)
        low, size = at[inner - 1] + 1, at[inner] - at[inner - 1]
        level, width = shared, 1
        while inner.size:  # the least of each stretch by two overlapping windows of a power of two
            now = np.flatnonzero((size >= width) & (size < 2 * width))
            least[inner[now]] = np.minimum(level[low[now]], level[low[now] + size[now] - width])
            if not (size >= 2 * width).any():
                break
            level, width = np.minimum(level[:-width], level[width:]), 2 * width
        rest = np.append(np.minimum.accumulate(shared[::-1])[::-1], self.cap)
        self.least = np.where(self.least < 0, self.least, np.minimum(self.least, rest[0]))
        if len(at):
            last = np.append(first[1:], len(at)) - 1
            self.least[to[last]] = rest[at[last] + 1]
        return np.minimum(least + 1, self.cap).astype(np.uint8)


class Sorter:
    """Sorts the suffixes of one text, of which the last character is 0 and alone.  ``cap``: shared lengths count up to it."""

    def __init__(self, cap: int, most: int = 1 << 18, bound: int = 64 << 20):
        self.cap, self.most, self.bound = cap, most, bound
        self.spilled = self.levels = 0

    # One pass, of either direction: with ``flip`` characters count from the largest.

    def _pass(self, text, alphabet: Alphabet, seeds: Callable[[int], Iterator[tuple]], flip: bool, out: Callable, shared: bool) -> None:
        """``out(block, rank, pos, shared, induced)`` gets all tuples in order; ``seeds(block)`` yields those that aren't induced."""
        queue = Buckets(alphabet.n, self.bound)
        carried = Shared(alphabet.n, self.cap) if shared else None
        base, top = 0, alphabet.size - 1
        char = (lambda at: top - text[at].astype(np.int64)) if flip else (lambda at: text[at].astype(np.int64))
        block_of = alphabet.of[::-1] if flip else alphabet.of
        block_of = (alphabet.n - 1 - block_of.astype(np.int64)).astype(alphabet.of.dtype) if flip else block_of
        last = -1

        def send(rank, pos, chars, induced, lcp, beyond: int) -> None:
            """Puts the suffixes before these where they are smaller (of the same type), in order, if they begin at ``beyond`` or above."""
            before = char(pos.astype(np.int64) - 1)
            go = np.flatnonzero((pos > 0) & (before >= np.maximum(chars + ~induced, beyond)))
            to = block_of[before[go]]
            by = np.argsort(to, kind="stable")
            go, to = go[by], to[by]
            length = carried.of(lcp, go, to) if carried else np.zeros(len(go), np.uint8)
            cut = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.empty(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(to))):
                queue.put(int(to[a]), rank[go[a:b]].astype(np.uint32), (pos[go[a:b]] - np.uint32(1)), length[a:b])

        for i in range(alphabet.n):
            b = alphabet.n - 1 - i if flip else i
            low, high = int(alphabet.low[b]), int(alphabet.low[b + 1])
            if flip:
                low, high = top + 1 - high, top + 1 - low
            if high - low == 1:
                for part, induced in ((queue.take(i, self.most), True), (seeds(b), False)):
                    before = None
                    for key, pos, lcp in part:
                        new = np.ones(len(key), bool)
                        new[1:] = key[1:] != key[:-1]
                        new[0] = before is None or key[0] != before
                        before = key[-1]
                        rank = base + np.cumsum(new) - 1
                        base = int(rank[-1]) + 1
                        if carried and not induced:
                            lcp = lcp.copy()
                            if last >= 0 and new[0]:
                                lcp[0] = self._common(np.array([last]), pos[:1].astype(np.int64))[0]
                        out(b, rank, pos, lcp, induced)
                        send(rank, pos, np.full(len(pos), low), np.full(len(pos), induced), lcp, low)
                        last = int(pos[-1])
                continue
            rank, pos, induced = self._block(queue.take_all(i), seeds(b), char, high)
            if len(pos):
                lcp = np.zeros(len(pos), np.uint8)
                out(b, base + rank, pos, lcp, induced)
                send(base + rank, pos, char(pos.astype(np.int64)), induced, lcp, high)
                base += len(pos)
        self.spilled += queue.spilled

    def _block(self, waiting: tuple, seeds: Iterator[tuple], char: Callable, high: int) -> tuple:
        """All suffixes that begin in a range of characters, in order: those that wait, the seeds, and what both lead to within
        the range, which is ranked by doubling along the way back to a waiting tuple or a seed."""
        given = [(key, pos, True) for key, pos, _ in [waiting]] + [(key, pos, False) for key, pos, _ in seeds]
        pos = np.concatenate([p for _, p, _ in given])
        induced = np.concatenate([np.full(len(p), k) for _, p, k in given])
        chars = char(pos.astype(np.int64))
        key = np.concatenate([k for k, _, _ in given]).astype(np.uint64)
        key = (chars.astype(np.uint64) << np.uint64(33)) | np.where(induced, key, key | _SEED)
        n = len(pos)
        parts, way, frontier, at = [(key, pos, induced)], [np.full(n, -1)], (pos, chars, induced), 0
        while len(frontier[0]):
            p, c, k = frontier
            before = char(p.astype(np.int64) - 1)
            go = np.flatnonzero((p > 0) & (before >= c + ~k) & (before < high))
            frontier = (p[go] - np.uint32(1), before[go], np.ones(len(go), bool))
            parts.append(((before[go].astype(np.uint64) << np.uint64(33)) | _LAST, frontier[0], frontier[2]))
            way.append(at + go)
            at += len(p)
        key, pos, induced = (np.concatenate(x) for x in zip(*parts))
        way, m = np.concatenate(way), len(key)
        order = np.argsort(key, kind="stable")
        # The rank of a suffix is the first place of those like it.
        rank = np.empty(m, np.int64)
        rank[order] = _first_places(np.append(True, key[order][1:] != key[order][:-1])[:m])
        way = np.where(way < 0, np.arange(m), way)
        places = np.flatnonzero(order >= n)  # of what the range itself led to; each step compares twice as far back
        while len(places):
            own = order[places]
            both = rank[own] * (m + 1) + rank[way[own]]
            by = np.argsort(both, kind="stable")
            order[places] = own = own[by]
            rank[own] = places[_first_places(np.append(True, both[by][1:] != both[by][:-1]))]
            if (way[own] < n).all():
                break
            way[own] = way[way[own]]
        return rank[order], pos[order], induced[order]

    # The levels.

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many characters the suffixes a and b of the text share, up to the cap."""
        differ = self.windows[a] != self.windows[b]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), self.cap).astype(np.uint8)

    def _stars(self, text) -> np.ndarray:
        """S* positions, ascending; the last character is one."""
        found, following = [np.array([len(text) - 1], np.uint32)], True  # the type of the position behind: S
        for high in range(len(text) - 1, 0, -self.most):
            low = max(0, high - self.most)
            here = np.asarray(text[low : high + 1]).astype(np.int64)
            step = np.sign(here[1:] - here[:-1])  # 1: smaller than the next character
            # Where neighbours are equal, the type is that of the next position where they aren't.
            at = np.where(step != 0, np.arange(len(step)), len(step))
            at = np.minimum.accumulate(at[::-1])[::-1]
            is_s = np.append(step > 0, following)[at]
            kinds = np.append(is_s, following)
            found.append((np.flatnonzero(kinds[1:-1] & ~kinds[:-2]) + low + 1).astype(np.uint32)[::-1])
            if high < len(text) - 1 and kinds[-1] and not kinds[-2]:
                found.append(np.array([high], np.uint32))
            following = bool(kinds[0])
        return np.sort(np.concatenate(found))

    def _by_block(self, text, alphabet: Alphabet, stars: np.ndarray, ranked: bool, shared: bool) -> Buckets:
        """S* positions, ascending, as seeds: with their place as rank, or with their character alone."""
        seeds, before = Buckets(alphabet.n, self.bound), None
        for at in range(0, len(stars), self.most):
            pos = stars[at : at + self.most]
            chars = text[pos].astype(np.int64)
            rank = np.arange(at, at + len(pos), dtype=np.uint32) if ranked else np.zeros(len(pos), np.uint32)
            lcp = np.zeros(len(pos), np.uint8)
            if shared:
                both = pos.astype(np.int64) if before is None else np.append(before, pos).astype(np.int64)
                lcp[len(pos) - len(both) + 1 :] = self._common(both[:-1], both[1:])
                before = pos[-1]
            to = alphabet.of[chars]
            by = np.argsort(to, kind="stable")
            cut = np.flatnonzero(np.append(True, to[by][1:] != to[by][:-1]))
            for a, b in zip(cut, np.append(cut[1:], len(by))):
                queue = by[a:b]
                seeds.put(int(to[queue[0]]), rank[queue], pos[queue], lcp[queue])
        return seeds

    def _induce(self, text, alphabet: Alphabet, seeds: Buckets, out: Callable, shared: bool) -> None:
        """Both passes; ``out(rank, pos, shared, induced)`` gets all suffixes but the last character's in descending order."""
        larger = Buckets(alphabet.n, self.bound)

        def keep(block, rank, pos, lcp, induced):
            kind = np.flatnonzero(induced) if isinstance(induced, np.ndarray) else slice(None) if induced else None
            if kind is not None and len(pos[kind]):
                larger.put(block, rank[kind].astype(np.uint32), np.asarray(pos[kind]), np.asarray(lcp[kind]))

        self._pass(text, alphabet, lambda b: seeds.take(b, self.most), False, keep, shared)
        self.spilled += seeds.spilled

        def back(block):
            """The block's L suffixes, descending, each with what it shares with the larger one before it."""
            next_lcp = np.zeros(1, np.uint8)
            for rank, pos, lcp in larger.take(block, self.most, backwards=True):
                yield np.uint32(_LAST) - rank, pos, np.append(next_lcp, lcp[:-1]).astype(np.uint8)
                next_lcp = lcp[-1:]

        self._pass(text, alphabet, back, True, lambda block, rank, pos, lcp, induced: out(rank, pos, lcp, induced), shared)
        self.spilled += larger.spilled

    def _named(self, text, alphabet: Alphabet, stars: np.ndarray) -> tuple[np.ndarray, int]:
        """Names of the substrings between S* positions, in the order of the text, ascending with the substrings, and their number."""
        found, top = room(len(text) // 2 + 1, np.uint32, self.bound), [0, -1]  # S* positions are two apart at least

        def out(rank, pos, lcp, induced):
            mine = np.flatnonzero(np.broadcast_to(induced, len(pos)))
            p = pos[mine].astype(np.int64)
            star = (p > 0) & (text[p - 1] > text[p])
            rank, p = rank[mine][star], p[star]
            if len(p):
                new = np.append(rank[0] != top[1], rank[1:] != rank[:-1])
                name = top[0] + np.cumsum(new)
                found[p >> 1] = name
                top[:] = int(name[-1]), int(rank[-1])

        self._induce(text, alphabet, self._by_block(text, alphabet, stars, False, False), out, False)
        names = room(len(stars), np.uint32, self.bound)
        for at in range(0, len(names), self.most):  # they came in descending order; the last character stays the smallest
            part = found[stars[at : at + self.most] >> 1]
            part[stars[at : at + self.most] == len(text) - 1] = 0
            names[at : at + self.most] = np.where(part, top[0] + 1 - part, 0)
        return names, top[0] + 1

    def _star_order(self, text, size: int, level: int) -> tuple[Alphabet, np.ndarray]:
        """The alphabet and the S* positions in the order of their suffixes.  A name of level k stands for 2**k characters of the
        text or more; once these are more than the cap, equal names need no further order."""
        self.levels = max(self.levels, level + 1)
        alphabet, stars = Alphabet(text, size, self.most), self._stars(text)
        if len(stars) == 1:
            return alphabet, stars
        names, n = self._named(text, alphabet, stars)
        if n == len(names) or 2 << level > self.cap:
            return alphabet, stars[np.argsort(names, kind="stable")]
        return alphabet, stars[self._order(names, n, level + 1)]

    def _order(self, text, size: int, level: int) -> np.ndarray:
        """All positions in the order of their suffixes."""
        alphabet, stars = self._star_order(text, size, level)
        order, done = room(len(text), np.uint32, self.bound), [len(text)]

        def out(rank, pos, lcp, induced):
            order[done[0] - len(pos) : done[0]] = pos[::-1]
            done[0] -= len(pos)

        self._induce(text, alphabet, self._by_block(text, alphabet, stars, True, False), out, False)
        order[0] = len(text) - 1
        return order

    def descending(self, text, size: int, out: Callable) -> None:
        """``out(pos, shared)`` gets all suffixes of ``text`` but the last character's in descending order, in pieces, each with the
        number of characters that it shares with the one before, up to the cap.  ``text`` is followed by as many zeros as the cap."""
        self.windows = np.lib.stride_tricks.sliding_window_view(text, self.cap)
        text = text[: len(text) - self.cap]
        alphabet, stars = self._star_order(text, size, 0)
        self._induce(text, alphabet, self._by_block(text, alphabet, stars, True, True), lambda rank, pos, lcp, induced: out(pos, lcp), True)
