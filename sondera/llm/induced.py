"""External suffix sorting by induction with common-prefix values, for one shard of bytes.

The sort is induced sorting. Suffixes are of type L or S by comparison with their right neighbour, and
the leftmost S-suffixes (S*) come first: an induction from unsorted S* places orders the substrings
between them, these get names, and the string of names, half as long at most, is sorted by the same
procedure (recursion) unless all names differ. A second induction from the ordered S* places gives
all L-suffixes, and one from those, backwards, all S-suffixes.

An induction is driven by a priority queue of suffix tuples (symbol, position, length of the leading
run of the symbol, common prefix with the tuple before it under the symbol). A tuple that is popped
makes the one for the position before it, if that is of the type wanted. Tuples are made in the order
of their sources, and their priorities (symbol, arrival) never fall below what was popped last; so the
queue is a radix queue: ranges of symbols, each a list in order of arrival, which goes to disk
when more than HELD tuples are in memory. Only the range that is popped is put in order.

Common prefixes are carried along: two tuples of one symbol share one symbol more than the least
common prefix between their sources, in the order of the sources; a short stack of suffix minima
answers for sources that lie far apart. Prefix values of S* suffixes come from the recursion: the
lengths of the substrings whose names they share, and what the first differing ones share.

Arrays as long as the shard are memory-mapped files where it has more than IN_MEMORY symbols, read in
blocks, and looked up in order of position; so a shard may be far larger than memory. Files are in
the task's own folder: a task that is lost starts its shard again.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

#: Tuples that a queue keeps in memory; tuples or symbols of a block; symbols of a shard in memory.
HELD, BLOCK, IN_MEMORY = 1 << 20, 1 << 17, 1 << 22
#: Ranges of many symbols: this times the root of the number of suffixes.
RANGES = 0.5
SEPARATOR = 0
TUPLE = np.dtype([("symbol", np.int64), ("at", np.int64), ("run", np.int32), ("lcp", np.int32)])
_RAW = np.dtype((np.void, TUPLE.itemsize))


class Room:
    """Arrays in memory while they are small, else in files of a folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def array(self, n: int, dtype) -> np.ndarray:
        if n <= IN_MEMORY:
            return np.zeros(n, dtype)
        fd, path = tempfile.mkstemp(dir=self.folder)
        os.close(fd)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps the file until it is let go
        return out


class Column:
    """An array that is written from its start."""

    def __init__(self, room: Room, n: int, dtype):
        self.values, self.n = room.array(n, dtype), 0

    def append(self, x: np.ndarray) -> None:
        self.values[self.n : self.n + len(x)] = x
        self.n += len(x)


def take(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """text[at]; where the text is a file, in order of position."""
    if not isinstance(text, np.memmap):
        return text[at]
    order = np.argsort(at)
    out = np.empty(len(at), text.dtype)
    out[order] = text[at[order]]
    return out


def joined(parts: list[np.ndarray]) -> np.ndarray:
    """Tuples one after another (as plain bytes: numpy looks at every field of every part else)."""
    if len(parts) == 1:
        return parts[0]
    return np.concatenate([p.view(_RAW) for p in parts]).view(TUPLE) if parts else np.empty(0, TUPLE)


class TupleQueue:
    """Radix priority queue of suffix tuples over ranges of symbols [edges[r], edges[r + 1]).

    Two levels: FAN ranges make a band. What comes in for a later band waits there undivided; when
    the first of its ranges is popped the band is dealt to its ranges."""

    FAN = 32

    def __init__(self, folder: str, edges: np.ndarray):
        self.folder, self.edges, self.bands = folder, edges, edges[:: self.FAN]
        self.open = -1
        self.parts: dict[tuple[str, int], list[np.ndarray]] = {}
        self.files: dict[tuple[str, int], int] = {}
        self.size = 0

    def _path(self, key: tuple[str, int]) -> str:
        return os.path.join(self.folder, f"queue-{id(self)}-{key[0]}-{key[1]}")

    def _deal(self, tuples: np.ndarray, edges: np.ndarray, kind: str) -> None:
        at = np.searchsorted(edges, tuples["symbol"], side="right") - 1
        order = np.argsort(at, kind="stable")
        at, tuples = at[order], tuples[order]
        cut = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), len(at)]
        for i, j, k in zip(cut, cut[1:], at[cut[:-1]].tolist()):
            self.parts.setdefault((kind, k), []).append(tuples[i:j])
        self.size += len(tuples)

    def push(self, tuples: np.ndarray) -> None:
        if not len(tuples):
            return
        # no symbol lies below the band that is open
        edge = (self.open + 1) * self.FAN
        near = tuples["symbol"] < self.edges[edge] if edge < len(self.edges) else None
        if near is None or near.all():
            self._deal(tuples, self.edges, "range")
        else:
            if near.any():
                self._deal(tuples[near], self.edges, "range")
                tuples = tuples[~near]
            self._deal(tuples, self.bands, "band")
        if self.size > HELD:
            for k, parts in self.parts.items():
                with open(self._path(k), "ab") as f:
                    for p in parts:
                        p.tofile(f)
                self.files[k] = self.files.get(k, 0) + sum(map(len, parts))
            self.parts, self.size = {}, 0

    def _all(self, key: tuple[str, int]) -> list[np.ndarray]:
        out = []
        if key in self.files:
            n = self.files.pop(key)
            whole = np.memmap(self._path(key), TUPLE, "r", shape=(n,))
            out = [whole[i : i + BLOCK] for i in range(0, n, BLOCK)]
            os.unlink(self._path(key))
        parts = self.parts.pop(key, [])
        if parts:
            total = joined(parts)
            self.size -= len(total)
            out += [total[i : i + BLOCK] for i in range(0, len(total), BLOCK)]
        return out

    def pop(self, r: int) -> list[np.ndarray]:
        """What has come into a range so far, in order of arrival, in blocks."""
        if r // self.FAN > self.open:
            self.open = r // self.FAN
            for b in self._all(("band", self.open)):
                self.push(b)
        return self._all(("range", r))


class Minima:
    """Least value of a stream since any moment: a stack of suffix minima."""

    def __init__(self):
        self.at, self.value, self.now = np.empty(0, np.int64), np.empty(0, np.int32), 0

    def since(self, moments: np.ndarray) -> np.ndarray:
        """Least value after each moment (a number of values seen by then, less than now)."""
        return self.value[np.searchsorted(self.at, moments, side="left")]

    def add(self, values: np.ndarray) -> None:
        tail = np.minimum.accumulate(values[::-1])[::-1]
        # the last place of each suffix minimum
        last = np.flatnonzero(np.r_[tail[1:] > tail[:-1], True])
        keep = self.value < tail[0]
        self.at = np.concatenate([self.at[keep], self.now + last])
        self.value = np.concatenate([self.value[keep], tail[last]])
        self.now += len(values)


def _range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least of values[lo:hi] for each pair, lo < hi: range by range where all of them are short
    in sum, else by doubling."""
    if not len(lo):
        return np.empty(0, values.dtype)
    width = hi - lo
    if int(width.sum()) <= 8 * len(values) + 64:
        ends = np.empty(2 * len(lo), np.int64)
        ends[::2], ends[1::2] = lo, hi
        # the end of a range may be the end of the values, which reduceat does not take for a place
        return np.minimum.reduceat(np.append(values, values[-1:]), ends)[::2]
    k = np.frexp(width.astype(np.float64))[1] - 1
    levels = np.empty((int(k.max()) + 1, len(values)), values.dtype)
    levels[0] = values
    for i in range(1, len(levels)):
        half = 1 << i - 1
        levels[i] = levels[i - 1]
        np.minimum(levels[i - 1, :-half], levels[i - 1, half:], out=levels[i, :-half])
    return np.minimum(levels[k, lo], levels[k, hi - (1 << k)])


class _Induction:
    """One pass: tuples of one type (S: s_type) from the queue, and seeds of the other type, symbol by
    symbol; upwards for L, downwards (sign -1) for S. With `lcp`, prefix values are carried."""

    def __init__(self, text, s_type, want_s: bool, edges: np.ndarray, seeds, room: Room, lcp: bool, size: int):
        self.text, self.s_type, self.want, self.sign, self.lcp = text, s_type, want_s, -1 if want_s else 1, lcp
        # downwards a range [a, z) of symbols is the range [1 - z, 1 - a) of their negatives
        self.edges = edges if not want_s else np.sort(1 - np.r_[edges[1:], size])
        self.top = size if not want_s else 1 - int(edges[0])
        self.queue = TupleQueue(room.folder, self.edges)
        # seeds(symbol range) -> blocks of tuples in order (symbols with their sign)
        self.seeds = seeds
        self.minima, self.seen = Minima(), room.array(size + 2, np.int64)
        self.out_at, self.out_run, self.out_lcp = (Column(room, len(text), d) for d in (np.int64, np.int32, np.int32))

    def before(self, tuples: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which tuples make one for the position before theirs; these positions; their symbols."""
        at = tuples["at"]
        some = np.flatnonzero(at > 0)
        p = at[some] - 1
        right = take(self.s_type, p) == self.want
        p = p[right]
        return some[right], p, take(self.text, p).astype(np.int64)

    def sources(self, tuples: np.ndarray, made: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        """The tuples that some popped ones make."""
        some, p, symbol = made or self.before(tuples)
        if self.lcp:
            stream = tuples["lcp"]
        new = np.empty(len(p), TUPLE)
        new["symbol"], new["at"] = symbol * self.sign, p
        new["run"] = np.where(new["symbol"] == tuples["symbol"][some], tuples["run"][some] + 1, 1)
        new["lcp"] = 0
        if self.lcp:
            if len(some):
                order = np.argsort(symbol, kind="stable")
                s, i = symbol[order], some[order]
                first = np.concatenate(([True], s[1:] != s[:-1]))
                # between two of one symbol in this block; for the first one, since the last before it
                lo = np.empty(len(i), np.int64)
                lo[1:] = i[:-1] + 1
                lo[first] = 0
                least = _range_minima(stream, lo, i + 1)
                head = np.flatnonzero(first)
                before = self.seen[s[head]]
                known = before > 0
                far = np.zeros(len(head), np.int32)
                apart = known & (before < self.minima.now)
                far[known] = np.iinfo(np.int32).max
                far[apart] = self.minima.since(before[apart])
                least[head] = np.where(known, np.minimum(least[head], far), -1)
                got = np.empty(len(i), np.int32)
                got[order] = least + 1
                new["lcp"] = got
                tail = np.append(head[1:], len(s)) - 1
                self.seen[s[tail]] = self.minima.now + i[tail] + 1
            if len(stream):
                self.minima.add(stream)
        return new

    def emit(self, tuples: np.ndarray) -> None:
        self.out_at.append(tuples["at"])
        self.out_run.append(tuples["run"])
        self.out_lcp.append(tuples["lcp"])

    def _one_symbol(self, r: int, symbol: int, blocks: list[np.ndarray]) -> None:
        """All of one symbol: what the queue has, then what that makes of the same symbol, then seeds."""
        last_run, own = None, []
        for b in blocks:
            self.emit(b)
            last_run = int(b["run"][-1])
            new = self.sources(b)
            mine = new["symbol"] == symbol
            if mine.any():
                own.append(new[mine])
                new = new[~mine]
            self.queue.push(new)
        for b in self._chains(symbol, joined(own)):
            self.emit(b)
            last_run = int(b["run"][-1])
            some, p, made = self.before(b)
            other = made * self.sign != symbol
            self.queue.push(self.sources(b, (some[other], p[other], made[other])))
        for b in self.seeds(symbol, symbol + 1):
            if last_run is not None:
                b = b.copy()
                b["lcp"][0] = min(last_run, int(b["run"][0]))
                last_run = None
            self.queue.push(self.sources(b))

    def _chains(self, symbol: int, first: np.ndarray):
        """A symbol's tuples that tuples of the same symbol make, and those that these make in turn,
        generation by generation: each is a step further back in its run, in the same order. Two of a
        generation share as much as their first ancestors, and a symbol for each generation; the first
        one shares the whole run with the last one of the generation before."""
        live, age = np.arange(len(first)), 0
        base, out, held = np.ascontiguousarray(first["lcp"]), [], 0
        while len(live):
            step = first[live]
            if age:
                step["at"] -= age
                step["run"] += age
                step["lcp"][0] = step["run"][0] - 1
                if len(live) > 1:
                    step["lcp"][1:] = _range_minima(base, live[:-1] + 1, live[1:] + 1) + age
            out.append(step)
            held += len(step)
            if held > BLOCK:
                yield joined(out)
                out, held = [], 0
            age += 1
            p = first["at"][live] - age
            live = live[p >= 0]
            live = live[take(self.text, first["at"][live] - age).astype(np.int64) * self.sign == symbol]
        if out:
            yield joined(out)

    def run(self) -> None:
        ends = [*self.edges[1:].tolist(), self.top]
        for r, (lo, hi) in enumerate(zip(self.edges.tolist(), ends)):
            blocks = self.queue.pop(r)
            if hi == lo + 1:
                self._one_symbol(r, lo, blocks)
                continue
            held = joined(blocks)
            held = held[np.argsort(held["symbol"], kind="stable")]
            seeds = joined(list(self.seeds(lo, hi)))
            while len(held) or len(seeds):
                both = self._in_order(held, seeds)
                some, p, symbol = self.before(both)
                # the least symbol in this range that something in the range makes comes into its own
                here = (symbol * self.sign >= lo) & (symbol * self.sign < hi)
                stop = int((symbol[here] * self.sign).min()) if here.any() else hi
                upto = int(np.searchsorted(both["symbol"], stop)) if stop < hi else len(both)
                mine = int(np.searchsorted(held["symbol"], stop)) if stop < hi else len(held)
                if upto:
                    self.emit(held[:mine])
                    k = int(np.searchsorted(some, upto))
                    self.queue.push(self.sources(both[:upto], (some[:k], p[:k], symbol[:k])))
                if stop == hi:
                    break
                held = joined([held[mine:], *self.queue.pop(r)])
                held = held[np.argsort(held["symbol"], kind="stable")]
                mine = int(np.searchsorted(held["symbol"], stop + 1))
                self._one_symbol(r, stop, [held[:mine]] if mine else [])
                held = joined([held[mine:], *self.queue.pop(r)])
                held = held[np.argsort(held["symbol"], kind="stable")]
                seeds = seeds[np.searchsorted(seeds["symbol"], stop + 1) :]
                lo = stop + 1

    def _in_order(self, held: np.ndarray, seeds: np.ndarray) -> np.ndarray:
        """Under each symbol the queue's tuples, then the seeds."""
        if not len(seeds):
            return held
        both = joined([held, seeds])
        order = np.argsort(both["symbol"], kind="stable")
        both = both[order]
        if self.lcp:
            seed = order >= len(held)
            turn = np.flatnonzero(seed[1:] & ~seed[:-1] & (both["symbol"][1:] == both["symbol"][:-1])) + 1
            both["lcp"][turn] = np.minimum(both["run"][turn - 1], both["run"][turn])
        return both


def _types(text: np.ndarray, room: Room) -> np.ndarray:
    """True for S-suffixes; the last one, with nothing after it, is of type L."""
    n = len(text)
    out = room.array(n, bool)
    carry = False
    for z in range(n - 1, 0, -BLOCK):
        a = max(0, z - BLOCK)
        x, y = text[a:z], text[a + 1 : z + 1]
        # where equal, the type of the next place that differs
        place = np.where(x != y, np.arange(len(x)), len(x))
        less = np.r_[x < y, carry]
        out[a:z] = less[np.minimum.accumulate(place[::-1])[::-1]]
        carry = bool(out[a])
    return out


def _edges(text: np.ndarray, size: int) -> np.ndarray:
    """Ranges of symbols: one for each symbol where they are few or frequent, else of about as
    many suffixes as there are ranges."""
    if size <= 1 << 10:
        return np.arange(size)
    count = np.zeros(size, np.int64)
    for a in range(0, len(text), BLOCK):
        count += np.bincount(text[a : a + BLOCK], minlength=size)
    most = max(1, int(len(text) ** 0.5 / RANGES))
    group = (np.cumsum(count) - count) // most
    own = count > most // 2
    start = np.r_[True, (group[1:] != group[:-1]) | own[1:] | own[:-1]]
    return np.flatnonzero(start)


def _seeder(at: np.ndarray, run: np.ndarray, lcp: np.ndarray, text: np.ndarray, sign: int, size: int):
    """seeds(lo, hi) over suffixes in order (upwards): blocks of tuples whose signed symbols lie in
    [lo, hi), in the order of the pass."""
    n = len(at)
    # the symbols rise along the order, so places are found by halving
    def place(symbol: int) -> int:
        a, z = 0, n
        while a < z:
            m = (a + z) // 2
            if int(text[at[m]]) < symbol:
                a = m + 1
            else:
                z = m
        return a

    def seeds(lo: int, hi: int):
        if sign > 0:
            a, z = place(lo), place(hi)
            cuts = [(i, min(z, i + BLOCK)) for i in range(a, z, BLOCK)]
        else:
            a, z = place(1 - hi), place(1 - lo)
            cuts = [(max(a, i - BLOCK), i) for i in range(z, a, -BLOCK)]
        for i, j in cuts:
            out = np.empty(j - i, TUPLE)
            out["at"], out["run"] = at[i:j], run[i:j]
            out["symbol"] = take(text, out["at"]).astype(np.int64) * sign
            if sign > 0:
                out["lcp"] = lcp[i:j]
            else:
                out = out[::-1].copy()
                # downwards a suffix meets the one above it, if that has the same symbol
                above = np.asarray(lcp[i + 1 : j + 1])[::-1]
                out["lcp"] = np.r_[np.zeros(j - i - len(above), np.int32), above]
            yield out

    return seeds


def _induce(text: np.ndarray, s_type: np.ndarray, size: int, star: np.ndarray, star_lcp: np.ndarray, room: Room, lcp: bool) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, and with `lcp` the common prefix of each with the one before it; star:
    S* positions in order."""
    n, edges = len(text), _edges(text, size)
    runs = room.array(len(star), np.int32)
    for a in range(0, len(star), BLOCK):
        runs[a : a + BLOCK] = _run_lengths(text, star[a : a + BLOCK])
    up = _Induction(text, s_type, False, edges, _seeder(star, runs, star_lcp, text, 1, size), room, lcp, size)
    if n and not s_type[n - 1]:
        up.queue.push(np.array([(int(text[n - 1]), n - 1, 1, 0)], TUPLE))
        up.seen[int(text[n - 1])] = 0
    up.run()
    l_at, l_run, l_lcp = (c.values[: c.n] for c in (up.out_at, up.out_run, up.out_lcp))
    down = _Induction(text, s_type, True, edges, _seeder(l_at, l_run, l_lcp, text, -1, size), room, lcp, size)
    down.run()
    s_at, s_run, s_lcp = (c.values[: c.n] for c in (down.out_at, down.out_run, down.out_lcp))
    # under each symbol the L-suffixes, then the S-suffixes, which came downwards: counts of either kind
    # by symbol give every suffix its place
    order, common = room.array(n, np.int64), room.array(n, np.int32)
    m, per = len(s_at), [np.zeros(size + 1, np.int64) for _ in range(2)]
    for at, count in ((l_at, per[0]), (s_at, per[1])):
        for a in range(0, len(at), BLOCK):
            count[1:] += np.bincount(take(text, at[a : a + BLOCK]), minlength=size)
    before_l, before_s = np.cumsum(per[0]), np.cumsum(per[1])
    for a in range(0, len(l_at), BLOCK):
        at = np.asarray(l_at[a : a + BLOCK])
        place = np.arange(a, a + len(at)) + before_s[take(text, at)]
        order[place], common[place] = at, l_lcp[a : a + len(at)]
    for a in range(0, m, BLOCK):
        # the k-th S-suffix upwards is the (m - 1 - k)-th that came; each knows the one above it, so
        # what one shares with the one below is told by its neighbour
        k = np.arange(a, min(m, a + BLOCK))
        i = m - 1 - k
        at = np.asarray(s_at[i[-1] : i[0] + 1])[::-1]
        symbol = take(text, at)
        shares = np.r_[np.zeros(1 if a == 0 else 0, np.int32), np.asarray(s_lcp[i[-1] + 1 : i[0] + (1 if a == 0 else 2)])[::-1]]
        turn = (k == before_s[symbol]) & (before_l[symbol.astype(np.int64) + 1] > before_l[symbol])
        if turn.any():
            below = np.asarray(l_run)[before_l[symbol[turn].astype(np.int64) + 1] - 1]
            shares[turn] = np.minimum(below, np.asarray(s_run[i[-1] : i[0] + 1])[::-1][turn])
        place = k + before_l[symbol.astype(np.int64) + 1]
        order[place], common[place] = at, shares
    return order, common


def _run_lengths(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    out, live, step = np.ones(len(at), np.int32), np.arange(len(at)), 1
    while len(live):
        live = live[at[live] + step < len(text)]
        live = live[take(text, at[live] + step) == take(text, at[live])]
        step += 1
        out[live] = step
    return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common-prefix lengths of suffixes."""
    out, live, step = np.zeros(len(a), np.int32), np.arange(len(a)), 0
    while len(live):
        live = live[np.maximum(a[live], b[live]) + step < len(text)]
        live = live[take(text, a[live] + step) == take(text, b[live] + step)]
        step += 1
        out[live] = step
    return out


def _same_substring(text: np.ndarray, a: np.ndarray, b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> np.ndarray:
    same = len_a == len_b
    live, step = np.flatnonzero(same), 0
    while len(live):
        live = live[len_a[live] > step]
        equal = take(text, a[live] + step) == take(text, b[live] + step)
        same[live[~equal]] = False
        live, step = live[equal], step + 1
    return same


def sorted_suffixes(text: np.ndarray, size: int, room: Room) -> tuple[np.ndarray, np.ndarray]:
    """Positions of a string of symbols below `size` in suffix order (an end before any symbol), and
    the common prefix of each with the one before it."""
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int32)
    s_type = _types(text, room)
    stars = Column(room, n // 2 + 1, np.int64)
    for a in range(1, n, BLOCK):
        z = min(n, a + BLOCK)
        stars.append(np.flatnonzero(s_type[a:z] & ~s_type[a - 1 : z - 1]) + a)
    star = stars.values[: stars.n]
    if len(star) < 2:
        return _induce(text, s_type, size, star, np.zeros(len(star), np.int32), room, True)
    # names: the S* in the order that one induction from their symbols alone gives
    rough = Column(room, len(star), np.int64)
    order, _ = _induce(text, s_type, size, _by_symbol(text, star, size, room), np.zeros(len(star), np.int32), room, False)
    for a in range(0, n, BLOCK):
        p = order[a : a + BLOCK]
        q = np.maximum(p - 1, 0)
        rough.append(p[(p > 0) & take(s_type, p) & ~take(s_type, q)])
    rough = rough.values[: rough.n]
    names, last = room.array(len(star), np.int64), 0
    for a in range(0, len(rough), BLOCK):
        p = np.asarray(rough[max(a - 1, 0) : a + BLOCK])
        number = np.searchsorted(star, p)
        stop = np.where(number + 1 < len(star), star[np.minimum(number + 1, len(star) - 1)] + 1, n)
        length = stop - p
        new = ~_same_substring(text, p[:-1], p[1:], length[:-1], length[1:])
        if a == 0:
            new = np.r_[False, new]
        else:
            number = number[1:]
        got = last + np.cumsum(new)
        names[number] = got
        last = int(got[-1])
    if last == len(star) - 1:
        ranks, shared = room.array(len(star), np.int64), np.zeros(len(star), np.int32)
        for a in range(0, len(star), BLOCK):
            part = names[a : a + BLOCK]
            ranks[part] = np.arange(a, a + len(part))
    else:
        ranks, shared = sorted_suffixes(names, last + 1, room)
    ordered, common = room.array(len(star), np.int64), room.array(len(star), np.int32)
    for a in range(0, len(star), BLOCK):
        r = np.asarray(ranks[max(a - 1, 0) : a + BLOCK])
        p = take(star, r)
        k = np.asarray(shared[a : a + BLOCK])
        if a == 0:
            ordered[0], p, r, k = p[0], p, r, k[1:]
        # the names that two S* share are so many symbols; where these end, what follows is compared
        upto = [np.where(x + k < len(star), take(star, np.minimum(x + k, len(star) - 1)), n) - y for x, y in ((r[:-1], p[:-1]), (r[1:], p[1:]))]
        skip = np.minimum(*upto)
        at = max(a, 1)
        ordered[at : at + len(skip)] = p[1:]
        common[at : at + len(skip)] = skip + _common(text, p[:-1] + skip, p[1:] + skip)
    return _induce(text, s_type, size, ordered, common, room, True)


def _by_symbol(text: np.ndarray, star: np.ndarray, size: int, room: Room) -> np.ndarray:
    """S* positions ordered by their symbols alone."""
    if not isinstance(text, np.memmap) or len(star) <= IN_MEMORY:
        return star[np.argsort(take(text, star), kind="stable")]
    count = np.zeros(size + 1, np.int64)
    for a in range(0, len(star), BLOCK):
        count[1:] += np.bincount(text[star[a : a + BLOCK]], minlength=size)
    place, out = np.cumsum(count)[:-1], room.array(len(star), np.int64)
    for a in range(0, len(star), BLOCK):
        p = np.asarray(star[a : a + BLOCK])
        symbol = text[p].astype(np.int64)
        order = np.argsort(symbol, kind="stable")
        s = symbol[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        within = np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)]))
        out[place[s] + within] = p[order]
        place[s[first]] += np.diff(np.r_[first, len(s)])
    return out


class Shard:
    """The segments of one shard, as they come: bytes and a separator after each go to a file."""

    def __init__(self, folder: str):
        self.room = Room(folder)
        self.path = os.path.join(folder, "segments")
        self.file, self.sizes = open(self.path, "wb"), []

    def add(self, segment: bytes) -> None:
        # no byte of UTF-8 is 255, so each may rise by one and leave zero to the separator
        self.file.write((np.frombuffer(segment, np.uint8) + np.uint8(1)).tobytes() + b"\0")
        self.sizes.append(len(segment))

    def repeated(self, window: int, weight: np.ndarray):
        """For each segment in turn, the offsets of its windows that start somewhere else too. A
        segment of weight over 1 stands for as many equal ones."""
        self.file.close()
        n = os.path.getsize(self.path)
        if not n:
            return
        text = np.memmap(self.path, np.uint8, "r", shape=(n,))
        text = np.asarray(text).copy() if n <= IN_MEMORY else text
        order, common = sorted_suffixes(text, 257, self.room)
        hit = self.room.array(n, bool)
        for a in range(1, n, BLOCK):
            some = np.flatnonzero(common[a : a + BLOCK] >= window) + a
            hit[order[some]] = True
            hit[order[some - 1]] = True
        start = 0
        for size, w in zip(self.sizes, weight.tolist()):
            whole = max(0, size - window + 1)
            yield np.arange(whole) if w > 1 else np.flatnonzero(hit[start : start + whole])
            start += size + 1


def repeated_windows(segments: list[bytes], window: int, weight: np.ndarray) -> list[np.ndarray]:
    """Shard.repeated of some segments."""
    with tempfile.TemporaryDirectory() as folder:
        shard = Shard(folder)
        for s in segments:
            shard.add(s)
        return list(shard.repeated(window, weight))
