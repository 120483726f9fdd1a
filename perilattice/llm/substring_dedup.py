"""Repeated passages by compact windows: Cartesian trees over token min-hashes, joined on shared minima and verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_words, hash_cut, materialize, mix, partitions, shingle_hashes, text_bytes

UID = "__x9_uid"
SHINGLE = 5
#: Shingles on either side of a minimum whose codes go with its posting.
SIDE = 60
SPAN = 2 * SIDE + 1
#: Shingles that have to repeat in a row for an exact link, and the shortest run that any passage of Jaccard similarity 0.75 keeps.
EXACT, RUN = 40, 18
#: Shifts that a comparison allows, nearest first, and the shingles of the shortest passage.
SHIFTS = sorted(range(-8, 9), key=abs)
LEAST = 46
#: Columns from which on running totals go by rows.
BROAD = 100
#: Groups up to this size compare all pairs at once, larger ones head by head.
SMALL, CHUNK = 48, 2000
#: Runs of five codes that a posting of a passage shares with others of its group at least, and matched shingles beside such runs.
COMMON, BESIDE = 28, 9
#: Classes whose spans are merged at a time.
MERGED = 64
#: Postings that a task holds before it hands them on, and bytes of text by range.
HELD, RANGE_BYTES = 50_000, 1 << 22


def compact_windows(values: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(low, place, high) of the Cartesian tree's nodes that span at least `least` values.

    Every run of at least `least` values whose minimum (the leftmost of equals) is at `place` lies in low..high, so each run
    belongs to exactly one window; there are about 2 len / least of them.
    """
    out, todo = [], [(0, len(values))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        p = low + int(values[low:high].argmin())
        out.append((low, p, high - 1))
        todo.append((low, p))
        todo.append((p + 1, high))
    return out


def thin(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Places without most of those in a stretch that repeats every few words, where the same minimum returns within its own shingle.

    The first and last of a stretch stay, and between them one in each half a side: what stands around the others is the same.
    """
    again = (np.diff(places) <= SHINGLE) & (values[places[1:]] == values[places[:-1]])
    if not again.any():
        return places
    inner = np.concatenate(([False], again)) & np.concatenate((again, [False]))
    opens = np.flatnonzero(np.concatenate(([True], ~again)))
    block = (places - np.repeat(places[opens], np.diff(np.append(opens, len(places))))) // (SIDE // 2)  # alike in all texts
    fresh = np.concatenate(([True], block[1:] != block[:-1]))
    return places[~inner | fresh]


def contexts(s: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Codes 1 to 255 of the shingles around each place; 0 is outside the text."""
    code = ((s >> np.uint64(13)) % np.uint64(255)).astype(np.uint8) + np.uint8(1)
    padded = np.concatenate((np.zeros(SIDE, np.uint8), code, np.zeros(SIDE, np.uint8)))
    return np.lib.stride_tricks.sliding_window_view(padded, SPAN)[places]


_ROW = pa.schema([("kind", pa.int32()), ("r", pa.int32()), (UID, pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("data", pa.binary())])
_OUT = pa.schema([("kind", pa.int32()), (UID, pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ref", pa.int64()), ("ref_low", pa.int64())])
_POST = np.dtype([("key", "<u4"), ("place", "<u4"), ("cls", "<i8"), ("s", "u1", SPAN)])


def extract(hashes: int, least_words: int, ranges: int):
    """Rows of kind 0, one a document, and of kind 1, the postings of one hash range, packed. Copies in a task post once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        held_r: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            posts, r = np.concatenate(held), np.concatenate(held_r)
            held.clear()
            held_r.clear()
            by = np.argsort(r, kind="stable")
            posts, cut = posts[by], np.searchsorted(r[by], np.arange(ranges + 1))
            full = [k for k in range(ranges) if cut[k + 1] > cut[k]]
            m = len(full)
            none = pa.nulls(m, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([1] * m, pa.int32()), pa.array(full, pa.int32()), none, none, none, none, pa.array([posts[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], schema=_ROW)

        for batch in batches:
            info = []
            for uid, doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                w = hash_cut(*cut_words(text.as_py()))
                n, cls = len(w), None
                if n:
                    cls = int(mix((w * (mix(np.arange(n, dtype=np.uint64)) | np.uint64(1))).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)).view(np.int64)[0])
                info.append((0, uid % ranges, uid, doc_id, n, cls, None))
                if n < least_words or cls in seen:
                    continue
                seen.add(cls)
                s = shingle_hashes(w, SHINGLE)
                for k in range(hashes):
                    v = mix(s + np.uint64((k + 1) * 0x9E3779B97F4A7C15 % 2**64))
                    places = thin(v, np.unique([p for _, p, _ in compact_windows(v, min(RUN, least_words - SHINGLE + 1))]).astype(np.int64))
                    posts = np.empty(len(places), _POST)
                    key = mix(v[places])
                    posts["key"], posts["place"], posts["cls"], posts["s"] = key >> np.uint64(32), places, cls, contexts(s, places)
                    held.append(posts)
                    held_r.append((key % np.uint64(ranges)).astype(np.int64))
                    size += len(posts)
                if size > HELD:
                    yield flush()
                    size = 0
            if info:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*info, strict=True), _ROW, strict=True)], schema=_ROW)
        if held:
            yield flush()

    return run


def verify(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of contexts that share a passage of Jaccard similarity 0.75: (which, low, high) and the same places in b, in shingles.

    A shingle is matched if it is in a run of three that b has at a shift of up to eight, or between two such runs and at the
    shift of one of them. In a passage of L shingles, M of them matched, whose shift grows by g from end to end, the similarity
    is M / (2 L + g - M), and 0.75 or more if 7 M >= 6 L + 3 g. Passages of every length from LEAST on count.
    """
    n = len(a)
    a = np.ascontiguousarray(a.T)  # by place, so that all steps go over long rows
    wide = np.zeros((SPAN + 16, n), np.uint8)
    wide[8:-8] = b.T
    there = a > 0
    whole = there[:-2] & there[1:-1] & there[2:]
    code = np.zeros((SPAN, n), np.uint8)  # the shift plus nine, or 0 where there is no match
    for d in reversed(SHIFTS):
        eq = a == wide[8 + d : 8 + d + SPAN]
        run = eq[:-2] & eq[1:-1]
        run &= eq[2:]
        run &= whole
        if run.any():
            eq[:-2], eq[-2:] = run, False
            eq[1:-1] |= run
            eq[2:] |= run
            other = eq.view(np.uint8) - np.uint8(1)  # 255 where nothing matches
            code &= other
            code |= ~other & np.uint8(d + 9)
    before, after = beside(code)
    gaps = np.flatnonzero((code == 0) & there & (before > 0) & (after > 0))
    here, at = a.ravel()[gaps], gaps - n
    for near in (before, after):
        d = near.ravel()[gaps]
        same = here == wide.ravel()[at + d.astype(np.int64) * n]
        code.ravel()[gaps[same]] = d[same]
    hit = code > 0
    at_end, at_start = beside(code)
    # a passage from i to before j: what its end is worth less what its start is
    level = np.zeros((SPAN + 1, n), np.int16)
    np.subtract(hit.view(np.int8) * np.int8(7), np.int8(6), out=level[1:])
    run_on(np.add, level)
    first, last = slice(0, SPAN - LEAST + 1), slice(LEAST - 1, SPAN)
    ends = np.where(there[last] & (at_end[last] > 0), level[LEAST:] - np.int16(3) * at_end[last], np.int16(-9999))
    starts = np.where(there[first] & (at_start[first] > 0), level[first] - np.int16(3) * at_start[first], np.int16(9999))
    run_on(np.maximum, ends[::-1])  # the best end at or after each
    good = ends >= starts
    some = np.flatnonzero(good.any(axis=0))
    good, ends, starts, hit = good[:, some], ends[:, some], starts[:, some], hit[:, some]
    # a place is in a passage that starts less than LEAST before it, or in one that starts earlier and ends at it or after
    latest = np.full((SPAN, len(some)), -SPAN, np.int8)
    latest[first] = np.where(good, np.arange(len(good), dtype=np.int8)[:, None], np.int8(-SPAN))
    run_on(np.maximum, latest)
    inside = latest > np.arange(-LEAST, SPAN - LEAST, dtype=np.int8)[:, None]
    run_on(np.minimum, starts)
    inside[last] |= ends >= starts
    inside &= hit
    inside = np.ascontiguousarray(inside.T)
    which = np.flatnonzero(inside.any(axis=1))
    lo, hi = inside[which].argmax(axis=1), SPAN - 1 - inside[which][:, ::-1].argmax(axis=1)
    which = some[which]
    return which, lo, hi, lo + code[lo, which] - 9, hi + code[hi, which] - 9


def run_on(f: np.ufunc, rows: np.ndarray) -> None:
    """Accumulates down the columns in place, where they are many a whole row at a time."""
    if rows.shape[1] < BROAD:
        f.accumulate(rows, axis=0, out=rows)
        return
    for k in range(1, len(rows)):
        f(rows[k - 1], rows[k], out=rows[k])


def beside(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the matched place at or before each place (by row), and at or after it; 0 where there is none."""
    back, ahead = code.copy(), code.copy()
    step = 1
    while step < SPAN:
        for x in (back, ahead[::-1]):
            empty = (x[step:] > 0).view(np.uint8) - np.uint8(1)  # 255 where nothing is known yet
            empty &= x[:-step]
            x[step:] |= empty
        step *= 2
    return back, ahead


def exact_links(s: np.ndarray, key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pairs, group numbers): for each of the places of EXACT equal codes around a minimum, each posting with its group's first.

    A run of 46 shingles around the minimum holds one of these places, so postings that share one are in one group.
    """
    n = len(s)
    starts = range(SIDE - 45, SIDE + 5, 5)
    five = {}
    for t in range(SIDE - 45, SIDE + EXACT, 5):
        x = np.zeros(n, np.uint64)
        for k in range(5):
            x = x << np.uint64(8) | s[:, t + k]
        five[t] = x
    pairs, groups = [], np.empty((len(starts), n), np.uint64)
    for i, t in enumerate(starts):
        sub = key.astype(np.uint64)
        whole = np.ones(n, bool)
        for k in range(t, t + EXACT, 5):
            sub = mix(sub * np.uint64(0x9E3779B97F4A7C15) + five[k])
        whole &= (s[:, t] > 0) & (s[:, t + EXACT - 1] > 0)
        sub[~whole] = mix(np.arange(n, dtype=np.uint64))[~whole]
        groups[i] = sub
        by = np.argsort(sub, kind="stable")  # postings are in order of class within a group
        first = np.concatenate(([True], sub[by][1:] != sub[by][:-1]))
        head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
        own = cls[by] != cls[head]
        pairs.append(np.column_stack([by[own], head[own], np.full(own.sum(), t)]))
    return np.concatenate(pairs), groups


def equal_run(a: np.ndarray, b: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of the run of equal codes around t to t + EXACT - 1."""
    miss = (a != b) | (a == 0)
    places = np.arange(SPAN)
    lo = np.where(miss & (places < t[:, None]), places, -1).max(axis=1) + 1
    hi = np.where(miss & (places >= t[:, None]), places, SPAN).min(axis=1) - 1
    return lo, hi


def grams(s: np.ndarray) -> np.ndarray:
    """Runs of five codes as numbers, by posting and place; 0 where one is outside the text."""
    out = np.zeros((len(s), SPAN - 4), np.uint64)
    for k in range(5):
        out = out << np.uint64(8) | s[:, k : SPAN - 4 + k]
    return np.where((s[:, :-4] > 0) & (s[:, 4:] > 0), out, np.uint64(0))


def tens(s: np.ndarray) -> np.ndarray:
    """Two runs of five in a row at the four places of which a run of RUN shingles around the minimum holds one."""
    g = grams(s)
    return np.stack([g[:, t] * np.uint64(0x9E3779B97F4A7C15) + g[:, t + 5] for t in range(SIDE - 15, SIDE + 1, 5)])


def numbered(s: np.ndarray) -> tuple[np.ndarray, int]:
    """Runs of five codes by posting and place, numbered from 1 without gaps, and how many there are; 0 is a run outside the text."""
    g = grams(s)
    values, ids = np.unique(g, return_inverse=True)
    least = int(len(values) > 0 and values[0] > 0)
    return (ids.reshape(g.shape) + least).astype(np.uint32), len(values) + least


def tally(counts: np.ndarray, rows: np.ndarray) -> None:
    """Add one to the count of each run for each posting that has it."""
    for k in range(0, len(rows), CHUNK):
        own = np.sort(rows[k : k + CHUNK], axis=1)
        np.add.at(counts, own[np.concatenate((np.ones((len(own), 1), bool), own[:, 1:] != own[:, :-1]), axis=1)], 1)
    counts[0] = 0


def running(common: np.ndarray) -> np.ndarray:
    """By posting, how many of its first 0, 1, .. places common runs cover."""
    hit = np.zeros((len(common), SPAN), bool)
    for k in range(5):
        hit[:, k : SPAN - 4 + k] |= common
    return np.concatenate((np.zeros((len(common), 1), np.int16), np.cumsum(hit, axis=1, dtype=np.int16)), axis=1)


def hopeful(total: np.ndarray) -> np.ndarray:
    """By posting and start, the windows of the shortest passage that common runs could make one or a part of a longer one, with BESIDE places beside them."""
    return 7 * (total[:, LEAST:] - total[:, :-LEAST] + BESIDE) >= 6 * LEAST


def beyond(total: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """By posting and start, the windows of the shortest passage that have more than two common places beside a link from lo to hi."""
    start = np.arange(SPAN - LEAST + 1)
    end = start + LEAST
    low, high = np.maximum(lo - 4, 0)[:, None], np.minimum(hi + 5, SPAN)[:, None]
    inside = np.take_along_axis(total, np.maximum(np.minimum(end, high), np.maximum(start, low)), 1) - np.take_along_axis(total, np.maximum(start, low), 1)
    return total[:, end] - total[:, start] - inside > 2


def near_links(s: np.ndarray, key: np.ndarray, cls: np.ndarray, groups: np.ndarray, exact: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, low, high, low in y, high in y) of near passages, groups with the same minimum at a time.

    A group of up to SMALL postings compares all pairs that no exact group holds; larger ones go to many_links.
    """
    edges = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.repeat(np.diff(edges), np.diff(edges))
    ten = np.concatenate([tens(s[k : k + CHUNK]) for k in range(0, len(s), CHUNK)], axis=1)
    for step in range(1, SMALL):
        i = np.flatnonzero((key[step:] == key[:-step]) & (size[step:] <= SMALL))
        if not len(i):
            continue
        j = i + step
        alike = (ten[:, i] == ten[:, j]).any(axis=0) & (cls[i] != cls[j]) & ~(groups[:, i] == groups[:, j]).any(axis=0)
        i, j = i[alike], j[alike]
        for k in range(0, len(i), CHUNK):
            x, y = i[k : k + CHUNK], j[k : k + CHUNK]
            which, *where = verify(s[x], s[y])
            yield x[which], y[which], *where
    for e in np.flatnonzero(np.diff(edges) > SMALL):
        own = exact[np.searchsorted(exact[:, 0], edges[e]) : np.searchsorted(exact[:, 0], edges[e + 1])]
        yield from many_links(s, cls, groups, np.arange(edges[e], edges[e + 1]), own)


def connected(groups: np.ndarray) -> np.ndarray:
    """The smallest number of those that each column is connected with by equal numbers in a row."""
    part = np.arange(groups.shape[1])
    rows = [np.unique(g, return_inverse=True)[1] for g in groups]
    while True:
        before = part
        for ids in rows:
            least = np.full(len(part), len(part))
            np.minimum.at(least, ids, part)
            part = least[ids]
        if (part == before).all():
            return part


def many_links(s: np.ndarray, cls: np.ndarray, groups: np.ndarray, pool: np.ndarray, exact: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Links of a large group. They connect what all its pairs would, and hold all windows that a link of any pair would.

    A posting that has a window that runs of others may make a passage and that no link holds is compared with all others that
    share enough runs with it; only windows with the minimum count, as others have postings of their own. Likeness doesn't carry
    over from pair to pair, so one whose windows are held is still compared with those, and afterwards with others of its kind
    that links don't connect it to. exact: (posting, low, high) of the links to an earlier posting, which stands for its windows there.
    """
    base, size = pool[0], len(pool)
    first = np.unique(s[pool], axis=0, return_index=True)[1]  # equal contexts are linked as exact
    first.sort()
    pool = pool[first]
    m = len(pool)
    has, kinds = numbered(s[pool])
    counts = np.zeros(kinds, np.int32)
    tally(counts, has)
    total = np.concatenate([running(counts[has[k : k + CHUNK]] > 1) for k in range(0, m, CHUNK)])
    around = np.zeros(SPAN - LEAST + 1, bool)  # windows around the minimum
    around[SIDE - LEAST + 1 : SIDE + 1] = True
    free = np.concatenate([hopeful(total[k : k + CHUNK]) & around for k in range(0, m, CHUNK)])
    able = free.any(axis=1)
    place = np.full(size, -1)
    place[first] = np.arange(m)
    at = place[exact[:, 0] - base]
    exact, at = exact[at >= 0], at[at >= 0]
    for k in range(0, len(exact), CHUNK):
        own = at[k : k + CHUNK]
        np.logical_and.at(free, own, beyond(total[own], *exact[k : k + CHUNK, 1:].T))
    part = connected(groups[:, pool])
    slot = np.zeros(kinds, np.uint8)  # the runs of one posting, numbered from 1

    def meet(x: int, others: np.ndarray) -> list[tuple[np.ndarray, ...]]:
        """Links of x with some of the others: their numbers and what verify says. Each of the two holds enough runs of the other."""
        found = []
        own, times = np.unique(has[x][has[x] > 0], return_counts=True)
        slot[own] = np.arange(1, len(own) + 1)
        near = others[np.concatenate([(slot[has[others[k : k + CHUNK]]] > 0).view(np.uint8).sum(axis=1, dtype=np.uint8) for k in range(0, len(others), CHUNK)]) >= COMMON] if len(others) else others
        for k in range(0, len(near), CHUNK):
            y = near[k : k + CHUNK]
            which, *where = verify(s[pool[y]], np.broadcast_to(s[pool[x]], (len(y), SPAN)))
            held = np.zeros((len(which), len(own) + 1), bool)
            held[np.arange(len(which))[:, None], slot[has[y[which]]]] = True
            both = held[:, 1:] @ times >= COMMON
            y, where = y[which][both], [w[both] for w in where]
            met = np.zeros(m, bool)
            met[part[y]] = True
            part[met[part]] = part[x]
            found.append((y, *where))
        slot[own] = 0
        return found

    def fresh(x: int, y: np.ndarray, *where: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = pool[y], pool[x]
        new = (cls[a] != cls[b]) & ~(groups[:, a] == groups[:, [b]]).any(axis=0)
        return a[new], np.full(new.sum(), b), *(w[new] for w in where)

    # those with the most in common stand for the others first
    rest = able.copy()
    for x in np.argsort(-total[:, -1], kind="stable").tolist():
        if not (rest[x] and free[x].any()):
            continue
        rest[x] = False
        others = np.flatnonzero(able)
        others = others[rest[others]]
        for y, lo, hi, *there in meet(x, others):
            free[y] &= beyond(total[y], lo, hi)
            yield fresh(x, y, lo, hi, *there)
    # the rest haven't met each other: those that runs might link across what is connected
    left = np.flatnonzero(rest)
    if len(np.unique(part[left])) < 2:
        return
    least, most = np.full(kinds, m), np.full(kinds, -1)
    for k in range(0, len(left), CHUNK):
        own = left[k : k + CHUNK]
        np.minimum.at(least, has[own], part[own, None])
        np.maximum.at(most, has[own], part[own, None])
    across = least < most
    across[0] = False
    left = left[np.concatenate([(hopeful(running(across[has[left[k : k + CHUNK]]])) & around).any(axis=1) for k in range(0, len(left), CHUNK)])]
    if not len(left):
        return
    names, many = np.unique(part[left], return_counts=True)
    for x in left[part[left] != names[many.argmax()]].tolist():
        for y, *where in meet(x, left[part[left] != part[x]]):
            yield fresh(x, y, *where)


def match(group: pa.Table) -> pa.Table:
    """Passes documents on and joins a range's windows: the passages that postings with one minimum share.

    Kind 1 are all links as found, kind 2 their reverse: there, one text stands for all that share the same words.
    """
    docs = group.filter(pa.array(group.column("kind").to_numpy() == 0))
    none = pa.nulls(len(docs), pa.int64())
    tables = [pa.table([docs.column("kind"), docs.column(UID), docs.column("doc_id"), docs.column("n"), docs.column("cls"), none, none, none, none], schema=_OUT)]
    chunks = [np.frombuffer(x, _POST) for x in group.column("data").to_pylist() if x is not None]
    if chunks:
        posts = np.concatenate(chunks)
        posts = posts[np.lexsort((posts["place"], posts["cls"], posts["key"]))]
        new = np.concatenate(([True], (posts["key"][1:] != posts["key"][:-1]) | (posts["cls"][1:] != posts["cls"][:-1]) | (posts["place"][1:] != posts["place"][:-1])))
        posts = posts[new]
        same = posts["key"][1:] == posts["key"][:-1]
        posts = posts[np.concatenate((same, [False])) | np.concatenate(([False], same))]
    if not chunks or not len(posts):
        return tables[0]
    s, key, cls = np.ascontiguousarray(posts["s"]), posts["key"], posts["cls"]
    pairs, groups = exact_links(s, key, cls)
    found, exact = [], np.zeros((0, 3), np.int64)
    if len(pairs):
        pairs = pairs[np.unique(pairs[:, :2], axis=0, return_index=True)[1]]
        for k in range(0, len(pairs), 10 * CHUNK):
            x, y, t = pairs[k : k + 10 * CHUNK].T
            lo, hi = equal_run(s[x], s[y], t)
            found.append(np.column_stack([x, y, lo, hi, lo, hi]))
        exact = np.concatenate(found)[:, [0, 2, 3]]
    found += [np.column_stack(f) for f in near_links(s, key, cls, groups, exact) if len(f[0])]
    if not found:
        return tables[0]
    x, y, lo, hi, there_lo, there_hi = np.concatenate(found).T
    place = posts["place"].astype(np.int64) - SIDE
    for kind, a, b, low, high, start in ((1, x, y, lo, hi, there_lo), (2, y, x, there_lo, there_hi, lo)):
        span = np.column_stack([cls[a], place[a] + low, place[a] + high + SHINGLE, cls[b], place[b] + start])
        span = span[np.lexsort(span.T[::-1])]
        same = 5 if kind == 1 else 3
        span = span[np.concatenate(([True], (span[1:, :same] != span[:-1, :same]).any(axis=1)))]
        m = len(span)
        none = pa.nulls(m, pa.int64())
        tables.append(pa.table([pa.array(np.full(m, kind, np.int32)), none, none, none, *[pa.array(np.ascontiguousarray(c)) for c in span.T]], schema=_OUT))
    return pa.concat_tables(tables)


_REFS = "array<struct<ref:long,ref_start:long>>"
_SPANS = f"array<struct<start:long,end:long,ref:long,ref_start:long,refs:{_REFS}>>"


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each class's spans where they touch; a span keeps each text that it refers to once for each run of places there."""
    refs = pa.list_(pa.struct([("ref", pa.int64()), ("ref_start", pa.int64())]))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ref", pa.int64()), ("ref_start", pa.int64()), ("refs", refs)]))
    for batch in batches:
        for k in range(0, len(batch), MERGED):
            rows = batch.slice(k, MERGED)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([merged(spans.as_py()) for spans in rows.column(1)], kind)], names=["cls", "spans"])


def merged(spans: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted(spans, key=lambda s: (s["low"], -s["high"], s["cls"], s["ref_low"])):
        if out and s["low"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["high"])
        else:
            out.append({"start": s["low"], "end": s["high"], "ref": s["ref"], "ref_start": s["ref_low"], "refs": [], "seen": {}})
        # a link that goes on from the last one to the same class is the same link
        place, end = s["ref_low"], s["ref_low"] + s["high"] - s["low"]
        runs = out[-1]["seen"].setdefault(s["cls"], [])
        near = next((r for r in runs if r[0] <= end and place <= r[1]), None)
        if near:
            near[1] = max(near[1], end)
        else:
            runs.append([place, end])
            out[-1]["refs"].append({"ref": s["ref"], "ref_start": place})
    for g in out:
        del g["seen"]
    return out


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, hashes: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, n_words, repeated_words, and spans: array of (start, end, ref, ref_start, refs), in words.

    A span is a passage of about least_words words or more that another text has too; refs are (ref, ref_start): doc_ids of
    such texts and the passage's place there, ref and ref_start the first of them. Tokens are five-word shingles, A-Z
    lower-cased. Passages that repeat word for word are found for certain at every length from least_words on; those with
    words changed, inserted or lost are found if the shingles' Jaccard similarity is 0.75 or more, as a run of RUN equal
    shingles is left in each of them and its minimum is posted by both texts. A code of eight bits stands for a shingle in
    that comparison, SIDE shingles to either side and with shifts of up to eight words. Spans are where passages were found,
    a few words shorter or longer than the passage. Of n texts that share a passage each is linked to one that stands for them, which
    names one of them itself, so that the links of all rows connect them. Texts that are equal as a whole, of at
    least least_words words, have one span, which refers to a twin and to what their parts refer to. Null or short texts
    have no spans; a null id is a null ref. Repeated rows are copies of each other. An empty table gives an empty result.
    Other columns are not read.

    Each text posts the minima of its compact windows with codes of what stands around them; a hash range's postings
    meet in one task. Exact repeats are held against the first of their group; near ones against all others that may match,
    in large groups until links hold all of a posting's windows and connect what its pairs would.
    """
    spark = docs.sparkSession
    ranges = max(2 * partitions(spark), text_bytes(docs, text_col) // RANGE_BYTES)
    rows = docs.select(F.monotonically_increasing_id().alias(UID), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    packed = rows.mapInArrow(extract(hashes, least_words, ranges), f"kind int, r int, {UID} long, doc_id long, n long, cls long, data binary")
    both = materialize(packed.groupBy("r").applyInArrow(match, f"kind int, {UID} long, doc_id long, n long, cls long, low long, high long, ref long, ref_low long"), "passages")
    info = both.where("kind = 0").select("doc_id", "n", "cls")
    by_class = info.where("cls is not null").groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("least_id"), F.max("doc_id").alias("most_id"))
    link = ["cls", "low", "high", "ref", "ref_low"]
    # in reverse, one row a class and span: a text's spans are bounded by its length
    back = both.where("kind = 2").groupBy("cls", "low", "high").agg(F.min(F.struct("ref", "ref_low")).alias("r")).select("cls", "low", "high", "r.*")
    spans = both.where("kind = 1").select(*link).union(back)
    named = spans.join(by_class.select(F.col("cls").alias("ref"), F.col("least_id").alias("ref_id")), "ref").select("cls", F.struct("low", "high", F.col("ref").alias("cls"), F.col("ref_id").alias("ref"), "ref_low").alias("s"))
    merged = named.groupBy("cls").agg(F.collect_list("s").alias("s")).mapInArrow(merge, f"cls long, spans {_SPANS}")
    facts = by_class.join(merged, "cls", "left")
    out = info.join(facts, "cls", "left")
    twin = F.when(F.col("doc_id") == F.col("least_id"), F.col("most_id")).otherwise(F.col("least_id"))
    empty = F.array().cast(_SPANS)
    parts = F.flatten(F.transform(F.coalesce("spans", empty), lambda x: x["refs"]))
    zero = F.lit(0).cast("long")
    refs = F.concat(F.array(F.struct(twin.alias("ref"), zero.alias("ref_start"))), parts).cast(_REFS)
    whole = F.array(F.struct(zero.alias("start"), F.col("n").alias("end"), twin.alias("ref"), zero.alias("ref_start"), refs.alias("refs"))).cast(_SPANS)
    spans = F.when((F.col("copies") > 1) & (F.col("n") >= least_words), whole).otherwise(F.coalesce("spans", empty))
    out = out.select("doc_id", F.col("n").alias("n_words"), spans.alias("spans"))
    return out.select("doc_id", "n_words", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("repeated_words"), "spans")
