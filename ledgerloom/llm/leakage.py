"""Evaluation passages in scanned pages, by greedy string tiling.

Texts are reduced to their letters and digits, folded to classes of shapes that scanners confuse, so that capitals, punctuation,
hyphens at line ends and lost or added blanks play no part. Hashed runs (Karp-Rabin) give all matches of a page with all items; an item
whose matches could not be linked over enough of it is dropped. For the rest, the longest are marked first and none overlaps
another, and marked tiles are linked along the item: over a short misreading, or from the end of one printed segment to the
start of another, as columns and adverts scatter a passage. The words of the item under one chain of tiles decide.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_WORDS, MIN_CHARS = 16, 30
#: Length of the shortest tile, in letters: (alphabets, scripts without blanks).
TILE = (6, 3)
#: Items are searched for in blocks of so many items, and so many letters in all, each broadcast: about 60 MB at most with its hashes.
BLOCK, BLOCK_LETTERS = 20_000, 2_000_000

# Letters that scanners take for one another, each line a class named by its first letter.
CONFUSED = ("oec0", "il1j|!", "nu", "sſ5", "hb6")


def _folding() -> np.ndarray:
    """Class of every code point below 0x20000; 0 for what is dropped. Letters beyond, all of them Han, are classes of their own."""
    out = np.zeros(0x20000, dtype=np.int32)
    for code in range(0x20000):
        ch = chr(code)
        if ch.isalnum():
            out[code] = ord(ch.casefold()[0])
        elif 0x900 <= code < 0xE80 and ch.isprintable() and not ch.isspace():  # vowel signs
            out[code] = code
    for group in CONFUSED:
        for ch in group:
            for c in (ch, ch.upper()):
                if len(c) == 1:
                    out[ord(c)] = ord(group[0])
    return out


_FOLD: np.ndarray | None = None


def fold_table() -> np.ndarray:
    global _FOLD
    if _FOLD is None:
        _FOLD = _folding()
    return _FOLD


def _classes(codes: np.ndarray) -> np.ndarray:
    table = fold_table()
    if not len(codes) or codes.max() < len(table):
        return table[codes]
    return np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], np.where(codes < 0x32000, codes, 0)).astype(np.int32)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def hashes(letters: np.ndarray, length: int) -> np.ndarray:
    """Rolling (Karp-Rabin) hash of every run of `length` letters, modulo 2^64."""
    n = len(letters) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    wide = letters.astype(np.uint64)
    for k in range(length):
        out = out * _MULTIPLIER + wide[k : k + n]
    return out ^ (out >> np.uint64(29))


@dataclass
class Item:
    """A passage: its letters, where its words start among them, and whether it is counted in characters."""

    item_id: int
    letters: np.ndarray
    figures: np.ndarray
    places: np.ndarray
    starts: list[int]
    unspaced: bool
    tile_hashes: np.ndarray
    tile_order: np.ndarray
    least: int = 0


def unspaced(codes: np.ndarray) -> bool:
    """Mostly Han or kana."""
    cjk = ((codes >= 0x3040) & (codes < 0x3100)) | ((codes >= 0x3400) & (codes < 0xA000)) | ((codes >= 0x20000) & (codes < 0x32000))
    return bool(cjk.sum() * 2 > len(codes))


def _figures(codes: np.ndarray) -> np.ndarray:
    return (codes >= 48) & (codes < 58)


def make_item(item_id: int, text: str) -> Item:
    codes = codes_of(text)
    classes = _classes(codes)
    kept = classes > 0
    letters, by_char = classes[kept], unspaced(codes)
    if by_char:
        starts = list(range(len(letters)))
    else:
        blank = np.isin(codes, (32, 10, 9, 0xA0))
        word = np.cumsum(blank)[kept]
        starts = [i for i in range(len(word)) if i == 0 or word[i] != word[i - 1]]
    found = hashes(letters, TILE[by_char])
    order = np.argsort(found, kind="stable")
    item = Item(item_id, letters, _figures(codes[kept]), np.flatnonzero(kept), starts, by_char, found[order], order)
    item.least = _least_letters(item)
    return item


@dataclass
class Page:
    """A document's letters, and where its printed segments (lines, or parts of lines set apart by blanks) begin among them."""

    letters: np.ndarray
    figures: np.ndarray
    segments: np.ndarray


def make_page(text: str) -> Page:
    codes = codes_of(text)
    classes = _classes(codes)
    kept = classes > 0
    blank = codes == 32
    cut = (codes == 10) | (codes == 13)
    cut[1:] |= blank[1:] & blank[:-1]
    at = np.flatnonzero(kept)
    starts = np.searchsorted(at, np.flatnonzero(cut))
    starts = starts[(starts > 0) & (starts < len(at))]
    marks = np.empty(len(starts) + 2, dtype=np.int64)
    marks[0], marks[1:-1], marks[-1] = 0, starts, len(at)
    return Page(classes[at], _figures(codes[at]), np.concatenate([marks[:1], marks[1:][marks[1:] > marks[:-1]]]))


def matches(page: Page, page_hashes: np.ndarray, item: Item) -> list[tuple[int, int, int]]:
    """(page position, item position, length) of all maximal equal runs of at least a tile."""
    low = np.searchsorted(item.tile_hashes, page_hashes, "left")
    n = np.searchsorted(item.tile_hashes, page_hashes, "right") - low
    at = np.repeat(np.arange(len(page_hashes)), n)
    if not len(at):
        return []
    within = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    of = item.tile_order[np.repeat(low, n) + within]
    order = np.lexsort((at, at - of))
    at, of = at[order], of[order]
    new = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(at - of) != 0)])
    size = np.diff(np.r_[new, len(at)]) + TILE[item.unspaced] - 1
    return list(zip(at[new].tolist(), of[new].tolist(), size.tolist(), strict=True))


def alike(a: list[int], b: list[int], free: int = 2) -> bool:
    """Whether two short runs may be one print read twice: edit distance of at most half the longer, or both at most `free` letters."""
    longer = max(len(a), len(b))
    if longer <= free:
        return True
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] * 2 <= longer


#: Letters that one misreading may take; letters that may be lost where a segment ends or begins.
GAP, EDGE = 9, 4
#: Segments that an advert or another column may put between two segments of a passage; least share of a passage under tiles.
REACH, COVERAGE = 6, 0.85
#: Letters that a link over anything but a misreading or a turn costs, as over another number.
BREAK = 4
#: Places left free between items that lie on one line; more than a gap.
PAD = 32
#: More than any class of letters.
LED = 1 << 18
#: Letters of pages that are searched at once, and pairs of a page and an item at most.
LETTERS, PAIRS = 50_000, 1_000_000


def joined(found: list[tuple[int, int, int]], page: Page, item: Item) -> list[tuple[int, int, int, int]]:
    """(page start, page end, item start, item end) of matches linked over short misreadings."""
    found = sorted(found)
    letters, own = page.letters, item.letters
    out: list[list[int]] = []
    live: list[list[int]] = []
    for d, i, n in found:
        best = None
        live = [m for m in live if m[1] >= d - GAP - 2]
        for m in live:
            gd, gi = d - m[1], i - m[3]
            if -3 <= gd <= GAP and -3 <= gi <= GAP and abs(gd - gi) <= 3 and d + n > m[1] and i + n > m[3]:
                over = min(gd, gi, 0)
                if n + over > 1 and (best is None or m[3] - m[2] > best[3] - best[2]):
                    other_number = page.figures[m[1] : d].any() and item.figures[m[3] : i].any()
                    if not other_number and alike(letters[m[1] : max(d, m[1])].tolist(), own[m[3] : max(i, m[3])].tolist(), 1 if item.unspaced else 2):
                        best = m
        if best is not None:
            best[1], best[3] = d + n, i + n
        else:
            m = [d, d + n, i, i + n]
            out.append(m)
            live.append(m)
    return [tuple(m) for m in out]


def mark(found: list[tuple[int, int, int, int]], least: int, length: int) -> list[tuple[int, int, int, int]]:
    """Greedy tiling of the page: again and again the longest match that is left is marked, until none of the least length is.

    A match that overlaps marked tiles is cut to what lies between them, and each piece waits for its turn by its own length. The
    item's side stays open: a page may print a phrase of the passage twice, and only the place in order belongs to the chain.
    """
    marked: list[tuple[int, int, int, int]] = []
    taken = bytearray(length)
    waiting = [(d0 - d1, d0, i0, d1, i1) for d0, d1, i0, i1 in found]
    heapify(waiting)
    while waiting:
        _, d0, i0, d1, i1 = heappop(waiting)
        hit = taken.find(1, d0, d1)
        if hit < 0:
            taken[d0:d1] = b"\x01" * (d1 - d0)
            marked.append((d0, d1, i0, i1))
            continue
        free = d0
        while free < d1:
            hit = taken.find(1, free, d1)
            end = d1 if hit < 0 else hit
            x0 = i0 + (free - d0)
            x1 = i1 - (d1 - end) if end == d1 or d1 - d0 == i1 - i0 else min(i1, x0 + (end - free))
            if end - free >= least and x1 - x0 >= least:
                heappush(waiting, (free - end, free, x0, end, x1))
            if hit < 0:
                break
            free = taken.find(0, hit, d1)
            if free < 0:
                break
    return marked


def _trimmed(tiles: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, ...]:
    """d0, d1, i0, i1 in order of the item, without the few letters by which tiles reach, by chance, into the segment before or after."""
    d0, d1, i0, i1 = tiles
    wide = d1 - d0 > 4 * EDGE
    after = np.searchsorted(marks, d0, "right")
    lead = np.where(wide & (marks[after] - d0 <= EDGE) & (marks[after - 1] < d0), marks[after] - d0, 0)
    d0, i0 = d0 + lead, i0 + lead
    stop = marks[np.searchsorted(marks, d1 - 1, "right") - 1]
    tail = np.where(wide & (d1 - stop <= EDGE) & (stop > d0), d1 - stop, 0)
    d1, i1 = d1 - tail, i1 - tail
    order = np.lexsort((i1, i0))
    return d0[order], d1[order], i0[order], i1[order]


def _links(d0: np.ndarray, d1: np.ndarray, i0: np.ndarray, i1: np.ndarray, marks: np.ndarray, long_tile: np.ndarray) -> tuple[np.ndarray, ...]:
    """Tile, earlier tile and letters that the link adds, of all tiles that may follow each other, by tile."""
    by_end = np.argsort(i1, kind="stable")
    ends = i1[by_end]
    low, high = np.searchsorted(ends, i0 - 2 * EDGE), np.searchsorted(ends, i0 + 3, "right")
    n = high - low
    k = np.repeat(np.arange(len(i0)), n)
    j = by_end[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
    some = (j < k) & (i1[k] > i1[j])
    k, j = k[some], j[some]
    first, last = np.searchsorted(marks, d0, "right") - 1, np.searchsorted(marks, d1 - 1, "right") - 1
    head, tail, wide = d0 - marks[first], marks[last + 1] - d1, np.minimum(d1 - d0, long_tile)
    gap, on = i0[k] - i1[j], d0[k] - d1[j]
    near = (on >= -3) & (on <= 4) & (np.abs(on - gap) <= 2)
    further = first[k] - last[j]
    turn = (tail[j] <= EDGE) & (head[k] <= EDGE) & (np.abs(tail[j] + head[k] - gap) <= 2)
    turn &= ((further > 0) & (further <= REACH)) | (wide[k] + wide[j] >= 2 * long_tile[k])
    kept = near | turn
    more = i1[k] - np.maximum(i0[k], i1[j]) - np.where(turn, 0, BREAK)
    return k[kept], j[kept], more[kept]


Tiles = list[tuple[int, int, int, int]]


def all_chains(jobs: list[tuple[Tiles, Page, Item]]) -> Iterator[tuple[int, int, int, Tiles]]:
    """`chains` of many pairs of a page and an item, which are laid on one line each so that their links are found at once."""
    jobs_n = np.array([len(tiles) for tiles, _, _ in jobs], dtype=np.int64)
    if not jobs_n.sum():
        yield from ((0, 0, 0, []) for _ in jobs)
        return
    lengths = np.array([int(page.segments[-1]) for _, page, _ in jobs])
    on_page = np.cumsum(lengths + PAD) - lengths
    on_item = np.arange(len(jobs)) * (max(len(item.letters) for _, _, item in jobs) + PAD)
    marks = np.concatenate([x + np.asarray(page.segments) for (_, page, _), x in zip(jobs, on_page, strict=True)])
    job = np.repeat(np.arange(len(jobs)), jobs_n)
    d, i = on_page[job], on_item[job]
    tiles = np.array([t for tiles, _, _ in jobs for t in tiles], dtype=np.int64).T + np.stack([d, d, i, i])
    d0, d1, i0, i1 = _trimmed(tiles, marks)  # pairs stay in order, as their items are
    k, j, more = _links(d0, d1, i0, i1, marks, np.array([8 if item.unspaced else 24 for _, _, item in jobs])[job])
    bounds = np.cumsum(np.r_[0, jobs_n])
    ranges = np.searchsorted(k, bounds).tolist()
    d0, d1, i0, i1 = ((x - y).tolist() for x, y in ((d0, d), (d1, d), (i0, i), (i1, i)))
    k, j, more = (k - bounds[job[k]]).tolist(), (j - bounds[job[j]]).tolist(), more.tolist()
    bounds = bounds.tolist()
    for a, b, x, y in zip(bounds, bounds[1:], ranges, ranges[1:]):
        yield _best(d0[a:b], d1[a:b], i0[a:b], i1[a:b], zip(k[x:y], j[x:y], more[x:y], strict=True)) if a < b else (0, 0, 0, [])


def chains(tiles: Tiles, page: Page, item: Item) -> tuple[int, int, int, Tiles]:
    """(item start, item end, letters under tiles, tiles) of the chain that spans most of the item, among those with COVERAGE of their span under tiles.

    Two tiles are linked if the item goes on where the first ends, and the page either goes on too, or turns from the end of one
    segment to the start of another: a few segments further on, or, where both tiles are long, anywhere (columns in wrong order).
    """
    return next(all_chains([(tiles, page, item)]))


def _best(d0: list[int], d1: list[int], starts: list[int], stops: list[int], links: Iterable[tuple[int, int, int]]) -> tuple[int, int, int, Tiles]:
    """The chain that `chains` returns. For each tile, every start of a chain that ends with it is kept, with the most letters under tiles."""
    longest = max(range(len(starts)), key=lambda k: stops[k] - starts[k])
    best = (starts[longest], stops[longest], stops[longest] - starts[longest], longest)
    states: dict[int, dict[int, tuple[int, int]]] = {}  # of linked tiles, by start: letters under tiles, tile before
    for k, j, more in links:
        for x in (j, k):
            if x not in states:
                states[x] = {starts[x]: (stops[x] - starts[x], -1)}
        own, i, end = states[k], starts[k], stops[k]
        for begin, (under, _) in states[j].items():
            if begin <= i and (begin not in own or own[begin][0] < under + more):
                own[begin] = (under + more, j)
                if under + more >= COVERAGE * (end - begin) and (end - begin, under + more) > (best[1] - best[0], best[2]):
                    best = (begin, end, under + more, k)
    path, k = [], best[3]
    while k >= 0:
        path.append((d0[k], d1[k], starts[k], stops[k]))
        k = states[k][best[0]][1] if k in states else -1
    return (*best[:3], path[::-1])


def words_under(item: Item, begin: int, end: int) -> int:
    """Words of which the span begin..end of letters holds more than half; characters, marks among them included, without blanks."""
    if item.unspaced:
        return int(item.places[end - 1] - item.places[begin]) + 1 if end > begin else 0
    own = item.starts[max(0, bisect_right(item.starts, begin) - 1) : bisect_left(item.starts, end) + 1]
    stops = [*own[1:], len(item.letters)]
    return sum(1 for a, b in zip(own, stops, strict=True) if 2 * (min(b, end) - max(a, begin)) > b - a)


def leaked_words(page: Page, found: list[tuple[int, int, int]], item: Item) -> int:
    """Words or characters under the best chain of tiles, from all matches of a page and an item."""
    tiles = mark(joined(found, page, item), TILE[item.unspaced], len(page.letters))
    begin, end, _, _ = chains(tiles, page, item)
    return words_under(item, begin, end)


def _least_letters(item: Item) -> int:
    """Letters that a span of the least length that counts has at least; 0 if the item is shorter than that."""
    if item.unspaced:
        first = np.arange(len(item.places))
        last = np.searchsorted(item.places, item.places + MIN_CHARS - 1)
        size = (last + 1 - first)[last < len(item.places)]
        return int(size.min()) if len(size) else 0
    sizes = np.diff([*item.starts, len(item.letters)])
    if len(sizes) < MIN_WORDS:
        return 0
    inner = np.convolve(sizes, np.ones(MIN_WORDS - 2, dtype=np.int64), "valid")[1:-1]  # more than half of the outer two
    return int((inner + sizes[: len(inner)] // 2 + sizes[MIN_WORDS - 1 :] // 2 + 2).min())


class Index:
    """Seeds, runs of a tile's length, of a block of items, looked up by hash; built in one sort of all of them."""

    def __init__(self, items: list[Item]):
        self.items = items
        self.sides = [self._side(by_char) for by_char in (False, True)]

    def _side(self, by_char: bool):
        least = {k: item.least for k, item in enumerate(self.items) if item.unspaced == by_char and item.least}
        if not least:
            return None
        mine = np.array(list(least))
        size = np.array([len(self.items[k].letters) for k in mine])
        begin = np.cumsum(size + PAD) - size  # of each item on one line of all letters
        line = np.full(int(begin[-1] + size[-1] + PAD), -1, dtype=np.int32)  # what lies between equals nothing on a page
        for k, b in zip(mine, begin, strict=True):
            line[b : b + len(self.items[k].letters)] = self.items[k].letters
        h = [hashes(self.items[k].letters, TILE[by_char]) for k in mine]
        place = np.concatenate([b + np.arange(len(x)) for b, x in zip(begin, h, strict=True)])
        h = np.concatenate(h)
        order = np.lexsort((line[place - 1], h))  # by hash, and by the letter before
        place = place[order]
        h, first, n = np.unique(h[order], return_index=True, return_counts=True)
        led, led_first, led_n = np.unique(np.repeat(np.arange(len(h)), n) * LED + line[place - 1], return_index=True, return_counts=True)
        slots = np.searchsorted(h >> np.uint64(44), np.arange((1 << 20) + 1, dtype=np.uint64)).astype(np.int32)
        owner = np.repeat(np.arange(len(mine)), size + PAD)  # of each place on the line, but for the last blank ones
        return h, first, n, place, slots, mine, begin, np.array(list(least.values())), _doubled(line), owner, led, led_first, led_n

    def pairs(self, pages: list[Page]) -> list[tuple[int, int, list[tuple[int, int, int]]]]:
        """(page, item, matches) of every pair that may have a chain of the least length: no other pair can.

        Matches that may be joined form a group, which holds whole tiles. Groups are linked wherever `chains` may link tiles that lie
        in them, however those are shortened. What is linked must reach over the least length, and cover enough of it.
        """
        out: list[tuple[int, int, list[tuple[int, int, int]]]] = []
        if not pages:
            return out
        lengths = np.array([len(p.letters) for p in pages])
        offsets = np.cumsum(lengths + PAD) - lengths
        line = np.zeros(int(offsets[-1] + lengths[-1] + PAD), dtype=pages[0].letters.dtype)
        for p, x in zip(pages, offsets, strict=True):
            line[x : x + len(p.letters)] = p.letters
        doubled = _doubled(line)
        marks = np.concatenate([x + np.array(p.segments) for p, x in zip(pages, offsets, strict=True)])
        for by_char, side in enumerate(self.sides):
            if side is not None:
                self._linked(out, by_char, side, line, doubled, marks, offsets)
        return out

    def _linked(self, out: list, by_char: int, side: tuple, line: np.ndarray, doubled: list[np.ndarray], marks: np.ndarray, offsets: np.ndarray) -> None:
        h, first, count, place, slots, mine, begin, least, letters, owner, led, led_first, led_n = side
        own = hashes(line, TILE[by_char])
        slot = (own >> np.uint64(44)).astype(np.int64)
        low, high = slots[slot], slots[slot + 1]
        at = np.flatnonzero(low < high)
        low, high, found = low[at], high[at], []
        while len(at):
            same = h[low] == own[at]
            found.append((at[same], low[same]))
            more = ~same & (low + 1 < high)
            at, low, high = at[more], low[more] + 1, high[more]
        at, low = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (at, low)
        if not len(at):
            return
        # of the places with these letters, all but those with the same letter before, where a match only goes on
        wanted = low.astype(np.int64) * LED + line[at - 1]
        k = np.minimum(np.searchsorted(led, wanted), len(led) - 1)
        same = np.where(led[k] == wanted, led_n[k], 0)
        n = count[low] - same
        some = np.flatnonzero(n)
        at, low, k, same, n = at[some], low[some], k[some], same[some], n[some]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        i0 = place[np.repeat(first[low], n) + run + np.where(run >= np.repeat(np.where(same > 0, led_first[k] - first[low], len(place)), n), np.repeat(same, n), 0)]
        d0 = np.repeat(at, n)
        size = _lengths(doubled, letters, d0, i0, TILE[by_char])
        items = len(mine)
        item = owner[i0]
        whose = np.repeat(np.arange(len(offsets)), np.diff(np.r_[offsets, len(line)]))[d0 - PAD] * items + item
        # what cannot be enough even if every match were joined to another
        order = np.flatnonzero(np.bincount(whose, size + GAP, len(offsets) * items)[whose] >= COVERAGE * least[item])
        if not len(order):
            return
        d0, i0, size, whose, item = d0[order], i0[order] - begin[item[order]], size[order], whose[order], item[order]
        shift = d0 - i0
        lowest = int(shift.min())
        key = whose * (int(shift.max()) - lowest + 4) + (shift - lowest)
        order = _order(key)  # by pair and diagonal
        key, d0, i0, size, whose, item, shift = (x[order] for x in (key, d0, i0, size, whose, item, shift))
        d1, i1, need = d0 + size, i0 + size, least[item]

        near, a, k = [], np.arange(len(key)), 0  # two matches of a pair whose diagonals differ by at most 3
        while True:
            k += 1
            a = a[: np.searchsorted(a, len(key) - k)]
            a = a[key[a + k] - key[a] <= 3]
            if not len(a):
                break
            near.append(np.stack([a, a + k]))
        a, b = np.concatenate(near, axis=1) if near else np.zeros((2, 0), dtype=np.int64)
        may_join = (np.maximum(d0[a], d0[b]) - np.minimum(d1[a], d1[b]) <= GAP) & (np.maximum(i0[a], i0[b]) - np.minimum(i1[a], i1[b]) <= GAP)
        group = _components(len(whose), a[may_join], b[may_join])
        g0, g1 = _over(group, d0, d1)
        h0, h1 = _over(group, i0, i1)
        close = (g0[b] <= g1[a] + 4) & (g0[a] <= g1[b] + 4)
        a, b = a[close], b[close]

        # turns: a segment's end under or behind one group, a segment's start under or before another, at the same place of the item
        before = np.r_[0, np.cumsum(np.bincount(marks, minlength=len(line)))]
        low, high = before[g0 - EDGE], before[g1 + EDGE + 1]
        linked = (low < high) | (size >= COVERAGE * need)
        linked[a] = linked[b] = True
        some = np.flatnonzero(linked)  # nothing else can be linked to anything
        some = some[_dense(whose[some], h0[some], h1[some], need[some])]
        if not len(some):
            return
        number = np.full(len(whose), -1)
        number[some] = np.arange(len(some))
        a, b = number[a], number[b]
        a, b = a[(a >= 0) & (b >= 0)], b[(a >= 0) & (b >= 0)]
        low, n = low[some], high[some] - low[some]
        run = np.repeat(np.arange(len(n)), n)
        mark_no = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        m = marks[mark_no]
        spot = m - shift[some][run]
        base = spot - int(spot.min(initial=0)) + 4
        base += whose[some][run] * (int(base.max(initial=0)) + 4)
        starts, ends = np.flatnonzero(m < g1[some][run]), np.flatnonzero(m > g0[some][run])
        starts = starts[_order(base[starts])]
        keys, wanted = base[starts], base[ends]
        low = np.searchsorted(keys, wanted - 2)
        n = np.searchsorted(keys, wanted + 2, "right") - low
        e, s = np.repeat(ends, n), starts[np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())]
        on = mark_no[s] - mark_no[e]
        wide = (g1 - g0)[some] >= (8 if by_char else 24)
        linked = ((on >= 0) & (on < REACH)) | (wide[run[e]] & wide[run[s]])
        linked &= run[e] != run[s]
        chain = _components(len(some), np.r_[a, run[e[linked]]], np.r_[b, run[s[linked]]])
        kept = some[_dense(chain, h0[some], h1[some], need[some])]
        if not len(kept):
            return

        # of each pair that is kept, what is kept and all that shares letters of the page with it, or with what does
        pair, is_kept = np.zeros(len(offsets) * items, dtype=bool), np.zeros(len(whose), dtype=bool)
        pair[whose[kept]] = is_kept[kept] = True
        own = np.flatnonzero(pair[whose])
        own = own[np.lexsort((g0[own], whose[own]))]
        w = whose[own] * (len(line) + 1)
        reach = np.maximum.accumulate(w + g1[own])
        part = np.cumsum(np.r_[0, w[1:] + g0[own][1:] >= reach[:-1]])
        own = own[np.bincount(part, is_kept[own])[part] > 0]
        cuts = np.flatnonzero(np.r_[True, np.diff(whose[own]) != 0, True]).tolist()
        for x, y in zip(cuts, cuts[1:]):
            page, k = divmod(int(whose[own[x]]), items)
            mine_here = own[x:y]
            out.append((page, int(mine[k]), list(zip((d0[mine_here] - offsets[page]).tolist(), i0[mine_here].tolist(), size[mine_here].tolist(), strict=True))))


def _order(key: np.ndarray) -> np.ndarray:
    """What sorts numbers from 0 on, in their order where they are equal."""
    bits = len(key).bit_length()
    if int(key.max(initial=0)) >= 1 << (62 - bits):
        return np.argsort(key, kind="stable")
    packed = (key << bits) | np.arange(len(key))
    packed.sort()  # several times as fast as argsort
    return packed & ((1 << bits) - 1)


def _doubled(letters: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 8, 4, 2 and 1 letters from each place on; fewer at the end, where nothing is the same on two lines."""
    out, factor = [letters.astype(np.uint64)], _MULTIPLIER
    for step in (1, 2, 4):
        longer = out[0] * factor
        longer[:-step] += out[0][step:]
        out.insert(0, longer)
        with np.errstate(over="ignore"):
            factor = factor * factor
    return out


def _lengths(line: list[np.ndarray], letters: list[np.ndarray], d0: np.ndarray, i0: np.ndarray, tile: int) -> np.ndarray:
    """How far what begins at d0 of one line and i0 of the other, and is the same for a tile, stays the same; lines as `_doubled` gives them."""
    size, live = np.full(len(d0), tile), np.arange(len(d0))
    d, i = d0 + tile, i0 + tile
    while len(live):
        same = np.flatnonzero(line[0][d] == letters[0][i])
        live, d, i = live[same], d[same] + 8, i[same] + 8
        size[live] += 8
    d, i = d0 + size, i0 + size
    for step, x, y in zip((4, 2, 1), line[1:], letters[1:], strict=True):
        more = (x[d] == y[i]) * step
        d, i = d + more, i + more
    return d - d0


def _dense(owner: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Of each stretch of an item, whether its owner's stretches cover COVERAGE of some span of the least length.

    The letters under a chain of tiles lie in such stretches, its first and last one too, so no other owner has a chain that counts.
    A span loses nothing if it takes in the whole of the stretches in which it starts and ends: only starts and ends are tried.
    """
    covers = np.flatnonzero(np.bincount(owner, ends - begins)[owner] >= COVERAGE * least)  # else not even if none overlap
    out = np.zeros(len(owner), dtype=bool)
    if not len(covers):
        return out
    owner, begins, ends, least = owner[covers], begins[covers], ends[covers], least[covers]
    width = 2 * int(ends.max()) + int(least.max()) + 2  # owners on one line, so far apart that no span reaches over two
    key = owner * width + begins
    order = _order(key)
    key, own, least = key[order], owner[order], least[order]
    reach = np.maximum.accumulate(own * width + ends[order])
    first = np.flatnonzero(np.r_[True, key[1:] > reach[:-1]])
    start, stop, own, least = key[first], reach[np.r_[first[1:], len(key)] - 1], own[first], least[first]
    under = np.cumsum(stop - start)
    lowest = np.minimum.accumulate(under - (stop - start) - COVERAGE * start)  # falls from each owner to the next
    far = np.searchsorted(start, stop - least, "right") - 1  # the last start that is far enough behind
    enough = (far >= 0) & (own[far] == own) & (under - COVERAGE * stop - lowest[far] >= -0.01)
    some = np.zeros(int(owner.max()) + 1, dtype=bool)
    some[own[enough]] = True
    out[covers] = some[owner]
    return out


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of 0..n-1 is connected to over edges a-b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (label[label] != label).any():
            label = label[label]
        differ = label[a] != label[b]
        a, b = a[differ], b[differ]
    return label


def _over(group: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least begin and the greatest end in each one's group, which is named by its first."""
    low, high = begins.copy(), ends.copy()
    rest = np.flatnonzero(group != np.arange(len(group)))
    np.minimum.at(low, group[rest], begins[rest])
    np.maximum.at(high, group[rest], ends[rest])
    return low[group], high[group]


def search(index: Index, texts: list[str | None]) -> list[list[tuple[int, int, bool]]]:
    """For each text, (item id, words or characters found, counted in characters) of every item of which it may hold the least length that counts."""
    out: list[list[tuple[int, int, bool]]] = [[] for _ in texts]
    held: list[tuple[int, Page]] = []
    letters, most = 0, max(1, PAIRS // max(1, len(index.items)))
    for t, text in enumerate(texts):
        page = make_page(text) if text else None
        if page is not None and len(page.letters):
            held.append((t, page))
            letters += len(page.letters)
        if held and (letters >= LETTERS or len(held) >= most or t == len(texts) - 1):
            pairs = [(held[p], index.items[k], found) for p, k, found in index.pairs([page for _, page in held])]
            jobs = [(mark(joined(found, page, item), TILE[item.unspaced], len(page.letters)), page, item) for (_, page), item, found in pairs]
            for ((at, _), item, _), (begin, end, _, _) in zip(pairs, all_chains(jobs), strict=True):
                if n := words_under(item, begin, end):
                    out[at].append((item.item_id, n, item.unspaced))
            held, letters = [], 0
    return out


#: The index that this Python worker built last, by the name of its block.
_BUILT: dict[str, Index] = {}
FOUND = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("n_shared", T.IntegerType()), T.StructField("in_chars", T.BooleanType())])


def shared_passages(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, n_shared (words, or characters where in_chars) for all documents and items with a common chain of tiles, if it may be of the least length.

    Items go to the executors in blocks of at most `block` items and about BLOCK_LETTERS letters in all (both counted), each against whole texts of all documents; documents are never shuffled. A worker builds the index of a block once. Null or empty
    texts share nothing. Repeated documents or items give repeated rows.
    """
    spark, out = documents.sparkSession, None
    numbered = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).where("text <> ''")
    n, size = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // block), -(-size // BLOCK_LETTERS))
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    pages = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("text <> ''")
    for b in range(blocks):
        own = [(r[0], r[1]) for r in numbered.where(share == b).collect()]
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, own))

        def find(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            name, own = sent.value
            if name not in _BUILT:
                _BUILT.clear()
                _BUILT[name] = Index([make_item(a, t) for a, t in own])
            for batch in batches:
                rows = [(d, *hit) for d, hits in zip(batch["doc_id"], search(_BUILT[name], batch["text"].tolist()), strict=True) for hit in hits]
                yield pd.DataFrame(rows, columns=FOUND.fieldNames())

        found = pages.mapInPandas(find, FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(found: DataFrame, min_words: int = MIN_WORDS, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, item_id of what shares at least so many words or characters in reading order."""
    return found.where(F.col("n_shared") >= F.when(F.col("in_chars"), min_chars).otherwise(min_words)).select("doc_id", "item_id").distinct()
