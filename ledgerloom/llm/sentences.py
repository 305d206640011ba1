"""Sentence units of scanned pages in many scripts.

Every mark that may end a sentence, every blank of a script that parts statements by blanks, and every line that ends short or in
capitals without a mark, as headlines do, is a candidate. What follows it is looked up
in reading order: in the same printed segment, or in the next segment of the same column. A maximum-entropy model judges the
candidates by the tokens beside them, their case, length, digits and script, the marks and the closing quotes. It is trained
on candidates whose nature is plain from their surroundings (a small letter behind a full stop, a long small word before one and a capital
behind it), from a bounded sample of documents; the words that open sentences or follow ordinals are counted in all documents, and everything else
is done for whole texts of all documents.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents that the model is trained on, taken by the order of a hash of their id.
TRAIN_DOCS = 2000
#: Times that a word must open sentences, or follow ordinals, to count as one that does.
LEAST = 3
#: Different words that a task counts before it hands them on.
HELD = 200_000
BITS = 17
MASK = (1 << BITS) - 1
#: Features of a candidate, and the number that fills up fewer; its weight is always 0.
WIDTH, PAD = 15, 1 << BITS
#: Letters on either side of a mark that its features are taken from.
NEAR = 400
#: Log-odds of the plain reading of an end without a mark, before anything is learnt.
PRIOR = 2.0

# Marks and scripts.
ENDS = ".!?。！？．।॥؟۔·•"
PLAIN_ENDS = "!?。！？।॥؟۔"
CLOSERS = "”\"“»«」』)）’"
OPENERS = "“„«「『(¿¡\"‘"
_CANDIDATE = re.compile(rf"[{ENDS}]+(?:[  ]?»|[”\"“」』)）’])*|,[”\"“]?(?=\s+[„“«¿¡\"]?[^\W\d_])")
_PLAIN_END = re.compile(f"[{PLAIN_ENDS}]")
_RULE = re.compile(r"[\W_]*\Z")
_GAP = re.compile(r" {2,}| \| |\t+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_INNER_CAPITAL = re.compile(r"(?<=[a-zß-öø-ÿа-яё] )[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W_]*")
_AFTER_ORDINAL = re.compile(r"(?<=\d\.)[ \n]([A-ZÀ-ÖØ-ÞА-ЯЁ][^\W_]*)")
_CAPITAL = re.compile(r"\b[A-ZÀ-ÖØ-ÞА-ЯЁ][^\W_]*")
_THAI_BLANK = re.compile(r"(?<=\S) (?=\S)")


@dataclass(slots=True)
class Segment:
    """A printed line, or the part of one that belongs to one column."""

    start: int
    end: int
    line: int
    column: int
    x0: int
    following: int = -1
    short: bool = False
    caps: bool | None = None
    rule: bool = False


@dataclass(slots=True)
class Candidate:
    end: int
    features: list[int] = field(default_factory=list)
    label: int = -1
    kind: str = "mark"
    opens: str = ""
    prior: float = 0.0


_SCRIPTS = ((0x400, 0x500, "cyr"), (0x600, 0x700, "ar"), (0x900, 0x980, "hi"), (0xE00, 0xE80, "th"), (0x3040, 0x3100, "cjk"), (0x3400, 0xA000, "cjk"))


def script_of(text: str) -> str:
    chars = text[:: max(1, len(text) // 150)]
    if not chars or max(chars) < "\u0400":
        return "lat" if any(map(str.isalpha, chars)) else "th"
    chars, at = sorted(chars), 0
    counts = {"th": 0, "cjk": 0, "hi": 0, "ar": 0, "cyr": 0, "lat": 0}
    for low, high, script in _SCRIPTS:
        begin = bisect_left(chars, chr(low), at)
        counts["lat"] += sum(map(str.isalpha, chars[at:begin]))
        at = bisect_left(chars, chr(high), begin)
        counts[script] += at - begin
    counts["lat"] += sum(map(str.isalpha, chars[at:]))
    return max(counts, key=lambda k: (counts[k], k))


def _is_caps(words: str) -> bool:
    if 6 * sum(map(str.islower, words[:24])) > len(words):  # more small letters than all others could make up for
        return False
    up = sum(map(str.isupper, words))
    return up >= 4 and up >= 6 * sum(map(str.islower, words))


def segments_of(text: str, boxes) -> list[Segment]:
    """Printed segments with the one that follows each in its column."""
    out: list[Segment] = []
    at = 0
    lines = text.split("\n")
    bare = [line.strip() for line in lines]
    gaps = sum(1 for line in bare if "  " in line or " | " in line or "\t" in line)  # as _GAP finds them
    columns = gaps >= 3 and 4 * gaps >= len(lines)  # else wide blanks are no columns
    for n, line in enumerate(lines):
        if not columns and not bare[n]:
            at += len(line) + 1
            continue
        x0 = -1
        if boxes is not None and n < len(boxes) and boxes[n] is not None and boxes[n]["x0"] is not None:
            x0 = int(boxes[n]["x0"])
        begin, column = 0, 0
        for gap in _GAP.finditer(line) if columns else ():
            if gap.start() > begin:
                out.append(Segment(at + begin, at + gap.start(), n, column, x0))
                column += 1
            begin = gap.end()
        if line[begin:].strip():
            out.append(Segment(at + begin, at + len(line.rstrip()), n, column, x0))
        at += len(line) + 1
    waiting: dict[tuple[int, int], int] = {}
    longest: dict[tuple[int, int], int] = {}
    for k, s in enumerate(out):
        s.rule = not text[s.start].isalnum() and bool(_RULE.match(text[s.start : s.end]))
        spot = (s.column, round(s.x0 / 150) if s.x0 >= 0 else -1) if s.column == 0 else (s.column, 0)
        if not s.rule:
            if spot in waiting:
                out[waiting[spot]].following = k
            waiting[spot] = k
        if s.end - s.start > longest.get(spot, 0):
            longest[spot] = s.end - s.start
        s.column = spot  # type: ignore[assignment]
    for s in out:
        s.short = (s.end - s.start) < 0.72 * longest[s.column]  # type: ignore[index]
    return out


def _in_caps(text: str, s: Segment) -> bool:
    """Whether a segment is in capitals; looked at only where it is asked for."""
    if s.caps is None:
        s.caps = _is_caps(text[s.start : s.end])
    return s.caps


def _case(ch: str) -> str:
    return "U" if ch.isupper() else "l" if ch.islower() else "d" if ch.isdigit() else "o" if ch.isalpha() else "m" if ch else ""


def _joined_next(text: str, segments: list[Segment], k: int, width: int = 60) -> str:
    """Text that follows segment k in reading order."""
    n = segments[k].following
    if n < 0:
        return ""
    return text[segments[n].start : min(segments[n].end, segments[n].start + width)]


def candidates(text: str, boxes, starters: frozenset[str] = frozenset(), followers: frozenset[str] = frozenset(), plain: bool = False) -> list[Candidate]:
    """All candidates of a text, marks and ends without a mark, in the order of lines.

    starters: words that begin sentences; followers: words that stand behind ordinal numbers, as months do.
    plain: leave out full stops before small letters and digits, which end nothing and are of use in training only.
    """
    script = script_of(text)
    segments, out = segments_of(text, boxes), []
    for k, s in enumerate(segments):
        if s.rule:
            continue
        words = text[s.start : s.end]
        for m in _CANDIDATE.finditer(words):
            c = _mark(text, words, segments, k, m, script, starters, followers, plain)
            if c is not None:
                out.append(c)
        if script == "th":
            out += [_thai_blank(words, s.start, m.start()) for m in _THAI_BLANK.finditer(words)]
            if text[s.end : s.end + 2] == " \n":
                out.append(_end(s.end - 1, ("Tb", f"Te{words[-1].isdigit()}", f"Tp{words[-1]}"), not words[-1].isdigit()))
        if words[-1] not in ENDS and not (words[-1] in CLOSERS and words[-2:-1] and words[-2] in ENDS):
            c = _line_end(text, words, segments, k, script)
            if c is not None:
                out.append(c)
    return out


def _end(end: int, names: tuple[str, ...], plain: bool) -> Candidate:
    """A candidate without a mark; its surroundings are plain enough to train on."""
    return Candidate(end, [crc32(x.encode()) & MASK for x in names] + [PAD] * (WIDTH - len(names)), int(plain), "end", prior=PRIOR if plain else -PRIOR)


def _thai_blank(words: str, start: int, at: int) -> Candidate:
    """A blank between two statements, or beside figures, where it parts nothing."""
    left, right = words[at - 1], words[at + 1 : at + 2]
    before, after = at - 1 - words.rfind(" ", 0, at), words.find(" ", at + 1)
    sides = f"{'d' if left.isdigit() or left in ',.' else _case(left)}{_case(right)}"
    names = ("Tb", f"Ts{sides}", f"Tl{min(before // 4, 6)}{sides}", f"Tr{min((after - at - 1) // 4, 6) if after > 0 else 9}{sides}", f"Tp{left}", f"Tn{right}")
    return _end(start + at - 1, names, "d" not in sides)


def _line_end(text: str, words: str, segments: list[Segment], k: int, script: str) -> Candidate | None:
    """A line without a mark at its end, short or in capitals: a headline, a passage that was cut off, or the middle of a sentence."""
    s = segments[k]
    nxt = segments[s.following] if s.following >= 0 else None
    cased, last = script in ("lat", "cyr"), script == "th" and k == len(segments) - 1
    caps = _in_caps(text, s)
    if not (caps or s.short or last) or (not caps and words[-1] in "-=¬‐­,;:–—"):
        return None
    lead = text[nxt.start : nxt.start + 40].lstrip(OPENERS + " ")[:1] if nxt is not None else ""
    place = "n" if nxt is None else "s" if nxt.line == s.line else "f" if nxt.line == s.line + 1 else "o"
    nc, tail, brief = _case(lead), _case(words[-1]), len(words) <= 3
    if caps:
        more = nxt is not None and _in_caps(text, nxt)
        plain = not (more and place == "f" and not s.short)
        state = f"C{more}{place}{s.short}"
    elif cased:
        plain = (nxt is None or (lead.isupper() and place != "s")) and words[-1].isalpha() and not brief
        state = f"L{place}{nc}{tail}{brief}"
    else:
        plain = last or place != "s"
        state = f"O{last}{place}"
    names = ("Eb", f"E{state}", f"E{state}{script}", f"Es{script}{s.short}{caps}", f"Ew{min(words.count(' '), 8)}{cased}", f"El{min(len(words) // 8, 9)}{cased}", f"En{nc}{cased}", f"Et{tail}{cased}")
    return _end(s.end - 1, names, plain)


#: Features of marks but those of the words beside them, by the state that they are taken from.
_FIXED: dict[tuple, tuple[int, ...]] = {}


def _fixed(*state) -> tuple[int, ...]:
    mark, q, script, nc, pc, size, inner, dash, initial, glued, speech, short, eol, first, ordinal, brief = state
    group, e = "s" if mark in PLAIN_ENDS else ".", "e" if eol else "i"
    names = (
        "bias" + group + q,
        f"m{mark}{q}{script}" if mark != "," else f"m.{q}{script}",
        f"c{pc}{nc}{group}{q}{e}",
        f"l{size}{pc}{nc}{group}{q}",
        f"i{inner}{nc}{group}",
        f"d{dash}{nc}{q}",
        f"t{initial}{group}",
        f"g{glued}{nc}{group}",
        f"s{speech}{nc}{script}",
        f"h{short}{eol}{group}{q}",
        f"b{first}{pc}{nc}{group}{q}",
        f"b{first}{size}{pc}{inner}{group}",
        f"o{ordinal}{brief}{group}",
    )
    if len(_FIXED) >= 50_000:
        _FIXED.clear()
    _FIXED[state] = out = tuple(crc32(x.encode()) & MASK for x in names)
    return out


def _mark(text: str, words: str, segments: list[Segment], k: int, m: re.Match, script: str, starters: frozenset[str], followers: frozenset[str], plain: bool) -> Candidate | None:
    s = segments[k]
    run = m.group()
    comma = run[0] == ","
    if len(run) == 1:
        mark, closers = run, ""
    else:
        marks = run[0] if comma else run[: len(run) - len(run.lstrip(ENDS))]
        closers = run[len(marks) :].strip()
        if not comma and len(marks) > 1 and not any(c in PLAIN_ENDS for c in marks):
            return None  # an ellipsis
        mark = "," if comma else next((c for c in marks if c in PLAIN_ENDS), marks[-1])
    at, end = m.span()
    here = words[end : end + NEAR].strip() or words[end:].strip()
    eol = not here
    if plain and not eol and not comma and script in ("lat", "cyr") and mark not in PLAIN_ENDS and (here[0].islower() or here[0].isdigit()):
        return None
    if comma and not (starters and here.lstrip(OPENERS + " ")[:1].isupper()):
        return None
    glued = end < len(words) and not words[end].isspace()
    if len(here) < 30:
        here = (here + " " + _joined_next(text, segments, k)).strip()
    prev = words[max(0, at - 24) : at]
    tail = prev[-1:]
    if mark not in PLAIN_ENDS:
        if eol and here[:2] in ("..", "·.", ".·") or here[:1] == "…":
            return None
        if tail.isdigit() and here[:1].isdigit() and glued and not eol:
            return None
        if script == "cjk" and not closers and tail.isascii():
            return None
        if here[:1] and here[0] in ".,;:)&…·-–" and not eol:
            return None
        if script == "hi" and mark == ".":
            return None
    lead = here.lstrip(OPENERS + " —–-") if not comma else here.lstrip(OPENERS + " ")
    dash = here[:1] in ("—", "–")
    next_word = _WORD.match(lead)
    nw = next_word.group() if next_word else ""
    if script == "cjk":
        nw = lead[:1]
    elif script == "th":
        nw = lead[:3]
    first, nc = nw in starters, _case(lead[:1])
    if comma and not (first and nc == "U"):
        return None
    initial = len(nw) == 1 and nw.isupper() and lead[1:2] == "."
    pw = prev[max(prev.rfind(" "), prev.rfind("\n")) + 1 :].strip(OPENERS + "()[]")
    inner = "." in pw[:-1] if pw else False
    if pw.isalnum():
        last = pw
    else:
        letters = _WORD.findall(pw)
        last = letters[-1] if letters else pw
    if k > 0 and not prev.strip() and not words[:at].strip():
        last = ""
    pc = _case(last[:1])
    if comma and pc != "l":
        return None
    size = min(len(last), 7)
    speech = ""
    if closers and script in ("cjk", "hi", "ar", "th"):
        far = re.search(rf"[{ENDS}]", lead[2:40])
        speech = "near" if far and far.start() < 22 else "far"
        if script == "cjk":
            opened = text.rfind("「", 0, s.start + m.start())
            speech += ":" if opened > 0 and text[opened - 1] in "：:" else "-"
    ordinal = tail.isdigit() and nw in followers
    brief = False
    if inner and not eol:
        stop = max(words.rfind(x, 0, m.start()) for x in (". ", "! ", "? ", "” ", '" '))
        brief = stop >= 0 and len(words[stop + 2 : m.start()].split()) <= 3
    q = "q" if closers else "-"
    state = (mark, q, script, nc, pc, size, inner, dash, initial, glued, speech, s.short, eol, first, ordinal, brief)
    fixed = _FIXED.get(state)
    if fixed is None:
        fixed = _fixed(*state)
    group = "s" if mark in PLAIN_ENDS else "."
    c = Candidate(s.start + end - 1, [fixed[0], fixed[1], crc32(f"p{last.lower()}{group}{q}".encode()) & MASK, crc32(f"n{nw.lower()[:10]}{nc}{q}".encode()) & MASK, *fixed[2:]])
    c.kind = "comma" if comma else "mark"
    c.opens = nw if nc == "U" and group == "s" and not closers else ""
    nextish = not eol
    cased = script in ("lat", "cyr")
    if comma or plain:  # no label is asked for
        return c
    if cased:
        if group == "." and (ordinal or brief):
            c.label = 0
        elif group == "." and size == 1 and pc == "U" and nc in ("U", ""):
            c.label = 0
        elif group == "." and eol and (s.short or (size >= 5 and pc != "d")) and (nc in ("l", "") or first or (nc in ("d", "U") and pc == "l" and size >= 5 and not initial)):
            c.label = 1
        elif group == "." and starters and nextish and pc == "l" and size <= 2 and not inner and nc == "U" and not first:
            c.label = 0
        elif group == "." and inner and nextish and pc == "l" and nc == "U" and not initial:
            c.label = 1
        elif group == "." and followers and nextish and pc == "d" and nc == "U":
            c.label = 1
        elif nextish and nc in ("l", "d") and not (group == "s" and not closers):
            c.label = 0
        elif nextish and dash and closers:
            c.label = 0
        elif group == "." and first and nc == "U":
            c.label = 1
        elif group == "." and starters and nextish and nc == "U" and pc == "U" and size <= 4:
            c.label = 0
        elif group == "." and (initial or (size == 1 and pc == "U" and nc == "U")) and nextish:
            c.label = 0
        elif group == "s" and nextish and nc == "U":
            c.label = 1
        elif group == "s" and not closers:
            c.label = 1
        elif group == "." and nextish and nc == "U" and pc == "l" and size >= 4 and not inner:
            c.label = 1
    elif script == "cjk":
        if closers and lead[:1] == "と":
            c.label = 0
        elif closers and speech:
            c.label = 1 if speech.endswith(":") else 0
        elif group == "s":
            c.label = 1
    elif group == "s":
        c.label = (0 if speech == "near" else 1) if closers else 1
    else:
        c.label = 0 if size <= 2 else 1
    return c


@dataclass
class Model:
    weights: np.ndarray
    starters: frozenset[str] = frozenset()
    followers: frozenset[str] = frozenset()

    def score(self, found: list[Candidate]) -> np.ndarray:
        return self.weights[np.array([c.features for c in found], dtype=np.int64)].sum(axis=1) + np.array([c.prior for c in found])


def fit(found: list[Candidate], rounds: int = 120, rate: float = 0.5, decay: float = 1e-5) -> Model:
    """Maximum entropy over binary features by adaptive full-batch ascent; the same candidates give the same weights."""
    labelled = [c for c in found if c.label >= 0]
    weights = np.zeros(PAD + 1)
    if not labelled:
        return Model(weights)
    x = np.array([c.features for c in labelled], dtype=np.int64)
    y = np.array([c.label for c in labelled], dtype=np.float64)
    prior = np.array([c.prior for c in labelled])
    flat, squares = x.ravel(), np.full(PAD + 1, 1e-8)
    for _ in range(rounds):
        error = y - 1 / (1 + np.exp(-np.clip(weights[x].sum(axis=1) + prior, -30, 30)))
        gradient = np.bincount(flat, np.repeat(error, x.shape[1]), PAD + 1) / len(y) - decay * weights
        squares += gradient * gradient
        weights += rate * gradient / np.sqrt(squares)
        weights[PAD] = 0.0
    return Model(weights)


def openings(text: str, boxes) -> list[str]:
    """Capitalised words that follow ! and ?, as `opens` of all candidates of a text, without judging the rest."""
    if (text + "a").islower() or not _PLAIN_END.search(text):  # no capital anywhere
        return []
    segments, out = segments_of(text, boxes), []
    for k, s in enumerate(segments):
        if s.rule:
            continue
        words = text[s.start : s.end]
        if not _PLAIN_END.search(words):
            continue
        script = ""
        for m in _CANDIDATE.finditer(words):
            run = m.group()
            marks = run[: len(run) - len(run.lstrip(ENDS))]
            if not any(c in PLAIN_ENDS for c in marks) or run[len(marks) :].strip():
                continue
            here = words[m.end() :].strip()
            if len(here) < 30:
                here = (here + " " + _joined_next(text, segments, k)).strip()
            lead = here.lstrip(OPENERS + " —–-")
            if lead[:1].isupper():
                script = script or script_of(text)
                next_word = _WORD.match(lead)
                word = lead[:1] if script == "cjk" else lead[:3] if script == "th" else next_word.group() if next_word else ""
                if word:
                    out.append(word)
    return out


def count_words(texts) -> tuple[Counter, Counter, Counter, Counter]:
    """Of (text, boxes) pairs: words that follow ! and ?, capitals within sentences, words behind ordinals, and all capitals."""
    opening, inside, behind, capitals = Counter(), Counter(), Counter(), Counter()
    for text, boxes in texts:
        opening.update(openings(text, boxes))
        if (text + "a").islower():  # no capital anywhere
            continue
        inside.update(_INNER_CAPITAL.findall(text))
        behind.update(_AFTER_ORDINAL.findall(text))
        capitals.update(_CAPITAL.findall(text))
    return opening, inside, behind, capitals


def learn(texts: list[tuple], words: tuple[frozenset[str], frozenset[str]] | None = None) -> Model:
    """A model from (text, boxes) pairs. words: starters and followers; without them they are counted in the same texts."""
    if words is None:
        opening, inside, behind, capitals = count_words(texts)
        starters = frozenset(w for w, n in opening.items() if n >= LEAST and n > inside[w])
        words = starters, frozenset(w for w, n in behind.items() if n >= LEAST and 2 * n > capitals[w])
    model = fit([c for text, boxes in texts for c in candidates(text, boxes, *words)])
    return Model(model.weights, *words)


def boundaries(model: Model, text: str | None, boxes=None) -> list[int]:
    """Offsets of the last characters of all units of a text, in order; none for null, empty or wordless texts."""
    if not text or not text.strip():
        return []
    found = candidates(text, boxes, model.starters, model.followers, True)
    if not found:
        return []
    scores = model.score(found)
    return sorted({c.end for c, score in zip(found, scores.tolist(), strict=True) if score > 0})


UNITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("end_offset", T.IntegerType())])


WORD_COUNTS = "word string, opening long, inside long, behind long, capitals long"


def _bare(x0) -> list | None:
    return None if x0 is None else [{"x0": None if x is None or x != x else x} for x in x0]


def common_words(documents: DataFrame, text: str = "text", boxes: str | None = "line_boxes") -> tuple[frozenset[str], frozenset[str]]:
    """Starters and followers, from all documents. Counts are summed in the tasks first; the driver is sent only words that pass."""
    rows = documents.select(F.col(text).alias("text"), (F.transform(boxes, lambda b: b["x0"]) if boxes else F.lit(None).cast("array<int>")).alias("x0")).where("text <> ''")

    def frame(counts: tuple[Counter, ...]) -> pd.DataFrame:
        words = list(set().union(*counts))
        return pd.DataFrame({"word": pd.Series(words, dtype="object")} | {c: pd.Series([n[w] for w in words], dtype="int64") for c, n in zip(("opening", "inside", "behind", "capitals"), counts, strict=True)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = count_words(())
        for batch in batches:
            for total, more in zip(held, count_words((t, _bare(x0)) for t, x0 in zip(batch["text"], batch["x0"], strict=True)), strict=True):
                total.update(more)
            if sum(map(len, held)) > HELD:
                yield frame(held)
                held = count_words(())
        yield frame(held)

    sums = rows.mapInPandas(count, WORD_COUNTS).groupBy("word").agg(*[F.sum(c).alias(c) for c in ("opening", "inside", "behind", "capitals")])
    starts, follows = (F.col("opening") >= LEAST) & (F.col("opening") > F.col("inside")), (F.col("behind") >= LEAST) & (2 * F.col("behind") > F.col("capitals"))
    passed = sums.select("word", starts.alias("starts"), follows.alias("follows")).where("starts or follows").collect()
    return frozenset(r["word"] for r in passed if r["starts"]), frozenset(r["word"] for r in passed if r["follows"])


def train(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes", limit: int = TRAIN_DOCS) -> Model:
    """A model whose weights are fitted to at most `limit` documents, those with the smallest hashes of their id up to a bound that lets 0.9 x limit through.

    Starters and followers are counted in all documents. The driver is sent no more than those words and that sample.
    """
    columns = [F.col(text).alias("text"), (F.col(boxes) if boxes else F.lit(None)).alias("boxes")]
    written = documents.where(F.col(text) != "")
    n = written.select(F.count(F.lit(1))).first()[0]
    share = F.pmod(F.xxhash64(doc_id), F.lit(1 << 40))
    if n > limit:
        written = written.where(share < int((1 << 40) * 0.9 * limit / n))
    sample = sorted(written.select(F.col(doc_id).alias("id"), *columns).limit(limit).collect(), key=lambda row: (row["id"], row["text"]))
    return learn([(row["text"], row["boxes"]) for row in sample], common_words(documents, text, boxes))


def sentence_ends(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", boxes: str | None = "line_boxes") -> DataFrame:
    """doc_id, end_offset: one row per unit of every document. Null and empty texts have none; repeated rows repeat their units.

    Boxes may be null or fewer than lines; the text then stands for the column order.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model)  # 1 MB
    rows = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), (F.transform(boxes, lambda b: b["x0"]) if boxes else F.lit(None).cast("array<int>")).alias("x0")).where("text <> ''")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for batch in batches:
            ids, ends = [], []
            for d, t, x0 in zip(batch["doc_id"], batch["text"], batch["x0"], strict=True):
                found = boundaries(model, t, _bare(x0))
                ids += [d] * len(found)
                ends += found
            yield pd.DataFrame({"doc_id": pd.Series(ids, dtype="int64"), "end_offset": pd.Series(ends, dtype="int32")})

    return rows.mapInPandas(cut, UNITS)
