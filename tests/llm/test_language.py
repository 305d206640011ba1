"""Groups, packing, leaks and sentences, against plain Python, round trips and held-out cases."""

import random
from collections import defaultdict

import pytest

from ledgerloom.llm import components, leakage, packing, sentences


# ---- groups
def _groups(pairs):
    near = defaultdict(set)
    for a, b in pairs:
        if a and b and a != b:
            near[a].add(b)
            near[b].add(a)
    out = {}
    for start in sorted(near):
        if start not in out:
            todo = [start]
            while todo:
                n = todo.pop()
                if n not in out:
                    out[n] = start
                    todo += near[n]
    return out


def _random_pairs(seed):
    rng = random.Random(seed)
    chain = [f"c{i:03d}" for i in rng.sample(range(300), 120)]
    pairs = list(zip(chain, chain[1:]))
    pairs += [("hub", f"z{i}") for i in range(80)]
    pairs += [(f"r{rng.randrange(90)}", f"r{rng.randrange(90)}") for _ in range(70)]
    return pairs + [(None, "x"), ("x", None), ("", "y"), ("s", "s")] + pairs[:20] + [(b, a) for a, b in pairs[:20]]


@pytest.mark.parametrize("small", [True, False])
def test_groups(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(components, "SMALL_ROWS", 0)
    for seed in (1, 2):
        pairs = _random_pairs(seed)
        got = components.groups(spark.createDataFrame([(*p, 1) for p in pairs], "l string, r string, node int"), "l", "r").collect()
        assert {r["node"]: r["group"] for r in got} == _groups(pairs) and len(got) == len(_groups(pairs))


def test_groups_of_nothing(spark):
    empty = spark.createDataFrame([], "l string, r string")
    assert components.groups(empty, "l", "r").count() == 0
    assert components.groups(spark.createDataFrame([("a", "a")], "l string, r string"), "l", "r").count() == 0


# ---- packing
@pytest.mark.parametrize("rows_per_partition", [50, 10_000])
def test_packing(spark, rows_per_partition):
    rng = random.Random(4)
    docs = [(i, rng.choice(["big", "big", "big", "small", None, ""]), rng.choice([rng.randrange(1, 400), rng.randrange(1, 400), 2048, 5000, 0])) for i in range(600)] + [(1000, "big", None), (1, "big", 7)]
    df = spark.createDataFrame([(*d, "x") for d in docs], "id long, source string, n int, container string")
    got = packing.pack(df, "id", "source", "n", rows_per_partition=rows_per_partition).collect()
    fills, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        fills[r["container"]] += r["n_tokens"]
        pieces[r["key"]].append((r["token_start"], r["n_tokens"]))
    assert max(fills.values()) <= 2048
    for i, _, n in docs[1:-2]:
        if i != 1:
            at = 0
            for start, size in sorted(pieces.get(i, [])):
                assert start == at
                at += size
            assert at == n and len(pieces.get(i, [])) == -(-n // 2048)
    assert sum(fills.values()) == sum(n or 0 for _, _, n in docs)
    assert len(fills) <= -(-sum(fills.values()) // 2048) * 1.05 + 2
    assert packing.pack(df.limit(0), "id", "source", "n").count() == 0


def test_windows_keep_the_mixture():
    queues = {"a": [(i, 0, 100) for i in range(3000)], "b": [(i, 0, 100) for i in range(1000)]}
    placed = packing.fill({k: list(v) for k, v in queues.items()}, {"a": 0.0, "b": 0.0}, {"a": 0.75, "b": 0.25}, 2048, 8)
    assert len(placed) == 4000


def _shares_by_window(rows):
    sums = defaultdict(lambda: defaultdict(int))
    for w, source, n in rows:
        sums[w][source] += n
    return sums


def test_shipped_windows_keep_to_the_targets():
    rng = random.Random(3)
    share = {"a": 0.6, "b": 0.3, "c": 0.1}
    queues = {s: [((s, i), 0, rng.randrange(1, 1500)) for i in range(n)] for s, n in (("a", 2400), ("b", 1200), ("c", 400))}
    placed = packing.fill(queues, dict.fromkeys(share, 0.0), share, 2048, 16)
    assert sorted((p[0], p[2]) for p in placed) == sorted((i[0], i[2]) for q in queues.values() for i in q)
    windows = _shares_by_window((p[4], p[0][0], p[2]) for p in placed if p[5])
    total, run = 0, defaultdict(int)
    for w in sorted(windows)[:-3]:  # until a source runs out
        total += sum(windows[w].values())
        for s in share:
            run[s] += windows[w][s]
            # never further from its share than what one window may hold back, however many windows there were
            assert abs(run[s] - share[s] * total) <= 4 * 2048
    fills = defaultdict(int)
    for p in placed:
        fills[p[3]] += p[2]
    assert max(fills.values()) <= 2048 and all(fills[p[3]] >= packing.CLOSED_FROM * 2048 for p in placed if p[5])


def test_equal_lengths_are_mixed_within_containers():
    queues = {"a": [(i, 0, 100) for i in range(3000)], "b": [(3000 + i, 0, 100) for i in range(1000)]}
    inside = defaultdict(set)
    for p in packing.fill(queues, {"a": 0.0, "b": 0.0}, {"a": 0.75, "b": 0.25}, 2048, 8):
        inside[p[3]].add("a" if p[0] < 3000 else "b")
    assert sum(len(s) == 2 for s in inside.values()) >= 0.9 * len(inside)


def test_targets_hold_over_partitions_and_no_text_is_lost(spark):
    rng = random.Random(5)
    docs = [(i, "x" if i % 2 else "y", rng.randrange(1, 900)) for i in range(3000)] + [(5000, "z", 5000), (5001, None, 3)]
    df = spark.createDataFrame(docs, "id long, source string, n int")
    got = packing.pack(df, "id", "source", "n", window=8, rows_per_partition=1000, targets={"x": 3, "y": 1}).collect()
    assert sum(r["n_tokens"] for r in got) == sum(d[2] for d in docs)
    windows = _shares_by_window((r["window"], r["source"], r["n_tokens"]) for r in got if r["window"].startswith("w"))
    for part in {k.rpartition("-")[0] for k in windows}:
        x = total = 0
        for n in range(6):  # until x runs out
            w = windows[f"{part}-{n}"]
            x, total = x + w["x"], total + w["x"] + w["y"]
            assert total and abs(x - 0.75 * total) <= 4 * 2048
        assert abs(x / total - 0.75) < 0.06


def test_tokens(spark):
    from pathlib import Path

    path = Path("/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
    if not path.exists():
        pytest.skip("no tokenizer files")
    df = spark.createDataFrame([("hello world",), ("",), (None,), ("word " * 20_000,)], "t string")
    got = [r["n_tokens"] for r in packing.count_tokens(df, "t", str(path)).collect()]
    assert got[0] >= 2 and got[1] == got[2] == 0 and got[3] >= 20_000


# ---- leaks
WORDS = "the of old new river bridge council harbour school market engine garden lamp tower wagon canal museum bakery ledger quarry steamer parade orchard museum".split()


def _passage(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "ton", "ley", "ford"]) for _ in range(n)) + "."


def test_leaks(spark):
    rng = random.Random(6)
    items = [(i, _passage(rng, 40)) for i in range(12)]
    other = [_passage(rng, 60) for _ in range(40)]

    def noisy(text):
        return "".join({"e": "c", "i": "l", "u": "n"}.get(c, c) if rng.random() < 0.05 else c for c in text)

    def lines(text, width=6):
        words = text.split()
        return [" ".join(words[i : i + width]) for i in range(0, len(words), width)]

    docs, want = [], set()
    for d in range(40):
        item, text = rng.choice(items), other[d]
        words = item[1].split()
        if d % 4 == 0:  # within other text, broken and misread
            text = "\n".join(lines(text + " " + noisy(" ".join(words[5:30])) + " " + other[0]))
        elif d % 4 == 1:  # alternating columns
            a, b = lines(item[1]), lines(other[d])
            text = "\n".join(x for pair in zip(a, b, strict=False) for x in pair)
        elif d % 4 == 2:  # too short
            text = "\n".join(lines(text + " " + " ".join(words[5:15]) + " " + other[1]))
        docs.append((d, text, "x"))
        if d % 4 < 2:
            want.add((d, item[0]))
    docs += [(100, None, "x"), (101, "", "x"), (102, "...", "x"), (103, other[2] + " " + "river " * 30_000, "x"), (104, items[0][1], "x"), (104, items[0][1], "x")]
    want |= {(104, 0)}
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    its = spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    for block in (20_000, 5):
        got = {tuple(r) for r in leakage.leaks(leakage.shared_passages(df, its, block=block)).collect()}
        assert got == want
    assert leakage.shared_passages(df.limit(0), its).count() == 0
    assert leakage.leaks(leakage.shared_passages(df, its.limit(0))).count() == 0


def test_unspaced_leak(spark):
    rng = random.Random(8)
    signs = [chr(0x4E00 + i) for i in range(300)]
    item = "".join(rng.choice(signs) for _ in range(60))
    noise = ["".join(rng.choice(signs) for _ in range(50)) for _ in range(3)]
    docs = [(1, noise[0] + "\n" + item[10:45] + "\n" + noise[1]), (2, noise[0] + item[10:30] + noise[2])]
    got = leakage.leaks(leakage.shared_passages(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))).collect()
    assert [tuple(r) for r in got] == [(1, 7)]


def _every_pair(items, texts):
    """Words found by tiling all pages with all items."""
    out = {}
    for d, text in enumerate(texts):
        page = leakage.make_page(text)
        for item in items:
            n = leakage.leaked_words(page, leakage.matches(page, leakage.hashes(page.letters, leakage.TILE[item.unspaced]), item), item)
            if n >= (leakage.MIN_CHARS if item.unspaced else leakage.MIN_WORDS):
                out[d, item.item_id] = n
    return out


def test_no_pair_is_lost_before_tiling():
    rng = random.Random(12)
    stock = [_passage(rng, 6)[:-1] for _ in range(8)]  # phrases that all items share
    words = [" ".join(rng.choice(stock) if rng.random() < 0.5 else _passage(rng, 5)[:-1] for _ in range(6)) for _ in range(10)]
    signs = [chr(0x4E00 + i) for i in range(60)]
    items = [leakage.make_item(i, w) for i, w in enumerate(words)] + [leakage.make_item(50 + i, "".join(rng.choice(signs) for _ in range(80))) for i in range(4)]
    chars = ["".join(chr(c) for c in item.letters) for item in items[10:]]
    texts = []
    for n in range(160):
        rate = rng.choice([0, 0.03, 0.08, 0.12])
        misread = lambda t: "".join(rng.choice("xkzq") if c != " " and rng.random() < rate else c for c in t)  # noqa: E731, B023
        if n % 4:
            w, a = rng.choice(words).split(), rng.randrange(8)
            part, width = w[a : a + rng.randrange(14, 24)], rng.randrange(2, 7)
            lines = [misread(" ".join(part[i : i + width])) for i in range(0, len(part), width)]
            other = [misread(rng.choice(stock + words)[:30]) for _ in lines]
        else:
            part, width = rng.choice(chars)[5 : 5 + rng.randrange(28, 50)], rng.randrange(6, 20)
            lines = [misread(part[i : i + width]) for i in range(0, len(part), width)]
            other = ["".join(rng.choice(signs) for _ in range(12)) for _ in lines]
        if n % 3 == 0:
            lines = [x for pair in zip(lines, other, strict=True) for x in pair]
        elif n % 3 == 1:
            k = len(lines) // 2
            lines = lines[k:] + other + lines[:k]
        texts.append("\n".join([other[0], *lines, other[-1]]))
    index = leakage.Index(items)
    got = {(d, i): n for d, hits in enumerate(leakage.search(index, texts)) for i, n, by_char in hits if n >= (leakage.MIN_CHARS if by_char else leakage.MIN_WORDS)}
    want = _every_pair(items, texts)
    assert got == want and len(want) > 40


def test_parts_far_apart_on_a_long_page_meet():
    rng = random.Random(21)
    item = _passage(rng, 40)
    words = item.split()
    filler = "\n".join(_passage(rng, 6) for _ in range(300))
    page = "\n".join([filler[:300], " ".join(words[5:15]), filler, " ".join(words[15:25]), filler[-300:]])
    assert len(page) > 9000
    [hits] = leakage.search(leakage.Index([leakage.make_item(1, item)]), [page])
    assert hits and hits[0][1] >= 20


def test_noisy_ends_do_not_hide_a_clean_chain():
    item = leakage.make_item(1, _passage(random.Random(3), 40))
    n, size = 150, len(item.letters)
    page = leakage.Page(item.letters, item.figures, [0, size])
    assert size > n + 46
    noisy, i = [], n  # tiles linked over breaks, which cost most of their letters
    while i + 6 <= size:
        noisy.append((i, i + 6, i, i + 6))
        i += 6
    begin, end, under, path = leakage.chains([(0, n, 0, n), *noisy], page, item)
    assert under >= leakage.COVERAGE * (end - begin) and end - begin >= n and begin == 0
    assert path[0] == (0, n, 0, n)


def test_matches_are_maximal():
    item, page = leakage.make_item(1, "abcdefghij klmnop"), leakage.make_page("xx abcdefghij\nklmnop yy")
    found = leakage.matches(page, leakage.hashes(page.letters, leakage.TILE[False]), item)
    assert found == [(2, 0, 16)]


def test_only_what_may_count_is_tiled():
    rng = random.Random(31)
    item = leakage.make_item(1, _passage(rng, 40))
    words, other = item_words(31), [_passage(random.Random(40 + k), 6) for k in range(4)]
    page = "\n".join([other[0], " ".join(words[5:30]), other[1], other[2] + " " + " ".join(words[33:36]) + " xxzxx " + other[3]])
    held = leakage.make_page(page)
    [(_, _, found)] = leakage.Index([item]).pairs([held])
    every = leakage.matches(held, leakage.hashes(held.letters, 6), item)
    assert set(found) < set(every)
    assert leakage.leaked_words(held, found, item) == leakage.leaked_words(held, every, item) >= 25


def item_words(seed):
    return _passage(random.Random(seed), 40).split()


def test_dense_spans_against_all_spans():
    import numpy as np

    rng = random.Random(7)
    seen = set()
    for _ in range(300):
        rows = [(o, b, b + rng.randrange(1, 14), 20 + o % 3) for o in range(6) for b in (rng.randrange(80) for _ in range(rng.randrange(1, 10)))]
        rng.shuffle(rows)
        got = leakage._dense(*(np.array(x) for x in zip(*rows, strict=True)))
        want = {}
        for o in range(6):
            under = [any(b <= x < e for q, b, e, _ in rows if q == o) for x in range(100)]
            want[o] = any(under[b] and under[e - 1] and 20 * sum(under[b:e]) >= 17 * (e - b) for b in range(100) for e in range(b + 20 + o % 3, 101))
        seen |= set(want.values())
        assert got.tolist() == [want[r[0]] for r in rows]
    assert seen == {True, False}


def test_chains_of_many_pairs_are_those_of_each():
    rng = random.Random(17)
    jobs = []
    for n in range(12):
        item = leakage.make_item(n, _passage(rng, 40))
        words = item_words(1000 + n) if n == 5 else "".join(chr(c) for c in item.letters)
        page = leakage.make_page("\n".join(words[a : a + 30] for a in rng.sample(range(0, 150, 25), 6))) if n != 5 else leakage.make_page(" ".join(words))
        found = leakage.matches(page, leakage.hashes(page.letters, 6), item)
        jobs.append((leakage.mark(leakage.joined(found, page, item), 6, len(page.letters)), page, item))
    jobs.append(([], *jobs[0][1:]))
    assert list(leakage.all_chains(jobs)) == [leakage.chains(*job) for job in jobs] and leakage.chains(*jobs[-1]) == (0, 0, 0, [])


# ---- sentences
EN = "The wagon was sold on Aug. 11. Why did Dr. Holt leave at 9.30 p.m. yesterday? “It was late! We all left,” said Mr. Lane. No one saw the old bridge again."


def _units(model, text):
    ends, out, at = sentences.boundaries(model, text), [], 0
    for e in ends:
        out.append(text[at : e + 1].strip())
        at = e + 1
    return out


@pytest.fixture(scope="module")
def model():
    rng = random.Random(9)
    texts = []
    for _ in range(300):
        parts = [rng.choice(["The wagon was sold on Aug. 11.", "Why did Dr. Holt leave at 9.30 p.m. yesterday?", "Mr. K. Lane saw the river on Sept. 3.", "No one saw Mrs. B. Reed again!", "“It was late!” said Col. Dunn at the old mill.", "Why was the bridge painted?", "The lamp was sold by Mr. Reed.", "It was left to Dr. Dunn.", "The firm of A. Reed & Co. near the mill was closed."]) for _ in range(8)]
        texts.append((" ".join(parts), None))
    return sentences.learn(texts)


def test_abbreviations_quotes_and_decimals(model):
    assert _units(model, EN) == ["The wagon was sold on Aug. 11.", "Why did Dr. Holt leave at 9.30 p.m. yesterday?", "“It was late!", "We all left,” said Mr. Lane.", "No one saw the old bridge again."]


def test_headlines_rules_and_scripts(model):
    text = "NEWS FROM THE RIVER\nThe wagon was sold at the old mill\nnear the bridge.\n-----\nNo one saw it.\n"
    assert _units(model, text) == ["NEWS FROM THE RIVER", "The wagon was sold at the old mill\nnear the bridge.", "-----\nNo one saw it."]
    assert _units(model, "今日は雨です。明日は晴れか？はい。") == ["今日は雨です。", "明日は晴れか？", "はい。"]
    assert _units(model, "ฝนตกหนัก ครูไปตลาด 5 ครั้ง") == ["ฝนตกหนัก", "ครูไปตลาด 5 ครั้ง"]


def test_odd_texts(spark, model):
    boxes = "array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>"
    rows = [(1, None, None), (2, "", None), (3, " \n ", []), (4, "No mark at all", None), (5, "A. " * 40_000, None), (6, EN, [None, (1, 2, 3, 4, 5)]), (6, EN, [])]
    df = spark.createDataFrame([(*r, 5) for r in rows], f"doc_id long, text string, line_boxes {boxes}, end_offset int")
    got = sentences.sentence_ends(df, model)
    assert got.where("doc_id < 4").count() == 0 and got.where("doc_id = 6").count() == 10
    assert sentences.sentence_ends(df.limit(0), model).count() == 0
    assert sentences.train(df.limit(0)).weights.any() == False  # noqa: E712


def test_words_are_counted_in_all_documents(spark, monkeypatch):
    docs = [(i, "The lamp was sold! It was late.") for i in range(40)] + [(100 + i, f"Why was it sold? Wherefore he left {i} mills on the 3. Octember again.") for i in range(3)]
    df = spark.createDataFrame([(*d, None) for d in docs], "doc_id long, text string, line_boxes array<struct<x0:int,y0:int,x1:int,y1:int,conf:int>>")
    want = ({"It", "Wherefore"}, {"Octember"})
    for held in (200_000, 0):
        monkeypatch.setattr(sentences, "HELD", held)
        assert sentences.common_words(df) == want
    model = sentences.train(df, limit=5)
    assert (model.starters, model.followers) == want
    assert any(c.kind == "comma" for c in sentences.candidates("he left, Wherefore it was sold.", None, model.starters, model.followers))


def test_openings_are_those_of_all_candidates():
    texts = [EN, "Was it? Yes!\nNo one saw it! “Why?” Lane said?! — Then he left.", "left! Right   | Was it? No\nThe old   | And new!\n(Then) so?  | Is it\n", "今日は雨です。Ａはい？ Yes", "ฝนตกหนัก! ABC", "!!! What?\n-----\nNow", "«Так?» Он ушёл! Да"]
    for text in texts:
        assert sorted(sentences.openings(text, None)) == sorted(c.opens for c in sentences.candidates(text, None) if c.opens)


def test_held_out_accuracy():
    rng = random.Random(10)
    names, titles = ["Reed", "Holt", "Lane", "Dunn"], ["Dr.", "Mr.", "Col.", "Mrs."]
    verbs = ["left", "painted", "sold", "visited"]

    def sentence():
        s = f"{rng.choice(['The', 'Why', 'No', 'It'])} {rng.choice(verbs)} {rng.choice(titles)} {rng.choice('ABC')}. {rng.choice(names)} {rng.choice(['at 9.30 p.m. daily', 'on Aug. 3', 'near the mill'])}"
        return s + rng.choice([".", "!", "?"])

    def page(n):
        parts = [sentence() for _ in range(n)]
        return " ".join(parts), [sum(len(p) + 1 for p in parts[: i + 1]) - 2 for i in range(n)]

    model = sentences.learn([(page(10)[0], None) for _ in range(200)])
    right = total = 0
    for _ in range(50):
        text, ends = page(10)
        found = set(sentences.boundaries(model, text))
        right += len(found & set(ends))
        total += len(found | set(ends))
    assert right / total > 0.95


def test_letters_beyond_the_first_planes_are_kept():
    text = "".join(chr(0x20000 + 7 * i) for i in range(60))
    item = leakage.make_item(1, text)
    assert item.unspaced and len(item.letters) == 60
    found = leakage.search(leakage.Index([item]), ["前文" + text[:20] + "\n" + text[20:45] + "後文"])
    assert found[0] and found[0][0][1] >= 40


def test_marking_searches_again_what_is_left_of_a_match():
    # the longest first; the next overlaps it in the middle and is tiled on both sides of it
    assert sorted(leakage.mark([(10, 30, 50, 70), (0, 19, 100, 119), (25, 45, 200, 220), (5, 12, 0, 7)], 5, 60)) == [(0, 10, 100, 110), (10, 30, 50, 70), (30, 45, 205, 220)]
    assert sorted(leakage.mark([(10, 40, 50, 80), (0, 60, 100, 130)], 5, 60)) == [(0, 60, 100, 130)]


def test_pages_without_capitals_are_not_cut_for_openings(monkeypatch):
    texts = ["世界は広い。そうですか？はい！\n" * 3, "it was late! we left. why? nobody knew", "यह घर है। वह कौन है? हाँ!"]
    assert [sentences.openings(t, None) for t in texts] == [[], [], []]
    assert sentences.openings("是的我们都在这里！Anna 走了。", None) == ["A"]  # one letter, as in Han
    monkeypatch.setattr(sentences, "segments_of", None)
    assert [sentences.openings(t, None) for t in texts] == [[], [], []]


def test_script_by_every_letter():
    def counted(text):
        n = dict.fromkeys(("th", "cjk", "hi", "ar", "cyr", "lat"), 0)
        spans = {"th": [(0xE00, 0xE80)], "cjk": [(0x3040, 0x3100), (0x3400, 0xA000)], "hi": [(0x900, 0x980)], "ar": [(0x600, 0x700)], "cyr": [(0x400, 0x500)]}
        for ch in text[:: max(1, len(text) // 150)]:
            k = next((k for k, v in spans.items() if any(a <= ord(ch) < b for a, b in v)), "lat" if ch.isalpha() else None)
            if k:
                n[k] += 1
        return max(n, key=lambda k: (n[k], k))

    rng = random.Random(2)
    edges = [c + d for c in (0x400, 0x500, 0x600, 0x700, 0x900, 0x980, 0xE00, 0xE80, 0x3040, 0x3100, 0x3400, 0xA000, 0x20000, 0x41, 0xE0) for d in (-1, 0, 1, 9)]
    for _ in range(400):
        text = "".join(chr(rng.choice(rng.sample(edges, 3))) for _ in range(rng.randrange(0, 500)))
        assert sentences.script_of(text) == counted(text)
    assert [sentences.script_of(t) for t in ("", "12 .", "abc", "é", "дом", "ไทย")] == ["th", "th", "lat", "lat", "cyr", "th"]


def test_marks_that_are_scored_get_no_label_and_the_same_features(model):
    texts = [EN, EN.replace(" ", "\n"), "A B! c. D 3. x? “Why?” he said, The end", "THE NEWS\nIt was sold. THE END."]
    for text in texts:
        every = sentences.candidates(text, None, model.starters, model.followers)
        scored = sentences.candidates(text, None, model.starters, model.followers, True)
        features = {(c.end, c.kind): c.features for c in every}
        assert scored and all(features[c.end, c.kind] == c.features for c in scored)
        assert all(c.label == -1 for c in scored if c.kind != "end") and any(c.label >= 0 for c in every if c.kind == "mark")
