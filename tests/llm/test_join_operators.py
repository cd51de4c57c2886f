"""Jaccard join, forest, passages, archives, preferences and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import forest, hamming, jaccard, linking, passages, preference, warc
from quire.llm.store import running
from quire.llm.words import byte_words
from tests.llm.data import SCHEMA, WORD, documents, frame, labels, text


def shingles(t):
    words = WORD.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_groups(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return Counter((i, len(s), (least.get(find(x)) if s else i)) for x, (i, s) in enumerate(sets))


def groups(df, operator=jaccard.jaccard_groups):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in operator(df).collect())


def test_jaccard_groups(spark):
    rows = documents()
    assert groups(frame(spark)) == brute_groups([(d[0], d[1]) for d in rows])
    assert jaccard.jaccard_groups(frame(spark, [])).count() == 0
    kept = jaccard.one_of_each_group(frame(spark))
    assert kept.columns == frame(spark).columns


def test_one_of_each_group_keeps_null_ids(spark):
    dice = random.Random(31)
    a, b, c, d = (text(dice, 90, 10**6) for _ in range(4))
    rows = [(None, a), (None, a), (None, a + " end"), (7, b), (None, b), (None, b + " end"), (None, None), (None, ""), (8, c), (8, d), (9, c + " end"), (8, c)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df) == brute_groups(rows)
    kept = sorted(((r.doc_id, r.text) for r in jaccard.one_of_each_group(df).collect()), key=str)
    alone = [x for x in kept if x[0] is None and x[1] and x[1].startswith(a)]
    assert len(alone) == 1
    assert [x for x in kept if x not in alone] == sorted([(7, b), (None, None), (None, ""), (8, c), (8, d)], key=str)


def test_components_by_rounds_and_by_one_task(spark, monkeypatch):
    dice = random.Random(41)
    order = list(range(0, 3000, 3))
    dice.shuffle(order)
    links = list(zip(order, order[1:100])) + [(order[100], x) for x in order[101:400]] + [(x, order[700]) for x in order[400:600]] + [(1, 1), (2, 5), (5, 2)]
    root = {x: x for x in {y for e in links for y in e} if x != 1}
    for _ in range(len(root)):
        old = dict(root)
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
        if old == root:
            break
    df = spark.createDataFrame(links, "src long, dst long")
    for limit in (linking.EDGES, 3):
        monkeypatch.setattr(linking, "EDGES", limit)
        assert {r.node: r.component for r in linking.components(df).collect()} == root
    assert linking.components(df.limit(0)).count() == 0


def chains_and_hot_groups():
    dice = random.Random(3)
    base = [f"w{dice.randrange(10**6)}" for _ in range(150)]
    rows, words = [], list(base)
    for i in range(60):  # a chain: neighbours link, ends do not
        words = words[2:] + [f"c{i}", f"d{i}"]
        rows.append((1000 - i, " ".join(words)))
    for i in range(120):  # a large group around one text, some just below the limit
        own = list(base)
        for k in dice.sample(range(150), dice.choice([1, 2, 3, 4, 5])):
            own[k] = f"e{i}x{k}"
        rows.append((2000 + i, " ".join(own)))
    for i in range(40):  # a shared passage in different texts
        rows.append((3000 + i, " ".join(base[:20]) + " " + text(dice, 100, 10**6)))
    return rows


@pytest.mark.parametrize("operator, percent", [(jaccard.jaccard_groups, 80), (hamming.near_duplicates, 85)])
def test_chains_and_hot_groups(spark, monkeypatch, operator, percent):
    rows = chains_and_hot_groups()
    monkeypatch.setattr(linking, "BLOCK_BYTES", 16 * linking.SMALLEST)
    monkeypatch.setattr(linking, "CHUNK", 8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert groups(df, operator) == brute_groups(rows, percent)


def test_tiles_send_on_fewer_links_than_rows(spark, monkeypatch):
    """A group of 3,000 near copies that no leader holds together: all links, at most rows - 1 a tile."""
    dice = random.Random(17)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(3000):
        own = list(base)
        for k in range(dice.choice([1, 2, 3])):  # two copies differ in up to six places: many pairs lie on both sides of the limit
            own[dice.randrange(100)] = f"e{i}x{k}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # words e..x.. occur in one text each, so texts share shingles of the base only
    sets = [shingles(t) for _, t in rows]
    own = sorted(shingles(" ".join(base)))
    held = np.array([[g in s for g in own] for s in sets]).astype(np.float32)
    both = (held @ held.T).astype(int)
    size = np.array([len(s) for s in sets])
    linked = 100 * both >= 80 * (size[:, None] + size[None, :] - both)
    least = np.arange(len(rows))
    while True:  # every text takes the smallest id among those it links with
        now = np.where(linked, least[None, :], len(rows)).min(axis=1)
        if (now == least).all():
            break
        least = now
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(df).collect()}
    assert got == dict(enumerate(least.tolist()))
    # one tile, nothing known before
    found = linking.shingle_sets([t.encode() for _, t in rows[:800]])
    size = np.array([len(f) for f in found])
    bits = np.zeros((len(found), jaccard.BITMAP // 64), np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size + 1, bits.shape[1], dtype=np.int32)), pa.array(bits.ravel()))
    node = pa.array(range(len(found)), pa.int64())
    tile = pa.RecordBatch.from_arrays([node, node, pa.array([0] * len(found), pa.int64()), pa.array(size), lists, pa.array([f.tobytes() for f in found], pa.binary())], list("nobksx"))
    links = linking.tile_links(tile, linking.Rule(80, 100, lambda *x: np.ones(len(x[0]), bool)))
    assert 0 < links.num_rows < len(found)


def test_every_pair_within_the_distance_shares_a_key():
    dice = np.random.default_rng(2)
    one = dice.integers(0, 1 << 16, (200, hamming.SYMBOLS), np.uint16)
    other = one.copy()
    for k in range(200):
        off = dice.choice(hamming.SYMBOLS, dice.integers(0, hamming.DISTANCE + 1), replace=False)
        other[k, off] ^= np.uint16(1 + k)
    a, b = hamming.chunk_keys(one), hamming.chunk_keys(other)
    assert all(set(x) & set(y) for x, y in zip(a.tolist(), b.tolist()))
    packed = hamming.distance(one.view(np.int64), other.view(np.int64))
    assert packed.tolist() == (one != other).sum(axis=1).tolist() and packed.max() == hamming.DISTANCE
    assert not {x for row in a.tolist() for x in row} & {x for row in hamming.chunk_keys(dice.integers(0, 1 << 16, (50, hamming.SYMBOLS), np.uint16)).tolist() for x in row}


def test_near_duplicates_on_odd_rows(spark):
    rows = [(d[0], d[1]) for d in documents()]
    out = hamming.near_duplicates(frame(spark)).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in out) == brute_groups(rows, 85)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    assert hamming.near_duplicates(frame(spark, [])).count() == 0


def brute_units(t):
    """[words, start, end] of the units, by the rule in plain Python over code points; hashes of words are taken as given."""
    found = list(WORD.finditer(t))
    hashes = byte_words([t.encode()])[3].tolist()
    units = []
    for k, m in enumerate(found):
        last = found[k - 1] if k else None
        least = k > 0 and all(hashes[k - 1] < hashes[j] for j in range(k, min(k + passages.REACH, len(found)))) and all(
            hashes[k - 1] <= hashes[j] for j in range(max(0, k - 1 - passages.REACH), k - 1))
        if last is None or "\n" in t[last.end() : m.start()] or t[last.end() - 1] in ".!?" or least:
            if units:
                units[-1][2] = m.start()
            units.append([[], m.start(), len(t)])
        units[-1][0].append(m.group().translate({c: c + 32 for c in range(65, 91)}))
    return units


def brute_chains(t, units, least):
    """(first unit, unit behind the last one) of all chains."""
    n = [len(u[0]) for u in units]
    chains = set()
    for a in range(len(units)):
        for b in range(a + 1, len(units) + 1):
            if sum(n[a:b]) >= least:
                chains.add((a, b))
                break
    line = [t.count("\n", 0, u[1]) for u in units]
    runs = [(0, len(units))] + [(line.index(x), len(line) - line[::-1].index(x)) for x in set(line)]
    for k, (a, b) in enumerate(runs):
        starts = [s for s in range(a, b) if sum(n[s:b]) >= least]
        if starts:
            chains.add((starts[-1], b))
        elif k == 0 and units:
            chains.add((a, b))
    return sorted(chains)


def brute_passages(rows, least=passages.MIN_WORDS):
    """{(id, text): (text left, spans removed)}"""
    distinct = sorted({(i is None, i or 0, i, t) for i, t in rows if t is not None}, key=lambda r: r[:2])
    cut = [(i, t, u := brute_units(t), brute_chains(t, u, least)) for *_, i, t in distinct]
    seen = {}
    for d, (_, _, units, chains) in enumerate(cut):
        for c in chains:
            seen.setdefault(tuple(w for u in units[c[0] : c[1]] for w in u[0]), (d, c))
    out = {}
    for d, (i, t, units, chains) in enumerate(cut):
        gone = set()
        for c in chains:
            e, first = seen[tuple(w for u in units[c[0] : c[1]] for w in u[0])]
            if (e, first) != (d, c) and (e != d or first[1] <= c[0]):
                gone |= set(range(*c))
        spans = []
        for k in sorted(gone):
            if spans and spans[-1][1] == units[k][1]:
                spans[-1][1] = units[k][2]
            else:
                spans.append(units[k][1:])
        left, at = "", 0
        for a, b in spans:
            left, at = left + t[at:a], b
        out[(i, t)] = (left + t[at:], tuple(map(tuple, spans)))
    return out


def passage_rows():
    dice = random.Random(19)
    rows = [d for d in documents() if not (d[0] == 12 and "another" in (d[1] or ""))]
    other = rows[0][2:]
    line = text(dice, 26)
    new = [text(dice, n) for n in (22, 31, 45, 59)] + [f"own words {text(dice, 5)}\n{line}\nmore {text(dice, 9)}", f"{text(dice, 8)}\n{line}\n{text(dice, 30)}", "Short text only.", "\n\n" + line]
    return rows + [(40 + k, t, *other) for k, t in enumerate(new)] + [(60 + k, t.upper(), *other) for k, t in enumerate(new[:4])] + [(70, " short  TEXT only. ", *other)]


def test_repeated_passages(spark):
    docs = frame(spark, passage_rows())
    rows = [(d[0], d[1]) for d in passage_rows()]
    want = brute_passages(rows)
    got = passages.remove_passages(docs)
    assert [c for c in got.columns if c not in ("removed", "n_units", "removed_words")] == [c for c in docs.columns if c != "removed"]
    out = got.collect()
    found = Counter((r.doc_id, r.text, tuple((s.start, s.end) for s in r.removed)) for r in out)
    assert found == Counter((i, *(want[(i, t)] if t is not None else (None, ()))) for i, t in rows)
    assert any(r.removed_words > 50 for r in out)
    # nothing of a copied text or line stays, however short the text
    left = {r.doc_id: r.text for r in out}
    assert all(not left[i].strip() for i in (60, 61, 62, 63, 70, 47)) and left[45].count("\n") == 1
    assert passages.remove_passages(frame(spark, [])).count() == 0


def test_copied_texts_of_any_length_leave_nothing():
    dice = random.Random(33)
    for n in [*range(1, 60), 200]:
        t = text(dice, n, 10**6).encode()
        units, chains = passages.cut_chains([b"other words", t, t])
        for k in (1, 2):
            own = np.flatnonzero(units.text == k)
            held = {u for a, b in zip(chains.start[chains.text == k], chains.stop[chains.text == k]) for u in range(a, b)}
            assert held == set(own.tolist())
        assert chains.digest[chains.text == 1].tolist() == chains.digest[chains.text == 2].tolist()


def test_passage_inside_lines_stays_once(spark):
    dice = random.Random(9)
    passage = "Every " + " ".join(f"p{k}" + "." * (k % 9 == 8) for k in range(60)) + "."
    rows = [(i, text(dice, 30) + " " + passage + " " + text(dice, 30)) for i in range(20)]
    out = passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [r.doc_id for r in out if "p31 p32 p33" in r.text] == [0]


def test_only_words_in_their_earlier_order_are_repeats(spark):
    dice = random.Random(21)
    capitals = [" ".join(f"W{dice.randrange(400)}" for _ in range(9000)), " ".join(f"W{dice.randrange(400)}" for _ in range(300))]
    clauses = ["however,", "for example,", "in fact,", "of course,", "as a rule,", "by the way,", "at last,", "on average,"]
    mixed = [" ".join(dice.choice(clauses) for _ in range(60)) for _ in range(2)]
    passage = " ".join(f"Word{k}" + "," * (k % 6 == 5) for k in range(72))
    rows = list(enumerate([*capitals, *mixed, "one, two " + passage + " three", "four " + passage.upper() + " five, six"]))
    rows += [(9, "So it goes on here,\n" * 20), (None, "short, " * 19)]
    out = {r.doc_id: r for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].text == rows[i][1] and out[i].removed_words == 0 for i in (0, 1, 2, 4))
    runs = [tuple(w[i : i + 20]) for w in map(WORD.findall, mixed) for i in range(len(w) - 19)]
    assert len(set(runs)) == len(runs) and out[3].removed_words == 0
    assert "WORD30" not in out[5].text and out[5].text.startswith("four ") and out[5].text.endswith("six")
    # the earliest 20 words of a text that repeats itself stay whole
    assert out[9].text == "So it goes on here,\n" * 4 and out[None].removed_words == 0



def test_repeats_without_marks_or_capitals_go(spark):
    dice = random.Random(22)
    rows, inner = [], {}
    for k in range(40):
        letter = "wщ水é"[k % 4]
        mark = ["", "\u060c", "", ""][k % 4]
        passage = [f"{letter}{k}n{dice.randrange(5000)}" + mark * (j % 7 == 6) for j in range(60)]
        changed = passage[:57] + ["changed"] + passage[58:] if k % 3 == 0 else passage
        for part, words in enumerate((passage, changed)):
            rows.append((100 * part + k, f"{text(dice, 23, 10**6)} {' '.join(words)} {text(dice, 31, 10**6)}"))
        inner[k] = " ".join(passage[20:40])
    out = {r.doc_id: r for r in passages.remove_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, middle in inner.items():
        assert out[k].removed_words == 0 and middle in out[k].text
        assert middle not in out[100 + k].text and 20 <= out[100 + k].removed_words <= 60
    # cuts never depend on the texts that happen to be in the same slice
    texts = [t.encode() for _, t in rows]
    together, chains = passages.cut_chains(texts)
    for k, t in enumerate(texts):
        own, whole = passages.cut_chains([t])
        assert own.start.tolist() == together.start[together.text == k].tolist()
        assert whole.digest.tolist() == chains.digest[chains.text == k].tolist()


def brute_nearest(rows, k, step):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in good if i % step == 0):
        near = sorted((-(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
        out[q] = [(i, -s) for s, i in near]
    return out


def test_forest_recall_and_odd_vectors(spark):
    dice = np.random.default_rng(1)
    rows = [(i, dice.standard_normal(16).tolist()) for i in range(1500)]
    rows += [(1500 + i, [3 * x for x in rows[20][1]]) for i in range(100)] + [(None, rows[0][1]), (1700, None), (1701, [0.0] * 16), (1702, [float("nan")] * 16), (1703, [None] + [1.0] * 15), (1704, [float("inf")] * 16), (1720, [1.0, 2.0]), (1740, [2.0, 1.0]), (40, rows[40][1])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, shard int")
    want = brute_nearest(rows, 20, 20)
    got = {}
    for r in forest.search(df, df.where("vec_id % 20 = 0"), shard=400).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {q for q in want if want[q]}
    hits = [len({x[1] for x in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in got]
    assert np.mean(hits) >= 0.9
    good = {i: np.array(v, float) for i, v in rows if v and None not in v}
    for q, own in got.items():
        assert [x[0] for x in own] == list(range(1, len(want[q]) + 1)) and q not in {x[1] for x in own}
        assert all(abs(s - good[q] @ good[i]) < 1e-9 for _, i, s in own)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
    assert [x[1] for x in got[1520]] == [i for i, _ in want[1520]] == [*range(1500, 1520)]
    assert forest.search(df.limit(0), df.limit(0)).count() == 0


def test_archives_round_trip(spark):
    body = "<p>" + "page body " * 30
    rows = [(1, "http://a", body), (2, None, body), (3, "http://c\r\nX: y", ""), (4, "u", None), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 50), (8, "u", "é" * 50), (None, "n", body), (None, "n", "y" * 200), (9, "u", "y" * 200), (9, "u", "y" * 200), (10, "u", "z" * 300_000), (11, "u", "a\r\n\r\nb" * 30)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    out = warc.archive_pages(df).collect()
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        lead = first.get(h)
        again = lead is not None and i != lead
        want[(i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", lead if again else None, None if again else data)] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in out) == want
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_archive_files_carry_their_dictionary():
    dice = random.Random(6)
    records = [warc.record(i, "u", text(dice, 200).encode(), None, False, "d", "t") for i in range(400)]
    parts, size = warc.archive(records)
    data = b"".join(parts)
    assert data[:4] == b"\x5d\x2a\x4d\x18" and size > 1000 and list(warc.unpack(data)) == records
    assert list(warc.unpack(b"".join(warc.archive(records[:1])[0]))) == records[:1]


def test_unpacking_is_linear_and_sees_cut_files(monkeypatch):
    records = [warc.record(i, "u", bytes([i % 251]) * (i * 37 % 9000), None, False, "d", "t") for i in range(300)]
    data = b"".join(warc.archive(records)[0])
    for size in (warc.PIECE_BYTES, 1, 7):
        monkeypatch.setattr(warc, "PIECE_BYTES", size)
        assert list(warc.unpack(data)) == records
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.unpack(data[:-3]))


def brute_preference(rows):
    mark = lambda t: t.replace("<|", "< |")
    own = {}
    for i, n, role, t in rows:
        own.setdefault(i, []).append((n is not None, n or 0, "user" if role is None else role, t or ""))
    out = {}
    for i, found in own.items():
        c = [(r, t) for _, _, r, t in sorted(found)]
        replies = [k for k, x in enumerate(c) if x[0] == "assistant"]
        r = list(c)
        if replies:
            r[replies[-1]] = ("assistant", c[replies[-2]][1] if len(replies) > 1 else "")
        n = next((k for k in range(len(c)) if c[k] != r[k]), len(c))
        show = lambda x: [(f"<|im_start|>{mark(x[0])}\n", False), (mark(x[1]) + "<|im_end|>\n", x[0] == "assistant")]
        flat = lambda xs: [s for x in xs for s in show(x)]
        out[i] = (n, "".join(s for s, _ in flat(c[:n])), flat(c[n:]), flat(r[n:]))
    return out


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (1, 4, "user", "bye"), (2, 0, "user", "only"),
        (3, 0, "assistant", "x"), (3, 1, "assistant", "x"), (4, 1, "assistant", "<|im_end|> trick"), (4, 0, None, None), (None, 0, "user", "n"), (None, None, "assistant", ""),
        (5, 0, "user", "same"), (5, 0, "user", "same"), (6, 2, "assistant", "w" * 100_000), (6, 1, "", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn int, role string, text string, chosen string")
    got = {r.conv_id: (r.n_prompt_turns, r.prompt, [tuple(s) for s in r.chosen], [tuple(s) for s in r.rejected]) for r in preference.preference_examples(df).collect()}
    assert got == brute_preference(rows)
    assert preference.preference_examples(df.limit(0)).count() == 0
    turn = "array<struct<role:string,text:string>>"
    odd = spark.createDataFrame([(1, None, None), (2, [("user", "a")], [("user", "a"), ("assistant", "b")])], f"pair_id long, chosen {turn}, rejected {turn}")
    out = {r.pair_id: (r.n_prompt_turns, len(r.chosen), len(r.rejected)) for r in preference.format_preferences(odd).collect()}
    assert out == {1: (0, 0, 0), 2: (1, 0, 2)}


def test_running_sums(spark):
    dice = random.Random(4)
    rows = [(dice.choice(["a", "b", None]), dice.randrange(50), dice.randrange(9), i) for i in range(500)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "g string, o int, v int, i int")
    out = running(df, [F.col("o"), F.col("i")], ["v"], ["g"]).collect()
    for r in out:
        assert r.v_before == sum(v for g, o, v, i in rows if g == r.g and (o, i) < (r.o, r.i))
    assert len(out) == 500


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Each stage against what its operator decides, on its own input."""
    import corpus_pipeline

    dice = random.Random(12)
    passage = "Shared " + " ".join(f"p{k}." for k in range(55))
    near = text(dice, 200, 5000)
    good = [(i, text(dice, 80, 5000) + (" " + passage if i % 7 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(100, 160)]
    good += [(200 + i, near + f" end{i}", "en", "s1", 1) for i in range(5)]
    junk = [(300 + i, " ".join(["junk", f"w{dice.randrange(50)}"] * 20), "en", "s0", 1) for i in range(60)]
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (2, None, "en", "s1", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(good + junk + odd, schema).write.parquet(f"{tmp_path}/documents.parquet")
    marks = [(i, int(i < 300)) for i in [*range(100, 160), *range(300, 360)]]
    spark.createDataFrame(marks, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append([r.asDict() for r in docs.collect()])
    kept = {r["doc_id"] for r in seen[0]}
    assert not kept & {300 + i for i in range(60)} and kept >= {g[0] for g in good}
    assert [r["doc_id"] for r in seen[1] if r["doc_id"] and 200 <= r["doc_id"] < 300] == [200]
    assert {r["doc_id"] for r in seen[1] if r["doc_id"] and 100 <= r["doc_id"] < 200} == {g[0] for g in good if g[0] < 200}
    assert [r["doc_id"] for r in seen[2] if "p20. p21." in (r["text"] or "")] == [105]
    words = sum(len(WORD.findall(r["text"] or "")) for r in seen[2])
    mixed = sum(len(WORD.findall(r["text"] or "")) for r in seen[3])
    assert abs(mixed - 1.5 * words) <= 3
    assert len(seen[4]) == len(seen[3]) and set(seen[4][0]) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(seen[4])


def test_registered_queries_run_and_match_their_sql(spark):
    from quire.llm.queries import CHECKS, QUERIES
    from tests.check import compare, duck

    root = "/root/testdata/sf0.001"
    con = duck(root)
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == [*range(1, 14)]
    for name, query in QUERIES.items():
        diff, n = compare(spark, con, root, query, CHECKS.get(name))
        assert not diff and n, (name, diff)
