"""Alignment of two tokenizers against plain Python on whole texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import alignment
from tests.llm.data import documents, frame

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
_A, _B = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
_A.encode_special_tokens = True
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE = {chr(x): x for x in _OWN} | {chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in _OWN)}


def brute_tokens(t):
    a = _A.encode(" " + t, add_special_tokens=False).ids
    b = _B.encode(t)
    spell_a = [bytes(_BYTE[c] for c in _A.id_to_token(i)) for i in a]
    spell_b = [bytes([int(_B.id_to_piece(i)[3:5], 16)]) if _B.is_byte(i) else _B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(spell_a) != (" " + t).encode() or b"".join(spell_b) != (" " + t).encode():
        return [], [], [], []
    return a, b, np.cumsum([len(x) for x in spell_a]).tolist(), np.cumsum([len(x) for x in spell_b]).tolist()


def brute_alignment(texts):
    rows, counts = [], Counter()
    for t in texts:
        a, b, x, y = brute_tokens(t) if t else ([], [], [], [])
        links = [(i, j) for i, e in zip(a, x) for j, f in zip(b, y) if e == f] if len(a) < 3000 else [(a[x.index(e)], b[y.index(e)]) for e in sorted(set(x) & set(y))]
        counts.update(links)
        groups, start = [], 0
        for e in sorted(set(x) & set(y)):
            groups.append(",".join(str(i) for i, f in zip(a, x) if start < f <= e) + "|" + ",".join(str(i) for i, f in zip(b, y) if start < f <= e))
            start = e
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    return [(n_a, n_b, n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), g) for n_a, n_b, n, links, g in rows]


def test_alignment_matches_brute_force(spark, monkeypatch):
    rows = [d for d in documents() if len(d[1] or "") < 50_000]
    dice = random.Random(4)
    odd = ["<|endoftext|> <s> </s> <unk>", "▁ inside", "tabs\tand  two   spaces \n\n new  ", "naïve café 東京 😀", "\x00\x01", "e" * 3000, "don't they'll 123abc", "　wide space ", "á" * 40]
    odd.append(" ".join(dice.choice(["alpha", "beta,", "Gamma.", "x1y2"]) for _ in range(900)))
    texts = [d[1] for d in rows] + odd
    df = frame(spark, rows + [(500 + k, t, *rows[0][2:]) for k, t in enumerate(odd)])
    want = brute_alignment(texts)
    ids = [d[0] for d in rows] + [500 + k for k in range(len(odd))]
    for size in (alignment.SLICE, 300):
        monkeypatch.setattr(alignment, "SLICE", size)
        out = alignment.alignment(df, A, B)
        got = Counter(tuple(r) for r in out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
        assert got == Counter((i, *w) for i, w in zip(ids, want))
    digests = Counter((r.doc_id, r.groups_sha256) for r in alignment.alignment_digests(df, A, B).collect())
    assert digests == Counter((i, hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for i, w in zip(ids, want))
    assert sum(w[2] > 0 for w in want) > 20 and any(w[0] == 0 and t for w, t in zip(want, texts))
    assert alignment.alignment(frame(spark, []), A, B).count() == 0


def test_one_long_text():
    pair = alignment.token_pair(A, B)
    dice = random.Random(9)
    long = " ".join(dice.choice(["alpha", "beta", "Ünder", "x1y2", "東京", "12,5"]) for _ in range(120_000))
    whole = alignment.align(pair, [b"", long.encode(), b"tail"])
    a, b, x, y = brute_tokens(long)
    assert (whole.n_a[1], whole.n_b[1], whole.n_links[1]) == (len(a), len(b), len(set(x) & set(y)))
    assert whole.groups[0] == b"" and whole.groups[1].count(b"|") == whole.n_links[1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\tab'▁.<|>"))), max_size=30), max_size=5))
def test_words_encode_as_in_whole_texts(texts):
    pair = alignment.token_pair(A, B)
    a, b = pair.encode(texts)
    assert a.ids.tolist() == [i for t in texts if t for i in _A.encode(" " + t, add_special_tokens=False).ids]
    assert b.ids.tolist() == [i for t in texts for i in _B.encode(t)]
    found = alignment.align(pair, [t.encode() for t in texts])
    assert [g.decode() for g in found.groups] == [w[-1] for w in brute_alignment(texts)]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 60)), st.sets(st.integers(1, 60)), st.integers(1, 70))
def test_merging_at_any_lane(a, b, lane):
    one, other = np.array(sorted(a), np.int64), np.array(sorted(b), np.int64)
    at_a, at_b = alignment.merge_ends(one, other, 60, lane)
    assert one[at_a].tolist() == sorted(a & b) == other[at_b].tolist()
