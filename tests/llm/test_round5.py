"""Token ids: what is remembered, and the pre-tokens against the library. Shingles and signatures of lines."""

import random

import numpy as np

from runledger.llm import lines, queries, textnum, token_grammar


def test_words_go_to_the_library_once_whatever_marks_follow():
    """op1: what is remembered are pre-tokens, so marks and line ends make no new words."""
    pieces = token_grammar.Pieces(queries.tokenizer_path())
    pieces.encode_many(["so heed it. heed, heed&&& heed", "so heed.\nheed it's heed"])
    assert set(pieces) == {"so", " heed", "heed", " it", ".", ",", "&&&", "\n", "'s"}


def test_pretokens_match_the_library_for_every_kind_of_character():
    pieces = token_grammar.Pieces(queries.tokenizer_path())
    rng = random.Random(5)
    texts = [f"a{c}b {c} {c}{c}1 {c}\n{c} x" for c in map(chr, [*range(0x250), *range(0x250, 0xD800, 61), *range(0xE000, 0x20000, 97)])]
    texts += ["".join(rng.choice("ab Ab  \n\t\r'st re ve m ll d \u00e9\u4e2d\u03a91\u00b2\u00a0\u3000\x1c\x85-.,_\u2019\U0001f600\u0301") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    texts += ["x" * 5000 + "." * 300, "\n" * 50 + "a" + " " * 50]
    assert [t for t in texts if pieces.encode(t) != pieces.alone(t)] == []


def test_shingles_of_common_scripts_are_looked_up(monkeypatch):
    """op2: code points of the basic plane have their hashes in a table; others give the same shingles by computing them."""
    rows = ["une \u00e9t\u00e9 \u00e0 la mer du nord", "\u6570\u636e\u5904\u7406\u7cfb\u7edf\u7684\u8bbe\u8ba1\u4e0e\u5b9e\u73b0\u5305\u62ec", "short", "plain letters and nothing else"]
    mixed = lines.shingles([*rows, "\U0001f600" * 20])
    asked = []
    with monkeypatch.context() as m:
        m.setattr(textnum, "mix", lambda x: asked.append(len(x)))
        line, h = lines.shingles(rows)
    assert asked == []
    keep = mixed[0] < len(rows)
    assert (mixed[0][keep] == line).all() and (mixed[1][keep] >> np.uint64(3) == h >> np.uint64(3)).all()


def test_signatures_by_brute_force():
    """Lines with empty bins borrow in their order; the bands of a line do not depend on its company."""
    rng = random.Random(9)
    rows = ["".join(rng.choice("abcdef \u00e9") for _ in range(n)) for n in [1, 5, 12, 13, 20, 30, 60, 200, 900] * 3]
    count, bands = lines.signatures(*lines.shingles(rows), len(rows))
    for i, row in enumerate(rows):
        _, h = lines.shingles([row])
        low = {}
        for x in h.tolist():
            low[x >> 60] = min(low.get(x >> 60, 1 << 64), x >> 24)
        own = []
        for k in range(lines.BINS):
            by = next(j for j in [k, *lines._LENDERS[k].tolist()] if j in low)
            own.append(low[by] + by)
        want = []
        for k in range(lines.BANDS):
            x = np.array([k + 1], np.uint64)
            for v in own[2 * k : 2 * k + 2]:
                x = textnum.mix(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(v))
            want.append(int(x[0]) >> (64 - lines.BAND_BITS))
        assert count[i] == len(h) and bands[i].tolist() == want
