"""URL filters, ranked search and conversation repair against brute-force versions."""

import hashlib
import heapq
import itertools
import math
import re
import struct
import time
import zlib

import numpy as np
import pytest
import xxhash

from runledger.llm import conversations, fingerprint, langid, licenses, queries, search, textnum, toxicity, url_filter

SF = "/root/testdata/sf0.001"
URLS = [
    None, "", "no scheme/path", "http://", "://x.org/y", "HTTP://User@Sub.Example.ORG:80/Es/1?q#f", "https://a.example.org/es/1", "https://example.org/en/1", "https://example.org/en/19?x", "https://example.org/en/2",
    "http://org/", "http://xorg/", "http://a.org", "http://a.org?x=/", "http://b.com/fr/1", "http://b.com/de/1", "http://b.com/FR/1", "http://example.com/en/a://b/c", "http://É.net/ü#1", "http://notexample.org/es/", "http://casino-win-free.net/en/1",
    "https://city-library.net/en/1", "https://city-library.net/en/1",
]


def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in url_filter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_urls(spark):
    rows = [(None if i == 3 else i, u, "<p>", 1) for i, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int").repartition(3)
    got = url_filter.judge(pages).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = brute_url(URLS[3 if r.page_id is None else r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow")) and 0 <= r.score <= 1
    by = {r.page_id: r for r in got}
    assert by[20].verdict == "block" and by[21].verdict == by[22].verdict == "allow" and by[21].score == by[22].score
    kept = url_filter.allowed(pages)
    assert kept.columns == pages.columns
    assert sorted(r.page_id or -1 for r in kept.collect()) == sorted(r.page_id or -1 for r in got if r.verdict == "allow")
    none = spark.createDataFrame([], pages.schema)
    assert url_filter.judge(none).count() == 0


def test_url_scores_by_brute_force(spark):
    """Scores of the model's weights over n-grams that plain Python cuts."""
    model = url_filter.train(url_filter.labelled_urls(spark))
    rows = url_filter._features(spark.createDataFrame([(u,) for u in URLS], "url string"))
    weight, bias = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    for r in model.transform(rows).collect():
        score = bias
        for part, grams, unit, first in ((r.host, r.host_grams, r.host_unit, 0), (r.path, r.path_grams, r.path_unit, 1 << url_filter.BITS)):
            marked = f"^{part}$"
            assert sorted(grams) == sorted(marked[i : i + n] for n in url_filter.GRAMS for i in range(len(marked) - n + 1) if part)
            if part:
                assert np.linalg.norm(unit.toArray()) == pytest.approx(1) and len(unit.indices) <= len(set(grams))
            score += float(unit.toArray() @ weight[first : first + (1 << url_filter.BITS)])
        assert r.probability[1] == pytest.approx(1 / (1 + math.exp(-score)))


def test_url_model_holds_out(spark):
    """Trained on half of the names, right on most of the other half."""
    block, allow = url_filter.BLOCK_SITES, url_filter.ALLOW_SITES
    of = lambda names, part: [n for i, n in enumerate(names) if i % 2 == part]
    rows = [(f.format(n), y) for names, y in ((block, 1.0), (allow, 0.0)) for n in of(names, 0) for f in url_filter.FORMS]
    table = spark.createDataFrame([*rows, ("http://x.test/", None)], url_filter.SCHEMA)
    rest = [(i, f"https://{n}.net/en/3", y) for i, (n, y) in enumerate([(n, 1) for n in of(block, 1)] + [(n, 0) for n in of(allow, 1)])]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame(rest, "page_id long, url string, y int"), table, []).collect()}
    right = np.mean([(got[i] == "block") == bool(y) for i, _, y in rest])
    assert right > 0.7, right


def test_very_long_url(spark):
    url = "http://host.net/" + "a/é" * 100_000
    r = url_filter.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).first()
    assert r.host == "host.net" and len(r.path) == len(url) - 15 and r.verdict in ("allow", "block")


TEXTS = [None, "", "  ", "one two", "One TWO two", "x " * 3000 + "one", "die Übung ü É é", "a-b_c a1 1a", "two two two", "same words here", "same words here", "only else"] + [" ".join(f"w{(i * j) % 37}" for j in range(i % 23)) for i in range(80)]
ITEMS = [(1, "one two w3 w5"), (2, None), (3, "  "), (4, "nowhere found"), (5, "Übung É a1 zzz"), (1, "same W9"), (None, "w1 w1 w2"), (7, " ".join(f"w{i}" for i in range(37)))]


def brute_search(docs, items, k):
    low = {c: c + 32 for c in range(65, 91)}
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    rows = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    of = {}
    for item_id, t in items:
        of.setdefault(item_id, set()).update(terms(t))
    df = {t: sum(t in ts for _, ts in rows) for t in set().union(*of.values())}
    out = []
    for item_id, own in of.items():
        scores = []
        for doc_id, ts in rows:
            score = 0
            for t in own & set(ts):
                m, tf = 100 - 50 + (50 * len(ts) * n_docs) // n_terms, ts.count(t)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scores.append((score, doc_id))
        scores.sort(key=lambda s: (-s[0], s[1] is not None, s[1] or 0))
        out += [(item_id, i + 1, doc_id, score) for i, (score, doc_id) in enumerate(scores[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k,items,cells", [(5, 256, 1 << 22), (50, 2, 64), (1, 1, 1)])
def test_search(spark, monkeypatch, k, items, cells):
    """Whole rankings, with one block and many, a floor that cuts and one that does not."""
    monkeypatch.setattr(search, "ITEMS", items)
    monkeypatch.setattr(search, "CELLS", cells)
    docs = [(None if i == 30 else i, t) for i, t in enumerate(TEXTS)] + [(9, "same words here")]
    frame = spark.createDataFrame([(*d, 0) for d in docs], "doc_id long, text string, key int").repartition(5)
    got = search.search(frame, spark.createDataFrame(ITEMS, "item_id long, text string"), k).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(docs, ITEMS, k)
    assert all(type(r["rank"]) is int for r in got)


def test_search_bounds(spark):
    """Bytes bound every share, and the candidates hold every best document but not all."""
    tf, m = np.array([1, 1, 2, 7, 10**6, 10**9]), np.array([50, 10**6, 77, 50, 50, 10**9])
    g = search.share(tf, m)
    code = (g + search.STEP - 1) // search.STEP
    assert (code <= 255).all() and (g <= code * search.STEP).all() and (g >= (code - 1) * search.STEP + (code > 0)).all()
    docs = spark.createDataFrame(list(enumerate(TEXTS * 5)), "doc_id long, text string")
    index, n = search.build_index(docs)
    block = next(search.blocks(search.item_terms(spark.createDataFrame(ITEMS[:1], "item_id long, text string"))))
    query = search._Query(block, index, n)
    found = search.candidates(index, query, 3)
    exact = {r.doc_id: r.score for r in search.rescored(index, query, found).collect()}
    assert 3 <= len(exact) < sum(t is not None and any(w in t for w in ("one", "two", "w3", "w5")) for t in TEXTS) * 5
    keys = {r.key: r.doc_id for r in index.collect()}
    assert all(r.low <= exact[keys[r.key]] <= r.high for r in found.collect())


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert search.search(docs, items).count() == 0
    assert search.search(spark.createDataFrame([(1, "one")], docs.schema), items.where("item_id = 99")).count() == 0
    assert search.search(spark.createDataFrame([(1, None), (2, "")], docs.schema), items).count() == 0


def brute_audit(codes):
    """Cheapest audit by search over whole edit strings, least (cost, audit) first."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, at, roles = heapq.heappop(heap)
        if at == len(codes) and re.fullmatch(r"(s?(ua)+)?", roles):
            return cost, audit
        if (at, roles[-1:]) in seen:
            continue
        seen.add((at, roles[-1:]))  # of one place the least (cost, audit) comes first
        if len(audit) > 2 * len(codes) + 2:
            continue
        row = codes[at : at + 1]
        more = 3 * row.isupper()
        steps = [(3, "I", at, r) for r in "ua"]
        if row:
            steps.append((4, "D", at + 1, ""))
            if row != "x":
                steps.append((more, "K", at + 1, row.lower()))
                steps += [(3 + more, "R", at + 1, r) for r in "ua"]
        for c, e, to, r in steps:
            now = roles + r
            if re.fullmatch(r"s?(ua)*u?", now):
                heapq.heappush(heap, (cost + c, audit + e, to, now))


def test_audits_by_brute_force():
    for n in range(4):
        for codes in itertools.product("suaxoSUAO", repeat=n):
            assert conversations.Solver("".join(codes)).solve() == brute_audit("".join(codes)), codes
    rng = np.random.default_rng(3)
    for _ in range(150):
        codes = "".join(rng.choice(list("ssuuaaxoSUAO"), 6))
        assert conversations.Solver(codes).solve() == brute_audit(codes), codes
    cost, audit = conversations.Solver("ua" * 50_000 + "u").solve()
    assert cost == 3 and audit == "K" * 100_001 + "I"


def brute_repair(rows):
    """The contract over plain rows (conv_id, turn, role, text)."""
    damaged, ids = {}, {r[0] for r in rows}
    for conv_id, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged.setdefault(conv_id, []).extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    out = {}
    for conv_id in ids:
        own = sorted(damaged.get(conv_id, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, codes, seen = [], "", set()
        for _, role, text in own:
            shown = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            fault = "blank" if not shown.strip("\x20\t\n\x0b\x0c\r") else "duplicate" if (role, text) in seen else "" if shown[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            c = role[0] if role[:1] in ("s", "u", "a") else "o"
            codes += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = brute_audit(codes) if len(codes) < 7 else conversations.Solver(codes).solve()
        left, at, roles = [], 0, ""
        for e in audit:
            due = "assistant" if roles[-1:] == "u" else "user"
            if e == "I":
                left.append(f"{due}:")
            elif e == "K":
                due = own[at][1]
                left.append(f"{due}:{own[at][2]}")
            elif e == "R":
                left.append(f"{due}:{own[at][2]}")
            roles += due[0] if e in "IKR" else ""
            at += e != "I"
        assert re.fullmatch(r"(s?(ua)+)?", roles)
        out[conv_id] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def test_conversations(spark):
    rng = np.random.default_rng(8)
    texts = [None, "", " \n", "Fine.", "Cut off", "Ünïcode! ", "Really?\n\t", "a.b", "." * 5, "Long. " * 50]
    roles = ["system", "user", "assistant", "tool", None, "", "User", "users"]
    rows = [(int(c), None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[rng.integers(0, 8) if rng.random() < 0.3 else rng.integers(0, 3)], texts[rng.integers(0, len(texts))]) for c in range(150) for _ in range(rng.integers(1, 6))]
    rows += [(None, 0, "user", "No id."), (None, 1, "assistant", "Yes."), (999, 7, "user", "hm."), (999, 7, "user", "hm.")]
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((gone, 0, "user", "All gone."))
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, audit int").repartition(4)
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_report(conversations.damaged(frame)).collect()}
    want = brute_repair(rows)
    assert got == want
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    # the repaired rows themselves give the digests
    left = {}
    for r in sorted(conversations.repaired(conversations.damaged(frame)).collect(), key=lambda r: r["at"]):
        left.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(left.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}
    assert conversations.repair_report(spark.createDataFrame([], frame.schema)).count() == 0


def test_long_conversation(spark, monkeypatch):
    """One conversation of many blocks of codes, and the whole table at sf0.001."""
    monkeypatch.setattr(conversations, "BLOCK", 7)
    rows = [(5, i, ["user", "assistant"][i % 2], f"Text {i}.") for i in range(500)]
    got = conversations.repair_report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got.audit == "K" * 500 and got.cost == 0
    assert got.repaired_sha256 == hashlib.sha256("\n".join(f"{r[2]}:{r[3]}" for r in rows).encode()).hexdigest()
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    want = brute_repair([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert {r.conv_id: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, SF).collect()} == want


def test_search_query_by_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(map(tuple, queries.op12_search(spark, SF).collect()), key=repr) == brute_search(docs, items, 50)
    assert textnum.word_bytes("alnum").sum() == 10 + 26 + 128


def labels(text):
    return sorted({x[2] for x in licenses.detect(text)})


@pytest.mark.parametrize(
    "text,want",
    [("apache-2.0", ["apache-2.0"]), ("gpl-2.0", ["gpl-2.0"]), ("mpl 2.0", ["mozilla-2.0"]), ("lgpl-2.1", ["lgpl-2.1"]), ("cc-by-sa-4.0", ["cc-by-sa-4.0"]), ("cc by-nc 4.0", ["cc-by-nc-4.0"]),
     ("spdx-license-identifier: apache-2.0", ["apache-2.0"]), ("apache 2.0", ["apache-2.0"]), ("gplv3", ["gpl-3.0"]), ("agplv3", ["agpl-3.0"]), ("gnu lgpl v2.1 or later", ["lgpl-2.1"]),
     ("// licensed under the\n//  apache license,\n// version 2.0 (the license)", ["apache-2.0"]), ("mit-0", ["mit-0"]), ("an apache helicopter", [])],
)
def test_license_versions(text, want):
    assert labels(text) == want


def test_license_rules_are_linear():
    """No rule tries the ways to share out a long run of what a space may stand for."""
    for r in licenses.rules():
        for run in (" ", "*", "#", "/", ";\n", " * "):
            for text in (r.keyword + run * 100_000 + r.keyword, run * 100_000 + "gnu " + run * 100_000):
                flat = licenses.Collapsed(text).text
                began = time.perf_counter()
                list(r.regex.finditer(flat))
                assert time.perf_counter() - began < 0.1, (r.label, r.regex.pattern, run)
    began = time.perf_counter()
    assert labels("public domain" + " " * 1_000_000 + "apache" + "\n#" * 500_000 + "license 2.0") == ["apache-2.0", "public-domain"]
    assert time.perf_counter() - began < 3


def test_license_labels_by_brute_force():
    """All rules on a text that was collapsed another way, all pairs for containment, places in
    the text as it was."""
    rng = np.random.default_rng(12)
    parts = ["licensed under the", "mit license", "bsd 3-clause", "gnu", "gpl", "-3.0", "v2", "version 3", "all rights reserved", "cc by-sa", "4.0", "apache license", "or any later version", "creative commons attribution", "public domain", "spdx-license-identifier:", "apache-2.0", "see gnu.org/licenses/lgpl"]
    gaps = [" ", "  ", "\n * ", " // ", "\t", "\n#\n", ";\n"]
    for _ in range(40):
        text = "".join(x for p in rng.choice(parts, 10) for x in (p, rng.choice(gaps)))
        places, flat, i = [], "", 0
        while i < len(text):
            j = i
            while j < len(text) and (text[j].isspace() or text[j] in "*#/;"):
                j += 1
            if j > i and any(c.isspace() for c in text[i:j]):
                places.append((i, j))
                flat += " "
                i = j
            else:
                places.append((i, i + 1))
                flat += text[i]
                i += 1
        found = [(r.priority, m.end() - m.start(), m.start(), m.end(), licenses.versioned(r.label, m)) for r in licenses.rules() if r.keyword in flat for m in r.regex.finditer(flat)]
        kept = []
        for p, _, a, b, label in sorted(found, key=lambda h: (-h[0], -h[1], h[2:])):
            if not any(x <= a and b <= y for x, y, _, _ in kept):
                kept.append((a, b, label, p))
        assert licenses.detect(text) == sorted((places[a][0], places[b - 1][1], label, p) for a, b, label, p in kept)


def brute_fingerprint(text):
    """One-permutation MinHash with dense bins in plain Python, with Spark's xxhash64."""
    def chained(values, seed=42):
        for v in values:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    words = [chained([w]) for w in re.findall(r"[^\x20\x09-\x0D]+", text)]
    shingles = [chained_of(words[i : i + 5], chained) for i in range(len(words) - 4)] if len(words) >= 5 else [chained_of(words, chained)] if words else []
    bins = {}
    for h in shingles:
        bins[(h >> 57) + 64] = min(h, bins.get((h >> 57) + 64, h))
    if not bins:
        return ""
    full = sorted(bins)
    out = ""
    for i in range(128):
        at = i if i in bins else min(full, key=lambda b: ((chained_of([i, b], chained) & (1 << 64) - 1) >> 8) * 128 + full.index(b) & (1 << 63) - 1)
        out += f"{bins[at] & 15:x}"
    return out


def chained_of(values, chained):
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=seed)
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def test_fingerprints_by_brute_force(spark):
    """Whole fingerprints and both likenesses, and their error against true similarities."""
    rng = np.random.default_rng(21)
    words = [f"w{i}" for i in range(3000)]
    texts = [None, "", " \n", "one", "a b c d", "a b c d e", "é ü 😀 x y z"] + [" ".join(rng.choice(words, rng.integers(100, 600))) for _ in range(120)]
    got = {r.doc_id: r for r in fingerprint.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    like = lambda a, b: float(a == b) if not a or not b else min(1.0, max(0.0, (sum(x == y for x, y in zip(a, b)) / 128 - 1 / 16) / (15 / 16)))
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.split()] for i in range(len(w) - 4)}
    errors = []
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i - 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert r.fingerprint == brute_fingerprint(t) and r.edited_fingerprint == brute_fingerprint(edited), i
        assert r.near_edited == pytest.approx(like(r.fingerprint, r.edited_fingerprint)) and r.near_next == pytest.approx(like(r.fingerprint, got[(i - 1) % len(texts)].fingerprint))
        if i > 6:
            a, b = sets(t), sets(edited)
            errors.append(r.near_edited - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.07, (np.mean(errors), np.std(errors))


def brute_phrases(text, sample):
    at = count = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample and text[at] in sample:
            n += 1
        at, count = at + n, count + 1
    return count


@pytest.mark.parametrize("page", [1, 2, 256])
def test_language_by_brute_force(spark, page):
    """Every prediction and score from the samples, in one page of languages and in several."""
    rng = np.random.default_rng(31)
    letters = {"aa": "abcde ", "bb": "abcfg ", "cc": "xyzäö ", "dd": "abxyé "}
    word = lambda lang, n: "".join(rng.choice(list(letters[lang]), n)).strip()
    rows = [(i, word(lang, 200), lang) for i, lang in enumerate(list(letters) * 25)] + [(None, word("aa", 50), "aa"), (200, None, "bb"), (201, "12 !", "cc"), (202, word("dd", 3000), None), (3, word("cc", 90), "cc"), (3, word("dd", 90), "dd"), (203, "ßßß", None), (204, "a", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    samples = langid.learn(frame)
    assert sorted(samples) == sorted(letters)
    want = []
    for doc_id, text, _ in rows:
        # as the parser reads it: letters in lower case, runs of others one space
        t = re.sub(r"[^\w]+|[\d_]+", " ", (text or "").lower())
        costs = [brute_phrases(t, samples[x]) * np.log2(2 + len(samples[x])) / max(1, len(t)) for x in sorted(samples)]
        low = min(costs)
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        some = any(c.isalpha() for c in t)
        want.append((doc_id, held, sorted(samples)[costs.index(low)] if some else "und", round(float(1 / sum(np.exp(-langid.SHARPNESS * (c - low) / max(low, 1e-9)) for c in costs)), 6) if some else 0.0))
    got = [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in langid.languages(frame, page=page).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_toxicity_patterns_need_company(spark):
    """The whole query learns company: insults among the corpus's words count, alone they don't."""
    rng = np.random.default_rng(41)
    words = [f"wort{c}" for c in "abcdefghij"]
    rows = []
    for i in range(300):
        own = list(rng.choice(words, 12))
        if i % 3 == 0:
            own.insert(int(rng.integers(2, 10)), "schurke")
        rows.append((i, " ".join(own) + ".", int(i % 3 == 0)))
    rows += [(1000, "schurke", None), (1001, "idiot", None), (1002, "wortb wortc schurke worta.", None), (1003, None, None), (1004, "wortb wortc worta.", None)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[2] is not None], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [r for r in rows if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[d].held_out and got[d].predicted == toxic for d, _, toxic in held)
    assert got[1000].strength == got[1001].strength == 0 and got[1002].predicted == 1 and got[1003].predicted == got[1004].predicted == 0
