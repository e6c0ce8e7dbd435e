"""Language identification by cross-parsing entropy (operator 4).

For each language a suffix automaton is built over a bounded sample of its labelled text. A
text is parsed greedily against each automaton: a phrase is the longest match from where the
last one ended. The fewer phrases a text needs, normalised by its length and by the size of
the sample (phrases x log2(sample) / characters), the closer it is to the language; the
cheapest language wins.

All texts of a batch are parsed together: texts are cut into segments, and one numpy step
advances every segment by one character through the automaton's transition table. Each
segment is first parsed as if a phrase began with it. Then the phrase that the segment before
really ended in is carried on into it, until a phrase of the true parse begins where one of
the segment's own does: from there on both are the same. So counts are those of one unbroken
parse of the whole text, at any segment length. Texts whose parses do not meet within a
segment (long runs of one pattern) are parsed character by character.

The sample has at most ``sample_docs`` documents a language, chosen by a hash of doc_id, from
each a window of ``sample_chars`` / 8 characters at a place chosen by the same hash,
``sample_chars`` normalised characters a language (64 and 32,768). Languages are learned and
broadcast in pages of at most ``page`` (256): automata and broadcast do not grow with the
corpus, and of many languages every page adds its costs to each text's before one is chosen.
Every text is predicted whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
labelled row all are ``und``; ties go to the language that sorts first; a null doc_id is
predicted like any other row, is not held out and teaches nothing; repeated rows teach once,
and of different texts under one doc_id and lang one teaches;
a letter that no sample has is a phrase of its own; other columns are ignored; doc_id is cast
to long.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

SEGMENT, CHUNK = 512, 1_500_000
HELD = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"
SHARPNESS = 12.0


def normal(text: str) -> str:
    """Letters in lower case; every run of other characters is one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all substrings of ``codes``; state 0 is the start."""
    moves, link, size, last = [{}], [-1], [0], 0
    for c in codes:
        cur = len(moves)
        moves.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[q] == size[p] + 1:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Parser:
    """Automata of all languages over one alphabet. Code 0 is the space, the last code any
    letter that no sample has."""

    def __init__(self, samples: dict[str, str]):
        self.langs = sorted(samples)
        letters = sorted({c for s in samples.values() for c in s} - {" "})
        self.width = len(letters) + 2
        self.code = np.zeros(0x110000, np.int16)
        everything = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        self.code[[ord(c) for c in everything if c.isalpha()]] = self.width - 1
        for i, c in enumerate(letters):
            self.code[ord(c)] = i + 1
        self.tables, self.bits, self.dead = [], [], []
        for lang in self.langs:
            moves = suffix_automaton(self.code[np.array([ord(c) for c in samples[lang]], np.int64)].tolist() if samples[lang] else [])
            # the last state has no moves: a text begins in it, and so does what follows an unknown letter
            flat = np.full((len(moves) + 1, self.width), -1, np.int32)
            for s, m in enumerate(moves):
                if m:
                    flat[s, list(m)] = np.fromiter(m.values(), np.int32, len(m)) * self.width
            self.tables.append(flat.ravel())
            self.dead.append(len(moves) * self.width)
            self.bits.append(np.log2(2 + len(samples[lang])))

    def plain(self, codes: list[int], lang: int) -> int:
        """Phrases of one text, character by character."""
        flat, dead, count = self.tables[lang], self.dead[lang], 0
        state = dead
        for c in codes:
            to = int(flat[state + c])
            if to < 0:
                count += 1
                to = int(flat[c])
                to = dead if to < 0 else to
            state = to
        return count

    def phrases(self, codes: np.ndarray, first: np.ndarray, n: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
        """Phrases of each text (first, n: where its codes are) by language."""
        total = np.zeros((len(self.langs), len(n)))
        parts = -(-n // segment)
        of = np.repeat(np.arange(len(n)), parts)
        at = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        start, size = first[of] + at * segment, np.minimum(segment, n[of] - at * segment)
        order = np.argsort(-size, kind="stable")
        alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
        follows = np.flatnonzero(at > 0)
        for lang, flat in enumerate(self.tables):
            dead = self.dead[lang]
            begins = np.zeros(len(codes) + 1, np.int32)  # where phrases of the segments begin
            state = np.full(len(of), dead, np.int32)
            for p in range(len(alive)):
                own = order[: int(alive[p])]
                state[own], bad = self._step(flat, dead, state[own], codes[start[own] + p])
                begins[start[own][bad] + p] = 1
            upto = np.concatenate([[0], np.cumsum(begins[:-1])])
            count = (upto[start + size] - upto[start]).astype(np.int64)
            # carry the true parse over each joint
            lane, s, p, lost = follows, state[follows - 1], 0, []
            extra = np.zeros(len(of), np.int64)
            while len(lane):
                over = p >= size[lane]
                if over.any():
                    lost.append(lane[over])
                    lane, s = lane[~over], s[~over]
                    if not len(lane):
                        break
                s, bad = self._step(flat, dead, s, codes[start[lane] + p])
                here = start[lane[bad]] + p
                met = begins[here] == 1
                # from here on the segment's own count holds
                back = lane[bad][met]
                count[back] = upto[start[back] + size[back]] - upto[start[back] + p]
                extra[lane[bad][~met]] += 1
                stay = np.ones(len(lane), bool)
                stay[bad[met]] = False
                lane, s, p = lane[stay], s[stay], p + 1
            total[lang] = np.bincount(of, weights=count + extra, minlength=len(n))
            for i in np.unique(of[np.concatenate(lost)]).tolist() if lost else ():
                total[lang, i] = self.plain(codes[first[i] : first[i] + n[i]].tolist(), lang)
        return total

    @staticmethod
    def _step(flat: np.ndarray, dead: int, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one character each, and which of them began a phrase with it."""
        to = flat.take(state + c)
        bad = np.flatnonzero(to < 0)
        if len(bad):
            again = flat.take(c[bad])
            to[bad] = np.where(again < 0, dead, again)
        return to, bad

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(costs by text and language, whether the text has a letter)."""
        low = [t.lower() for t in texts]
        size = np.array([len(t) for t in low], np.int64)
        codes = self.code[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)].astype(np.int32)
        owner = np.repeat(np.arange(len(texts)), size)
        # runs of non-letters become one space
        keep = np.ones(len(codes), bool)
        keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
        letters = np.bincount(owner[codes != 0], minlength=len(texts)) > 0
        codes, owner = codes[keep], owner[keep]
        n = np.bincount(owner, minlength=len(texts))
        first = np.cumsum(n) - n
        total = self.phrases(codes, first, n).T
        return total * np.array(self.bits) / np.maximum(n, 1)[:, None], letters


def choose(cost: np.ndarray, letters: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The cheapest language of each text, and its share of exp(-SHARPNESS x excess cost)."""
    if not langs:
        return ["und"] * len(cost), np.zeros(len(cost))
    best = cost.argmin(1)
    low = cost.min(1)
    share = 1 / np.exp(-SHARPNESS * (cost - low[:, None]) / np.maximum(low, 1e-9)[:, None]).sum(1)
    return [langs[b] if ok else "und" for b, ok in zip(best, letters)], np.where(letters, share, 0.0)


def _fit(docs: DataFrame, held: str) -> DataFrame:
    return docs.where(f"doc_id is not null and lang is not null and text is not null and not ({held})")


def pages(docs: DataFrame, held: str = HELD, page: int = 256) -> Iterator[list[str]]:
    """The languages that can be learned, in order, in pages."""
    langs: list[str] = []
    for r in _fit(docs, held).select("lang").distinct().orderBy("lang").toLocalIterator():
        langs.append(r["lang"])
        if len(langs) == page:
            yield langs
            langs = []
    if langs:
        yield langs


def learn(docs: DataFrame, held: str = HELD, sample_docs: int = 64, sample_chars: int = 32_768, langs: list[str] | None = None) -> dict[str, str]:
    """The bounded sample of normalised text of each language, of a page of them or of all."""
    fit = _fit(docs, held).withColumn("h", F.xxhash64("doc_id"))
    fit = fit if langs is None else fit.where(F.col("lang").isin(langs))
    size = fit.groupBy("lang").agg(F.count("*").alias("size"))
    # a share of each language by hash, so that no language is sorted whole
    share = F.pmod("h", F.lit(1 << 30)) * F.col("size") <= F.lit(8 * sample_docs).cast("double") * (1 << 30)
    some = fit.select("doc_id", "lang", "h").join(F.broadcast(size), "lang").where(share).select("doc_id", "lang", "h").distinct()
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = some.withColumn("r", F.row_number().over(by)).where(F.col("r") <= sample_docs).drop("h")
    room = sample_chars // 8  # no document fills more than an eighth of the sample
    at = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - room, F.lit(0)) + 1).cast("int") + 1
    rows = fit.select("doc_id", "lang", F.substring(F.col("text"), at, F.lit(room)).alias("text")).join(F.broadcast(chosen), ["doc_id", "lang"])
    rows = rows.groupBy("lang", "r").agg(F.min("text").alias("text"))  # sample_docs a language at most
    out: dict[str, list[str]] = {}
    for row in sorted(rows.collect(), key=lambda x: (x["lang"], x["r"])):
        out.setdefault(row["lang"], []).append(normal(row["text"]))
    return {lang: " ".join(dict.fromkeys(t for t in parts if t))[:sample_chars] for lang, parts in out.items()}


def predict(docs: DataFrame, samples: Iterable[dict[str, str]], held: str = HELD) -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of ``docs``, from one page of samples or more."""
    spark, known = docs.sparkSession, []

    def costs_of(page: dict[str, str], last: list[str] | None):
        """The costs of a page behind those of the pages before; at the last page the choice."""
        given = spark.sparkContext.broadcast(page)

        def run(batches):
            parser = Parser(given.value)
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                cost, letters, i = [], [], 0
                while i < len(texts):
                    j, n = i, 0
                    while j < len(texts) and (j == i or n + len(texts[j]) <= CHUNK):
                        n += len(texts[j])
                        j += 1
                    a, b = parser.costs(texts[i:j])
                    cost.append(a.reshape(j - i, len(parser.langs)))
                    letters.append(b)
                    i = j
                if not texts:
                    continue
                cost = np.concatenate(cost)
                if len(batch.columns) > 2:
                    cost = np.concatenate([np.stack([np.asarray(c) for c in batch.column(2).to_numpy(zero_copy_only=False)]), cost], 1)
                if last is None:
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(cost), pa.list_(pa.float64()))], ["doc_id", "text", "costs"])
                else:
                    langs, scores = choose(cost, np.concatenate(letters), last)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    todo = iter(samples)
    page = next(todo, {})
    while page is not None:
        after = next(todo, None)
        known += sorted(page)
        if after is None:
            rows = rows.mapInArrow(costs_of(page, list(known)), "doc_id long, lang_pred string, score double")
        else:
            rows = cut(rows.mapInArrow(costs_of(page, None), "doc_id long, text string, costs array<double>"), "costs")
        page = after
    return rows.select("doc_id", F.coalesce(F.expr(held), F.lit(False)).alias("held_out"), "lang_pred", "score")


def languages(docs: DataFrame, page: int = 256) -> DataFrame:
    return predict(docs, (learn(docs, langs=langs) for langs in pages(docs, page=page)))
