"""Benchmark decontamination by a prefix-filtered set join (operator 6).

Items become windows of ``window`` consecutive words (an item of fewer words is one window
of all of them). A window is a set of ``SHINGLE``-word shingles, and a text contains the
window only if it holds all of them, so any one of them is a sufficient prefix: each window
is joined on its rarest. The steps:

1. the items' distinct shingles become a bit map of bounded size (ids beyond it collide and
   only add candidates), broadcast to
2. one scan of the texts, which keeps for each text its number of words and its *runs*:
   stretches of consecutive shingles that the map lets through, with their words;
3. shingles are ordered by how many texts have them in a run; windows keep their rarest one
   and meet the runs on it; its offset fixes the only possible start (positional bound), and
   the window must fit inside the run (length bound);
4. the words of the run and the window are compared one by one: containment is exact.

Hit words are unions of verified windows. Nothing grows with the square of a passage's
copies: a run yields at most one candidate per shingle and distinct window.

Defined cases: null and blank texts have no words and no hits; empty items yield no window;
repeated items count under each item_id; repeated rows (equal doc_id) each get a row of
their own; a null item_id never counts as an item but its words hit; empty tables give rows
without hits; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textnum as tn
from .common import ALNUM_WORD, ascii_lower, cut, tidy, without
from .posting import id_filter

SHINGLE = 5
_RUN = pa.struct([("start", pa.int32()), ("words", pa.list_(pa.string()))])


def _shingle_table(k: int):
    """Per item window its shingle hashes; the words stay beside them."""

    def run(batches):
        for batch in batches:
            hashes = []
            for words in batch.column(1).to_pylist():
                text = pa.array([" ".join(words)])
                w = next(iter(tn.words(text, "alnum")))
                hashes.append(tn.signed(tn.roll(w.hash, min(k, len(words)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), tn.lists(hashes, pa.int64())], ["win", "words", "shingles"])

    return run


def _scan(k: int, window: int, shorter: list[int], wanted):
    """Per text: n_words and its runs. ``shorter``: sizes of windows below k words."""

    def run(batches):
        bits = wanted.value
        top = np.uint64(len(bits) * 8 - 1)

        def there(h: np.ndarray) -> np.ndarray:
            at = (h & top).astype(np.int64)
            return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)

        for batch in batches:
            count, all_runs = [], []
            for w in tn.words(batch.column(1), "alnum"):
                marks = {size: there(tn.roll(w.hash, size)) for size in [k, *shorter]}
                count += np.diff(w.off).tolist()
                for i in range(w.n):
                    a, b = int(w.off[i]), int(w.off[i + 1])
                    runs = []
                    for size, mark in marks.items():
                        m = np.flatnonzero(mark[a : max(a, b - size + 1)])
                        if not len(m):
                            continue
                        for part in np.split(m, np.flatnonzero(np.diff(m) > 1) + 1):
                            lo, hi = int(part[0]), int(part[-1]) + size
                            runs.append({"start": lo, "words": [w.word(a + x) for x in range(lo, hi)]})
                    all_runs.append(runs)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count, pa.int64()), pa.array(all_runs, pa.list_(_RUN))], ["doc_id", "n_words", "runs"])

    return run


def _run_shingles(sizes: list[int]):
    """(row, start of the run, words, place, hash) for every shingle of every run."""

    def run(batches):
        for batch in batches:
            rid, run_no, place, hashes = [], [], [], []
            for r, no, words in zip(*(batch.column(c).to_pylist() for c in range(3))):
                w = next(iter(tn.words(pa.array([" ".join(words)]), "alnum")))
                for size in sizes:
                    h = tn.signed(tn.roll(w.hash, size)) if len(words) >= size else np.zeros(0, np.int64)
                    rid += [r] * len(h)
                    run_no += [no] * len(h)
                    place += range(len(h))
                    hashes += h.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(run_no, pa.int32()), pa.array(place, pa.int32()), pa.array(hashes, pa.int64())], ["rid", "run_no", "place", "shingle"])

    return run


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """(win, words, item_ids): distinct windows with the items that hold them."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(ALNUM_WORD), F.lit(0))
    rows = items.select("item_id", words.alias("w")).where(F.size("w") > 0)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0))), lambda i: F.slice("w", i + 1, window))
    rows = rows.select("item_id", F.explode(each).alias("words")).distinct()
    return rows.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(F.xxhash64("words").alias("win"), "words", "item_ids")


@tidy
def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated per row of ``docs``."""
    spark, k = docs.sparkSession, min(SHINGLE, window)
    windows = cut(item_windows(items, window), "windows")
    table = cut(windows.select("win", "words").mapInArrow(_shingle_table(k), "win long, words array<string>, shingles array<long>"), "shingles")
    sizes = [r[0] for r in windows.where(F.size("words") < k).select(F.size("words")).distinct().collect()]
    shortest = windows.agg(F.min(F.size("words"))).first()[0] or 0
    wanted = id_filter(table.select(F.explode("shingles").alias("s")).distinct(), "s")

    scanned = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(k, window, sizes, wanted), "doc_id long, n_words long, runs array<struct<start:int,words:array<string>>>")
    scanned = cut(scanned.withColumn("rid", F.monotonically_increasing_id()), "scanned")
    runs = scanned.where(F.size("runs") > 0).select("rid", F.posexplode("runs").alias("run_no", "run")).where(F.size("run.words") >= shortest)
    runs = cut(runs.select("rid", "run_no", F.col("run.words").alias("run_words"), F.col("run.start").alias("run_start")), "runs")
    at = cut(runs.select("rid", "run_no", "run_words").mapInArrow(_run_shingles([k, *sizes]), "rid long, run_no int, place int, shingle long"), "places")

    df = at.groupBy("shingle").agg(F.count("*").alias("df"))
    offered = table.select("win", F.posexplode("shingles").alias("off", "shingle")).join(df, "shingle")
    whole = table.select("win", F.size("shingles").alias("need"))
    # a window with a shingle that no run has can't occur; of the others the rarest one is joined
    rarest = offered.groupBy("win").agg(F.min(F.struct("df", "shingle", "off")).alias("r"), F.count("*").alias("have"))
    rarest = rarest.join(whole, "win").where("have = need").select("win", F.col("r.shingle").alias("shingle"), F.col("r.off").alias("off"))
    anchors = cut(rarest.join(windows.select("win", "words"), "win"), "anchors")

    met = at.join(anchors, "shingle").select("rid", "run_no", (F.col("place") - F.col("off")).alias("lo"), "win", "words").where("lo >= 0")
    met = met.join(runs, ["rid", "run_no"]).where(F.col("lo") + F.size("words") <= F.size("run_words"))
    met = met.where(F.slice("run_words", F.col("lo") + 1, F.size("words")) == F.col("words"))
    hits = cut(met.select("rid", (F.col("run_start") + F.col("lo")).alias("lo"), F.size("words").alias("len"), "win").distinct(), "hits")

    # hit words: each window covers lo..lo+len-1; overlapping ones are united by counting words once
    covered = hits.select("rid", F.explode(F.sequence("lo", F.col("lo") + F.col("len") - 1)).alias("w")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    held = hits.select("rid", "win").distinct().join(windows.select("win", F.explode("item_ids").alias("item_id")), "win").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    held = held.groupBy("rid").agg(F.count("*").alias("n_items"), F.sha2(F.concat_ws(",", F.sort_array(F.collect_set("item"))), 256).alias("items_sha256"))
    out = scanned.select("rid", "doc_id", "n_words").join(covered, "rid", "left").join(held, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; all their columns. Whether a
    row goes is settled by its text (told apart by a 64-bit hash), not by its doc_id, so rows
    with a null or repeated id are judged each on its own."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    found = decontaminate(docs.select(key.alias("doc_id"), "text"), items, window).where("contaminated")
    return without(docs, key, found.select("doc_id").distinct())


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS words
  FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, s.n, i, list_slice(w, i, i + s.n - 1) AS words
  FROM d CROSS JOIN sizes s, LATERAL (SELECT unnest(generate_series(1, len(w) - s.n + 1)) AS i) WHERE len(w) >= s.n),
hit AS (SELECT doc_id, i, places.n, item_id FROM places JOIN win ON places.n = win.n AND places.words = win.words),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS x FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
