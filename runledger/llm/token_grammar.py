"""Token-id output with Re-Pair grammar compression (operator 1).

Texts are range-partitioned by doc_id and encoded in order; every partition is written as a
sequence of *blocks* of about ``block_tokens`` ids. A block is its own grammar: in rounds,
the most frequent pairs of neighbouring symbols (never across a document end) become
nonterminals, until no pair occurs ``min_count`` times (24). The block's payload holds the
rules, their expansion lengths, the start of each document in symbols and in ids, and the
symbol sequence, so one document (or one id) decodes without the rest of the block.

Files are Parquet tables of blocks (shard, block, min_id, max_id, n_docs, n_tokens, payload),
the smallest and largest doc_id of a block beside its payload, written by Spark's committer and therefore safe against lost executors and repeated tasks.

Payload, little-endian: magic ``RPG1``, uint32 counts (docs, rules, symbols), then arrays:
ids int64[docs], id present uint8[docs], symbol start uint32[docs + 1], id start
uint64[docs + 1], rule left and right uint32[rules], expansion length uint32[rules],
symbols uint32[symbols], the last three kinds as four byte planes each. Symbols below
FIRST_RULE are token ids; FIRST_RULE + r is rule r.

The encoder cuts texts by the byte-level pre-tokenizer's own pattern and remembers the ids that
the library's model gives for a pre-token. The pattern knows the characters whose kind has not
changed since Unicode 3.2; what stands between two spaces with any other character in it, and a
text that holds one of the tokenizer's added tokens, is encoded by the library as it is.

Defined cases: null text is empty, so its only id is the end id; a null doc_id sorts first;
repeated rows are encoded again each, in order of (doc_id, text); an empty table writes no
block; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from functools import lru_cache
from unicodedata import category, ucd_3_2_0

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, new_path, slots

MAGIC, FIRST_RULE, END_ID = b"RPG1", 1 << 17, 2
BLOCK_TOKENS = 1 << 20
#: Texts turned into Python strings at a time.
GROUP = 512
BLOCKS = "shard int, block int, min_id long, max_id long, n_docs int, n_tokens long, payload binary"


@lru_cache(maxsize=1)
def pretokens() -> tuple[re.Pattern, re.Pattern, dict[int, str]]:
    """The byte-level pre-tokenizer's pattern over the characters of the basic plane whose kind
    has been the same since Unicode 3.2, so that Python and the library agree about them, each
    other character being a match of its own; one known character; the letters that stand for bytes."""
    kinds: dict[str, list[int]] = {"L": [], "N": [], "O": [], "S": []}
    for c in range(1 << 16):
        kind = category(chr(c))
        if kind == ucd_3_2_0.category(chr(c)) and kind not in ("Cn", "Cs"):
            space = chr(c).isspace() and not 28 <= c <= 31
            kinds["S" if space else kind[0] if kind[0] in "LN" else "O"].append(c)
    known = {}
    for kind, codes in kinds.items():
        at = np.array(codes)
        cuts = np.flatnonzero(np.diff(at) != 1)
        known[kind] = "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(at[[0, *(cuts + 1)]], at[[*cuts, -1]]))
    pattern = re.compile(" ?[{L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{N}]+| ?[{O}]+|[{S}]+(?![^{S}])|[{S}]+|[\\s\\S]".format(**known))
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return pattern, re.compile("[{L}{N}{O}{S}]".format(**known)), dict(zip([*own, *rest], map(chr, [*own, *range(256, 256 + len(rest))])))


class Pieces(dict):
    """Ids, as bytes, of pre-tokens: at most MOST (some 200 MB), then anew."""

    MOST, LONGEST = 800_000, 64

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        how = self.tokenizer.pre_tokenizer
        how = json.loads(how.__getstate__()) if how else {}
        self.plain = self.tokenizer.normalizer is None and how.get("type") == "ByteLevel" and how["use_regex"] and not how["add_prefix_space"]
        self.pattern, self.known, self.letters = pretokens()

    def alone(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        if piece[0] == " " and piece.isascii() and piece[1:].isalpha():
            key = "\u0120" + piece[1:]
        elif len(piece) > 1 or self.known.match(piece):
            key = piece.encode().decode("latin-1").translate(self.letters)
        else:
            raise KeyError(piece)
        data = array("I", [t.id for t in self.tokenize(key)]).tobytes()
        if len(piece) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = data
        return data

    def cut(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, little-endian uint32."""
        if not self.plain or any(a in text for a in self.added):
            return self.alone(text) if text else b""
        try:
            return self.cut(text)
        except KeyError:
            out = []
            for part in _BEFORE_WORD.split(text):  # those with characters not known to be of one kind are the library's
                try:
                    out.append(self.cut(part))
                except KeyError:
                    out.append(self.alone(part))
            return b"".join(out)

    def encode_many(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]


#: The pre-tokenizer never joins across a space and what follows it.
_BEFORE_WORD = re.compile(r"(?= \S)")


@lru_cache(maxsize=2)
def _pieces(path: str) -> Pieces:
    return Pieces(path)


def compress(seq: np.ndarray, last: np.ndarray, per_round: int = 1024, min_count: int = 24):
    """Re-Pair in batches: (symbols, position of each kept symbol's end mark, left, right, length)."""
    left, right, length = [np.zeros(0, np.uint32)], [np.zeros(0, np.uint32)], np.zeros(0, np.uint32)
    n_rules = 0
    while len(seq) > 1:
        a, b = seq[:-1], seq[1:]
        bucket = (((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77))) >> np.uint32(14)).astype(np.intp)
        bucket[last[:-1]] = 1 << 18  # never counted
        counts = np.bincount(bucket, minlength=1 << 18)[: 1 << 18]
        every = np.flatnonzero(counts >= min_count)
        top = every[np.argpartition(counts[every], -per_round)[-per_round:]] if len(every) > per_round else every
        # a bucket may be full of rare pairs: if all of the top ones are, every full bucket is tried
        for full in (top, every):
            hot = np.zeros((1 << 18) + 1, bool)
            hot[full] = True
            at = np.flatnonzero(hot.take(bucket))
            pair = a[at].astype(np.uint64) << np.uint64(32) | b[at]
            kinds, which, n = np.unique(pair, return_inverse=True, return_counts=True)
            take = n >= min_count
            at, which = at[take[which]], which[take[which]]
            if len(at):
                break
        else:
            break
        # in a stretch of overlapping occurrences every other one is replaced
        fresh = np.ones(len(at), bool)
        fresh[1:] = np.diff(at) != 1
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        keep = (np.arange(len(at)) - begin) % 2 == 0
        at, which = at[keep], which[keep]
        kept = np.bincount(which, minlength=len(kinds)) > 0
        used, which = np.flatnonzero(kept), (np.cumsum(kept) - 1)[which]
        l, r = (kinds[used] >> np.uint64(32)).astype(np.uint32), (kinds[used] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        size = lambda s: np.where(s < FIRST_RULE, 1, length[np.maximum(s.astype(np.int64) - FIRST_RULE, 0)] if n_rules else 1)
        length = np.concatenate([length, (size(l) + size(r)).astype(np.uint32)])
        left.append(l)
        right.append(r)
        seq = seq.copy()
        seq[at] = FIRST_RULE + n_rules + which.astype(np.uint32)
        last = last.copy()
        last[at] |= last[at + 1]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq, last, n_rules = seq[stay], last[stay], n_rules + len(used)
    return seq, last, np.concatenate(left), np.concatenate(right), length


def _planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(data: memoryview, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n).reshape(4, n).T).view("<u4").reshape(n)


def pack(ids: list[int | None], docs: list[bytes]) -> bytes:
    """The payload of a block of documents given as id bytes, each with its end id."""
    sizes = np.array([len(d) // 4 for d in docs], np.uint64)
    seq = np.frombuffer(b"".join(docs), np.uint32)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(sizes).astype(np.int64) - 1] = True
    symbols, ends, left, right, length = compress(seq, last)
    at = np.concatenate([[0], np.flatnonzero(ends) + 1]).astype("<u4")
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
    head = MAGIC + struct.pack("<III", len(docs), len(left), len(symbols))
    known = np.array([i is not None for i in ids], np.uint8)
    return b"".join([head, np.array([i or 0 for i in ids], "<i8").tobytes(), known.tobytes(), at.tobytes(), starts.tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), _planes(length), _planes(symbols)])


class Block:
    """A payload opened for reading."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n_docs, self.n_rules, n = struct.unpack_from("<III", payload, 4)
        view, p = memoryview(payload), 16

        def read(kind: str, count: int) -> np.ndarray:
            nonlocal p
            out = np.frombuffer(view, kind, count, p)
            p += out.nbytes
            return out

        self.ids, self.known = read("<i8", self.n_docs), read("u1", self.n_docs)
        self.at, self.starts = read("<u4", self.n_docs + 1), read("<u8", self.n_docs + 1)
        self.left, self.right = read("<u4", self.n_rules), read("<u4", self.n_rules)
        self.length = _unplanes(view[p:], self.n_rules).astype(np.int64)
        self.symbols = _unplanes(view[p + 4 * self.n_rules :], n)
        self._flat = None

    def _expansions(self):
        if self._flat is None:
            offset = np.cumsum(self.length) - self.length
            flat = np.empty(int(self.length.sum()), np.uint32)
            for r in range(self.n_rules):
                p = int(offset[r])
                for s in (int(self.left[r]), int(self.right[r])):
                    if s < FIRST_RULE:
                        flat[p] = s
                        p += 1
                    else:
                        o, n = int(offset[s - FIRST_RULE]), int(self.length[s - FIRST_RULE])
                        flat[p : p + n] = flat[o : o + n]
                        p += n
            self._flat = offset, flat
        return self._flat

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        offset, flat = self._expansions()
        rule = symbols >= FIRST_RULE
        size = np.ones(len(symbols), np.int64)
        r = symbols[rule].astype(np.int64) - FIRST_RULE
        size[rule] = self.length[r]
        start = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint32)
        out[start[~rule]] = symbols[~rule]
        n = size[rule]
        within = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(start[rule], n) + within] = flat[np.repeat(offset[r], n) + within]
        return out

    def document(self, i: int) -> np.ndarray:
        """The ids of document i alone."""
        return self.expand(self.symbols[self.at[i] : self.at[i + 1]])

    def documents(self):
        """(doc_id, ids) of all documents."""
        whole = self.expand(self.symbols)
        for i in range(self.n_docs):
            yield (int(self.ids[i]) if self.known[i] else None), whole[int(self.starts[i]) : int(self.starts[i + 1])]


def _encode(path: str, block_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        shard, block, ids, docs, total = TaskContext.get().partitionId(), 0, [], [], 0
        pieces = _pieces(path)

        def flush():
            nonlocal block, ids, docs, total
            known = [i for i in ids if i is not None]
            row = [[shard], [block], [min(known, default=None)], [max(known, default=None)], [len(ids)], [total], [pack(ids, docs)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            out = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], ["shard", "block", "min_id", "max_id", "n_docs", "n_tokens", "payload"])
            block, ids, docs, total = block + 1, [], [], 0
            return out

        end = np.array([END_ID], np.uint32).tobytes()
        for batch in batches:
            for i in range(0, batch.num_rows, GROUP):
                part = batch.slice(i, GROUP)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    data = pieces.encode(text or "")
                    ids.append(doc_id)
                    docs.append(data + end)
                    total += len(data) // 4 + 1
                    if total >= block_tokens:
                        yield flush()
        if ids:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text of ``docs`` in ascending doc_id order into block files under ``path``."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(slots(docs), F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    # payloads are grammar-coded bytes already; zstd takes what the byte planes leave
    rows.mapInArrow(_encode(tokenizer, block_tokens), BLOCKS).write.option("compression", "zstd").parquet(path)


def _decode(batches):
    for batch in batches:
        for shard, block, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            b = Block(payload.as_py())
            ids, count, crc = [], [], []
            for doc_id, tokens in b.documents():
                ids.append(doc_id)
                count.append(len(tokens))
                crc.append(zlib.crc32(tokens.astype("<u4").tobytes()))
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(b.starts[:-1].astype(np.int64)), pa.array(count, pa.int64()), pa.array(crc, pa.int64())], ["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"])


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``."""
    files = spark.read.schema(BLOCKS).parquet(path)
    # offsets: first of the shards (one row each), then of the blocks inside a shard
    per = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    per = per.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    inside = files.select("shard", "block", (F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_tokens")).alias("inner"))
    base = inside.join(per, "shard").select("shard", "block", (F.col("base") + F.col("inner")).alias("base"))
    rows = files.select("shard", "block", "payload").mapInArrow(_decode, "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(base, ["shard", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokens_of(spark: SparkSession, path: str, doc_id: int) -> list[int]:
    """Random access: the ids of the first document under ``doc_id``. Blocks are found by their
    smallest and largest id, which Parquet's statistics prune; payloads are read of one block
    at a time, in order, until one holds the document."""
    files = spark.read.schema(BLOCKS).parquet(path)
    may = files.where((F.col("min_id") <= doc_id) & (F.col("max_id") >= doc_id))
    for shard, block in may.select("shard", "block").orderBy("shard", "block").toLocalIterator():
        b = Block(bytes(may.where((F.col("shard") == shard) & (F.col("block") == block)).select("payload").first()[0]))
        for i in np.flatnonzero((b.ids == doc_id) & (b.known == 1)):
            return b.document(int(i)).tolist()
    return []


def token_table(docs: DataFrame, tokenizer: str, path: str | None = None) -> DataFrame:
    """Write the files and return their digests."""
    spark = docs.sparkSession
    path = path or new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer)
    return cut(read_digests(spark, path), "digests")
