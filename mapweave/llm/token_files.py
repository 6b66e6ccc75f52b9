"""Token-ID output compressed by Re-Pair grammars.

Documents are range-partitioned by doc_id, tokenized, and cut into shards of about ``shard_tokens`` ids (a document
is never cut). In each shard frequent pairs of symbols are replaced by nonterminals, sweep after sweep, never
across documents. A shard stores its rules, the expansion length of each rule, and where each document's symbols
begin, so a document, or some of its ids, can be read without the rest. Shards are rows of Parquet files that
Spark writes, so they can be in any store.

File format of a shard (little-endian): b"RPR1"; four u4: documents, rules, symbols, vocabulary size; per rule u4
left, u4 right, u4 expansion length; per document u4 number of ids; per document and one more u4 first symbol; the
symbols, u2 if vocabulary and rules are under 2^16 in number, else u4. Symbols from the vocabulary size on are rules.

Null texts count as empty and have the end id alone. Documents are in ascending order of doc_id (null first), ties
by text. An empty table writes no shard and reads as an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import struct
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import named, shared_dir, table

# ---- tokenizing

_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The pre-tokenizer's pattern, for lower-cased texts of the characters below, and a line end as a word of its own.
_WORDS = re.compile(rf"\n|'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
#: Byte-level alphabets write the bytes of these characters as characters: most as themselves, the others after U+0100.
_BYTES = {chr(c): "".join(chr(b if 0xA0 < b != 0xAD else 0xA2 + b if b < 0xA1 else 0x143) for b in chr(c).encode()) for c in range(0xA1, 0x100)}

_WIDE = re.compile(r"[\xa1-\xff]")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, end to end."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(start) or int(start.max()) < 1 << 31) else np.int64
    return np.repeat((start - ends + size).astype(kind), size) + np.arange(total, dtype=kind)


class WordTokenizer:
    """Ids of whole texts, as tokenizers.Tokenizer.encode(text, add_special_tokens=False) gives them.

    The library encodes each different word once for a while (``keep`` characters of words): words are independent of
    each other in this kind of vocabulary (word ends are marked). It gets them already split, so it needn't normalise
    and split them again. Texts with characters beyond Latin-1, or with anything like a special token, go to it whole.
    """

    def __init__(self, vocabulary: str, keep: int = 1 << 22):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok, self.split, self.keep = Tokenizer.from_str(vocabulary), Tokenizer.from_str(vocabulary), keep
        self.split.normalizer, self.split.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.size = self.tok.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.ends = np.zeros(self.size, bool)
        for t, i in self.tok.get_vocab().items():
            self.ends[i] = t.endswith("</w>")
        self._forget()

    def _forget(self) -> None:
        self.code: dict[str, int] = defaultdict(count().__next__)  # a new word gets the next number
        self.code["\n"]
        self.pool, self.place, self.length = np.zeros(0, self.kind), np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.chars = 0

    def _ids(self, text: str, tok=None) -> np.ndarray:
        return np.array((tok or self.tok).encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)  # leaves offsets out

    def _learn(self, words: list[str]) -> None:
        ids, sizes = [self.pool], []
        for a in range(0, len(words), 20_000):
            part = words[a : a + 20_000]
            text = " ".join(part)
            self.chars += len(text)
            found = self._ids(text if text.isascii() else _WIDE.sub(lambda m: _BYTES[m[0]], text), self.split)
            cuts = np.flatnonzero(self.ends[found]) + 1
            if len(cuts) != len(part):
                each = [self._ids(w) for w in part]
                found, cuts = np.concatenate(each), np.cumsum([len(x) for x in each])
            ids.append(found)
            sizes.append(np.diff(cuts, prepend=0))
        if sizes:
            self.length = np.concatenate((self.length, *sizes))
            self.place = np.cumsum(self.length) - self.length
            self.pool = np.concatenate(ids)

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each."""
        if self.chars > self.keep:
            self._forget()
        whole = {i: t for i, t in enumerate(texts.to_pylist()) if "<|" in t or not _PLAIN.fullmatch(t)}
        if whole:
            texts = pc.if_else(pa.array(np.isin(np.arange(len(texts)), list(whole))), "", texts)
        chunks = pc.ascii_split_whitespace(texts)
        coded = chunks.values.dictionary_encode()
        every = pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), pc.utf8_lower(coded.dictionary))
        words = _WORDS.findall((pc.binary_join(every, "\n")[0].as_py() or "") + "\n")
        before = len(self.code)
        codes = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        self._learn(list(islice(self.code, before, None)))
        size = self.length[codes]
        flat = self.pool[_ranges(self.place[codes], size)]
        ends = np.cumsum(size)[codes == 0]  # of the different chunks
        size = np.diff(ends, prepend=0)
        code = coded.indices.to_numpy()
        each = size[code]
        ids = flat[_ranges((ends - size)[code], each)]
        counts = np.diff(np.concatenate(([0], np.cumsum(each)))[chunks.offsets.to_numpy()])
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, t in whole.items():
                parts[i] = self._ids(t)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts])
        return ids, counts


# ---- grammar


def repair(ids: np.ndarray, counts: np.ndarray, size: int, max_rules: int, least: int = 8, pairs_a_sweep: int = 4000, gain: float = 0.005) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), the symbols, and each document's number of symbols; ids of documents end to end.

    Each sweep takes the most frequent pairs at once; where chosen pairs overlap, the more frequent one is replaced.
    It ends when no pair occurs ``least`` times (and can be replaced half as often), when max_rules is reached, or after
    a sweep that shortens the whole by less than the share ``gain`` (with 0 some 12 more sweeps shorten prose by 2 %).
    """
    # two symbols in one integer
    half, kind, both = (16, np.uint16, np.uint32) if size + max_rules <= 1 << 16 else (32, np.uint32, np.uint64)
    factor, bits = both(0x9E3779B97F4A7C15 >> (64 - 2 * half) | 1), 20
    x = ids.astype(kind)
    last = np.zeros(len(x), bool)
    last[np.cumsum(counts) - 1] = True
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rules = 0
    while len(x) > 1 and rules < max_rules:
        pair = x[:-1].astype(both)
        pair <<= both(half)
        pair |= x[1:]
        slot = ((pair * factor) >> both(2 * half - bits)).astype(np.intp)  # counts by hash, exact ones for the frequent
        slot[np.flatnonzero(last[:-1])] = 1 << bits  # no pairs across documents
        number = np.bincount(slot, minlength=(1 << bits) + 1)
        number[-1] = 0
        k = min(pairs_a_sweep, max_rules - rules)
        slots = np.flatnonzero(number >= least)
        if not len(slots):
            break
        if len(slots) > k:
            number = number[slots]
            slots = slots[number >= np.partition(number, -k)[-k]]
        # of pairs that share a slot one is taken now; its count is exact
        place = np.full((1 << bits) + 1, -1, np.int32)
        place[slots] = np.arange(len(slots), dtype=np.int32)
        which = place[slot]
        often = np.flatnonzero(which >= 0)
        which, pair_of = which[often], pair[often]
        pairs = np.zeros(len(slots), both)
        pairs[which] = pair_of
        same = pairs[which] == pair_of
        if not same.all():
            often, which = often[same], which[same]
        n = np.bincount(which, minlength=len(slots))
        order = np.argsort(-n, kind="stable")[: max_rules - rules]
        order = order[n[order] >= least]
        if not len(order):
            break
        rank = np.full(len(pairs), len(pairs), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        # a pair is replaced where it ranks before the pairs one symbol earlier and later; of a run of one pair every other is
        own = rank[which]
        near, equal, i = np.diff(often) == 1, own[1:] == own[:-1], np.arange(len(own))
        new = np.concatenate(([True], ~(near & equal)))
        even = (i - np.maximum.accumulate(np.where(new, i, 0))) % 2 == 0
        free = (own < len(order)) & even
        free[1:] &= ~near | (own[1:] <= own[:-1])
        free[:-1] &= ~near | (own[:-1] <= own[1:])
        used = np.bincount(own[free], minlength=len(order)) >= least // 2
        free[free] = used[own[free]]
        take = often[free]
        if not len(take):
            break
        x[take] = (size + rules + (np.cumsum(used) - 1)[own[free]]).astype(kind)
        last[take] = last[take + 1]
        keep = np.ones(len(x), bool)
        keep[take + 1] = False
        x, last, order = x[keep], last[keep], order[used]
        left.append((pairs[order] >> both(half)).astype(np.uint32))
        right.append((pairs[order] & both((1 << half) - 1)).astype(np.uint32))
        rules += len(order)
        if len(take) < gain * len(x):
            break
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return join(left), join(right), x, np.diff(np.concatenate(([0], np.flatnonzero(last) + 1)))


def pack(ids: np.ndarray, counts: np.ndarray, size: int) -> bytes:
    """A shard of documents with at least one id each."""
    left, right, x, symbols = repair(ids, counts, size, max(256, (1 << 16) - 1 - size))
    length = np.ones(size + len(left), np.uint32)
    for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
        length[size + i] = length[a] + length[b]
    head = b"RPR1" + struct.pack("<4I", len(counts), len(left), len(x), size)
    begin = np.concatenate(([0], np.cumsum(symbols)))
    kind = "<u2" if size + len(left) < 1 << 16 else "<u4"
    return b"".join([head, *(np.asarray(c).astype("<u4").tobytes() for c in (left, right, length[size:], counts, begin)), x.astype(kind).tobytes()])


class Shard:
    """Reads documents of a packed shard, or parts of them."""

    def __init__(self, data: bytes):
        if data[:4] != b"RPR1":
            raise ValueError("not a shard")
        docs, rules, symbols, self.size = struct.unpack_from("<4I", data, 4)
        at, cols = 20, []
        for n in (rules, rules, rules, docs, docs + 1):
            cols.append(np.frombuffer(data, "<u4", n, at))
            at += 4 * n
        self.left, self.right, length, self.counts, self.begin = cols
        self.symbols = np.frombuffer(data, "<u2" if self.size + rules < 1 << 16 else "<u4", symbols, at)
        self.length = np.concatenate((np.ones(self.size, np.int64), length.astype(np.int64)))

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' ids, along the rules that they name only: each round replaces every rule by its two sides."""
        now = symbols.astype(np.uint32)
        while (rule := now >= self.size).any():
            at = np.cumsum(1 + rule) - 1
            new = np.empty(int(at[-1]) + 1, np.uint32)
            new[at] = now
            own = now[rule] - self.size
            new[at[rule] - 1], new[at[rule]] = self.left[own], self.right[own]
            now = new
        return now.astype("<u4")

    def all_ids(self) -> np.ndarray:
        """All ids, from the expansion of every rule, written out once."""
        length = self.length.tolist()
        place = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        p, pool = place.tolist(), np.zeros(int(self.length.sum()), "<u4")
        pool[: self.size] = np.arange(self.size)
        for i, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist(), strict=True), self.size):
            pool[p[i] : p[i] + length[a]] = pool[p[a] : p[a] + length[a]]
            pool[p[i] + length[a] : p[i] + length[i]] = pool[p[b] : p[b] + length[b]]
        n = self.length[self.symbols]
        ends = np.cumsum(n)
        return pool[np.repeat(place[self.symbols] - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def ids(self, doc: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids start to stop of one document; only the symbols that cover them are expanded."""
        s = self.symbols[self.begin[doc] : self.begin[doc + 1]]
        stop = int(self.counts[doc]) if stop is None else min(stop, int(self.counts[doc]))
        if start >= stop:
            return np.zeros(0, "<u4")
        ends = np.cumsum(self.length[s])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        skip = int(ends[a - 1]) if a else 0
        return self._expand(s[a:b])[start - skip : stop - skip]


# ---- Spark


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", shard_tokens: int = 1 << 20) -> None:
    """Write the shards to path, in ascending order of part and seq."""
    kind = docs.schema[id_col].dataType.simpleString()
    with open(vocabulary, encoding="utf-8") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, part = _tokenizer(sent), TaskContext.get().partitionId()
        seq, before, size = 0, 0, 0
        held: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # ids, counts and names of the shard to be

        def shard():
            ids, counts = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            names = pa.concat_arrays([h[2] for h in held])
            cols = [pa.array([part]), pa.array([seq]), pa.array([before]), pa.array([len(ids)])]
            cols += [pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), pa.array([pack(ids, counts, tok.size)], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "start", "n_tokens", "ids", "body"])

        for batch in batches:
            for a in range(0, batch.num_rows, 3000):
                names = batch.column("id").slice(a, 3000)
                ids, counts = tok.encode_array(batch.column("text").slice(a, 3000))
                ids, counts = np.insert(ids, np.cumsum(counts), end_id), counts + 1
                ends, at = np.concatenate(([0], np.cumsum(counts))), 0
                while at < len(counts):
                    to = max(int(np.searchsorted(ends, ends[at] + shard_tokens - size, "right")) - 1, at + (not held))
                    if to > at:
                        held.append((ids[ends[at] : ends[to]], counts[at:to], names.slice(at, to - at)))
                        size += int(ends[to] - ends[at])
                        at = to
                    if at < len(counts):
                        yield shard()
                        seq, before, held, size = seq + 1, before + size, [], 0
        if held:
            yield shard()

    rows = docs.select(named(id_col).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    rows.mapInArrow(run, f"part long, seq long, start long, n_tokens long, ids array<{kind}>, body binary").write.parquet(path)


_TOKENIZERS: dict[int, WordTokenizer] = {}


def _tokenizer(sent) -> WordTokenizer:
    """One tokenizer for each Python worker, from the broadcast vocabulary."""
    key = id(sent.value)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = WordTokenizer(sent.value)
    return _TOKENIZERS[key]


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, start (ids of all documents before), n_tokens and ids (little-endian u4), from the files."""
    shards = spark.read.parquet(path)
    kind = shards.schema["ids"].dataType.elementType.simpleString()
    # one row for each part of the range partitioning
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, names, start in zip(batch.column("body"), batch.column("ids"), batch.column("start").to_pylist(), strict=True):
                s = Shard(body.as_py())
                counts = s.counts.astype(np.int64)
                ends = np.cumsum(counts)
                every = s.all_ids()
                for a in range(0, len(counts), 256):  # small batches: ids are larger than the shard
                    rows = range(a, min(a + 256, len(counts)))
                    data = [every[ends[i] - counts[i] : ends[i]].tobytes() for i in rows]
                    yield pa.RecordBatch.from_arrays([names.values[rows.start : rows.stop], pa.array(start + ends[a : rows.stop] - counts[a : rows.stop]), pa.array(counts[a : rows.stop]), pa.array(data, pa.binary())], ["id", "start", "n_tokens", "ids"])

    placed = shards.join(base, "part").select("body", "ids", (F.col("start") + F.col("base")).alias("start"))
    return placed.mapInArrow(run, f"id {kind}, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = shared_dir(spark)
    write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
