"""SentencePiece encoding and decoding over a relational lattice.

Texts fall into units that no piece of the vocabulary spans (checked when it is loaded): runs of letters or of
other characters, with the spaces before them. Different units are encoded once: the substrings up
to the longest piece are exploded and joined with the piece table (as large as the vocabulary, so broadcast), the
edges are grouped by unit, and a higher-order ``aggregate`` folds them. For models of kind "unigram" the fold is
Viterbi over the piece scores; for kind "bpe" that would not give the library's ids, so there the fold merges the
best-scored neighbours, over and over, as the library does. Characters outside the vocabulary become bytes.

The lattice gives the units that occur often (``keep`` of them at most: a bounded dictionary that goes to all
tasks). Rarer units, and those of over ``longest`` characters, get the same ids from a small function in the task.

Null texts count as empty and have no ids. Equal texts get equal ids, one output row for each input row. Decoding
gives the text back; U+2581 in a text reads as a space, as in the library. An empty table gives an empty result;
extra columns pass through.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, in_batches, named, sliced, stage, table, texts_of, with_made

SPACE = "▁"
#: Letters, or other characters but the space, each with the spaces before them.
_NUMERIC = "\xb2\xb3\xb9\xbc-\xbe\u2070-\u209c\u2150-\u218b\u2460-\u24ff"  # word characters that are no letters
UNIT = re.compile(rf" *[^\W\d_{_NUMERIC}]+| *(?:[^\w ]|[\d_{_NUMERIC}])+| +")


_CUT = re.compile(r"(?<=[^ ]) ")


def units_of(text: str, size: int = 1 << 16) -> Iterator[tuple[str, list[str]]]:
    """Parts of about size characters, cut where a unit begins, and the units of each part.

    Parts have a plain space for U+2581; the first begins with the space that the library puts before a text.
    """
    text, at = " " + text.replace(SPACE, " ") if text else "", 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        part = text[at : m.start()]
        yield part, UNIT.findall(part)
        at = m.start()
    if text:
        yield (text[at:] if at else text), UNIT.findall(text, at)


class Pieces:
    """The vocabulary: id, score and text of each piece; texts have a plain space for U+2581."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(sp.vocab_size())
        self.kind, self.bytes = kind, {}
        self.rows: list[tuple[str, int, float]] = []
        self.out: list[bytes] = []
        for i in every:
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.out.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                self.rows.append((piece.replace(SPACE, " "), i, float(sp.get_score(i))))
                self.out.append(self.rows[-1][0].encode())
        self.unknown = sp.unk_id()
        if spanning := [p for p, _, _ in self.rows if len(UNIT.findall(p)) != 1]:
            raise ValueError(f"pieces span units: {spanning[:5]}")
        self.size = max(len(p) for p, _, _ in self.rows)
        self.best = {p: (s, i) for p, i, s in self.rows}
        self.score = {p: s for p, _, s in self.rows}
        self.least = min((s for _, _, s in self.rows), default=0.0)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "piece string, id int, score double")

    def fallback(self, char: str) -> list[int]:
        data = char.encode("utf-8", "replace")
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def encode_rare(self, unit: str) -> list[int]:
        """One unit that the lattice hasn't. For few characters a list is faster than the heap of encode_long."""
        if self.kind != "bpe" or len(unit) > 48:
            return self.encode_long(unit)
        parts, score = list(unit), self.score.get
        pairs = [score(a + b, -np.inf) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (top := max(pairs)) > -np.inf:
            i = pairs.index(top)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], -np.inf)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], -np.inf)
        out: list[int] = []
        for p in parts:
            out += [s[1]] if (s := self.best.get(p)) else self.fallback(p)
        return out

    def encode_long(self, unit: str) -> list[int]:
        """One unit, by merging (bpe) or by Viterbi (unigram), for units too long to fold in SQL."""
        n = len(unit)
        if self.kind == "unigram":
            best: list[tuple[float, int, int | None]] = [(0.0, 0, None)]
            for j in range(1, n + 1):
                ways = [(best[i][0] + s[0], -i, s[1]) for i in range(max(0, j - self.size), j) if (s := self.best.get(unit[i:j]))]
                if unit[j - 1 : j] not in self.best:
                    ways.append((best[j - 1][0] + self.least - 10, -(j - 1), None))
                s, i, k = max(ways, key=lambda w: w[:2])
                best.append((s, -i, k))
            out, j = [], n
            while j:
                _, i, k = best[j]
                out.append([k] if k is not None else self.fallback(unit[i:j]))
                j = i
            return [x for part in reversed(out) for x in part]
        start, end, after, before = list(range(n)), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            if 0 <= a and b < n and (s := self.best.get(unit[start[a] : end[b]])):
                heapq.heappush(heap, (-s[0], a, end[b], b))

        for a in range(n - 1):
            offer(a, a + 1)
        gone = [False] * n
        while heap:
            _, a, stop, b = heapq.heappop(heap)
            if gone[a] or gone[b] or after[a] != b or end[b] != stop:
                continue
            end[a], gone[b], after[a] = end[b], True, after[b]
            if after[b] < n:
                before[after[b]] = a
            offer(before[a], a)
            offer(a, after[a])
        out, a = [], 0
        while a < n:
            s = self.best.get(unit[start[a] : end[a]])
            out += [s[1]] if s else self.fallback(unit[start[a] : end[a]])
            a = after[a]
        return out


_BPE = """
aggregate(sequence(1, n), sequence(0, n), (c, step) -> if(size(c) < 3, c,
  transform(array(array_max(transform(sequence(0, size(c) - 3), k -> named_struct('s', try_element_at(edge, c[k] * 64 + c[k + 2]).score, 'k', -k)))),
    b -> if(b.s is null, c, concat(slice(c, 1, 1 - b.k), slice(c, 3 - b.k, n + 1))))[0]))
"""
#: best[j]: score of the best way to j, and minus where its last edge begins; then the way back from n.
_VITERBI = """
aggregate(sequence(1, n), array(named_struct('s', 0D, 'i', 0)), (best, j) -> concat(best, array(array_max(transform(
  filter(sequence(greatest(0, j - {size}), j - 1), i -> map_contains_key(edge, i * 64 + j) or i = j - 1),
  i -> named_struct('s', best[i].s + coalesce(try_element_at(edge, i * 64 + j).score, {unknown}D), 'i', -i))))),
  best -> aggregate(sequence(1, n), array(n), (c, step) -> if(c[0] = 0, c, concat(array(-best[c[0]].i), c))))
"""


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """units (unit, short enough to fold) with edge: map of 64 * begin + end to (score, id)."""
    n, size = F.length("unit"), pieces.size
    spans = units.select("unit", n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    spans = spans.select("unit", "n", "i", F.explode(F.sequence(F.col("i") + 1, F.least("n", F.col("i") + size))).alias("j"))
    spans = spans.withColumn("piece", F.expr("substr(unit, i + 1, j - i)"))
    edges = spans.join(F.broadcast(pieces.table(units.sparkSession)), "piece", "left").filter("id is not null or j = i + 1")
    entry = F.when(F.col("id").isNotNull(), F.struct((F.col("i") * 64 + F.col("j")).alias("k"), F.struct("score", "id").alias("v")))
    return edges.groupBy("unit", "n").agg(F.map_from_entries(F.collect_list(entry)).alias("edge"))


def encode_units(units: DataFrame, pieces: Pieces, longest: int = 48) -> DataFrame:
    """unit, ids (array of int) of each row of units (unit: distinct, not empty)."""
    short, long = units.filter(F.length("unit") <= longest), units.filter(F.length("unit") > longest)
    cuts = F.expr(_BPE if pieces.kind == "bpe" else _VITERBI.format(size=pieces.size, unknown=pieces.least - 10))
    folded = lattice(short, pieces).withColumn("cuts", cuts)
    if pieces.bytes:
        first = pieces.bytes[0]  # byte pieces are consecutive
        other = f"transform(sequence(1, octet_length(substr(unit, cuts[k] + 1, 1))), b -> cast(conv(substr(hex(encode(substr(unit, cuts[k] + 1, 1), 'utf-8')), 2 * b - 1, 2), 16, 10) as int) + {first})"
    else:
        other = f"array({pieces.unknown})"
    ids = F.expr(f"flatten(transform(sequence(0, size(cuts) - 2), k -> if(map_contains_key(edge, cuts[k] * 64 + cuts[k + 1]), array(edge[cuts[k] * 64 + cuts[k + 1]].id), {other})))")
    sent = units.sparkSession.sparkContext.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [sent.value.encode_long(u) for u in batch.column("unit").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("unit"), pa.array(made, pa.list_(pa.int32()))], ["unit", "ids"])

    return folded.select("unit", ids.alias("ids")).union(long.select("unit").mapInArrow(run, "unit string, ids array<int>"))


def unit_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Each different unit of all texts and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        chars = 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["unit", "n"])
        for batch in sliced(batches, 500):
            for t in texts_of(batch, text):
                for _, units in units_of(t):
                    seen.update(units)
                chars += len(t)
                if len(seen) > 150_000 or chars > 1 << 25:  # so many characters of units at most
                    yield flush()
                    seen.clear()
                    chars = 0
        yield flush()

    return docs.select(text).mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, pieces: Pieces, text: str = "text", keep: int = 250_000, longest: int = 48) -> dict[str, bytes]:
    """Ids (int32) of the units that occur often, keep at most, from the lattice."""
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(name)
    conf.set(name, "1000")  # whole texts: smaller batches hold less memory beside the heap
    try:
        counts = stage(unit_counts(docs, text))
    finally:
        conf.set(name, before)
    bins = {r[0]: r[1] for r in counts.groupBy(F.floor(F.log2("n"))).count().collect()}  # at most 64 rows
    least, total = 64, 0
    while least and total + bins.get(least - 1, 0) <= keep:
        least -= 1
        total += bins.get(least, 0)
    # dealt by unit before the lattice, so that its edges needn't move to be grouped
    often = counts.filter(F.col("n") >= (1 << least)).select("unit").repartition("unit")
    found = stage(encode_units(often, pieces, longest)).toArrow()
    if not len(found):
        return {}
    ids = found.column("ids").combine_chunks()
    data, at = ids.flatten().to_numpy().astype(np.int32).tobytes(), (4 * np.concatenate(([0], np.cumsum(ids.value_lengths().to_numpy())))).tolist()
    return {u: data[a:b] for u, a, b in zip(found.column("unit").to_pylist(), at, at[1:], strict=False)}


def encode(docs: DataFrame, pieces: Pieces, text: str = "text", keep: int = 250_000, longest: int = 48) -> DataFrame:
    """docs' columns, _ids (array of int) and _decoded_same (the ids' text is the text); see fresh() for clashing names."""
    context, at = docs.sparkSession.sparkContext, docs.columns.index(text)
    fields = [*docs.schema, T.StructField(fresh(docs, "_ids"), T.ArrayType(T.IntegerType())), T.StructField(fresh(docs, "_decoded_same"), T.BooleanType())]
    sent, model = context.broadcast(dictionary(docs, pieces, text, keep, longest)), context.broadcast(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, piece, encode_rare = sent.value.get, model.value.out.__getitem__, model.value.encode_rare
        rare: dict[str, bytes] = {}
        chars = 0
        for batch in sliced(batches, 500):
            out, same = [], []
            for t in texts_of(batch, at):
                made, equal = [], True
                for part, units in units_of(t):
                    parts = list(map(get, units))
                    if None in parts:
                        for i, p in enumerate(parts):
                            if p is None:
                                u = units[i]
                                if u not in rare:
                                    chars += len(u)
                                    if len(rare) > 50_000 or chars > 1 << 22:
                                        rare.clear()
                                        chars = len(u)
                                    rare[u] = array("i", encode_rare(u)).tobytes()
                                parts[i] = rare[u]
                    made.append(np.frombuffer(b"".join(parts), np.int32))
                    equal = equal and b"".join(map(piece, made[-1].tolist())) == part.encode("utf-8", "replace")
                out.append(made[0] if len(made) == 1 else np.concatenate([*made, np.zeros(0, np.int32)]))
                same.append(equal)
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in out])))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out)))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, pa.array(same, pa.bool_())], [str(i) for i in range(len(fields))])

    return in_batches(docs, run, fields)


def decode(rows: DataFrame, pieces: Pieces, ids: str = "ids") -> DataFrame:
    """rows with text (see fresh() for clashing names): the pieces of the ids end to end, without the first space; null ids give an empty text."""
    sent = rows.sparkSession.sparkContext.broadcast(pieces.out)

    def made(batch: pa.RecordBatch, at: int) -> list[pa.Array]:
        return [pa.array([b"".join(map(sent.value.__getitem__, x or []))[1:].decode("utf-8", "replace") for x in batch.column(at).to_pylist()], pa.string())]

    return with_made(rows, ids, made, [T.StructField(fresh(rows, "text"), T.StringType())])


def public_pieces() -> Pieces:
    import public_tokenizers

    return Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_pieces())
    return rows.select("doc_id", F.size("_ids").cast("long").alias("n_pieces"), F.xxhash64("_ids").alias("ids_hash"), F.col("_decoded_same").alias("decoded_same"))


def encode_stage(docs: DataFrame) -> DataFrame:
    """docs' columns without text, n_pieces and ids; see fresh() for clashing names."""
    rows, ids = encode(docs, public_pieces()), F.col(fresh(docs, "_ids"))
    return rows.select(*(named(c) for c in docs.columns if c != "text"), F.size(ids).cast("long").alias(fresh(docs, "n_pieces")), ids.alias(fresh(docs, "ids")))
