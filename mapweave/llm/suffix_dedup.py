"""Repeated byte strings, found by longest-previous-factor arrays over anchored suffix orders.

Each string of ``passage`` bytes has an anchor: the 32-byte gram in it whose hash is least (the leftmost of equal
ones). Equal strings have the same anchor at the same distance, so a match of ``passage`` bytes or more can only be
between starts with one anchor and one distance. The starts that share an anchor form a run; its segment is the bytes
that they reach within ``width``. Anchors that occur once are left out, and equal segments (told by 128 bits of hash)
are collapsed to the earliest: the others are later copies of it as a whole.

The segments of an anchor are put in the suffix order of what lies from the anchor on, with the common prefix of
neighbours. A start at distance b before the anchor adds b bytes to such a suffix, so the starts at distance b are in
the same order within each class of segments whose b bytes before the anchor agree. For each class the previous and
next smaller positions in that order give the longest earlier match of each start (longest-previous-factor array) and,
with the order of positions turned round, the longest later one. Classes only split as b grows, so each is handled
once for all its distances. Anchors with over ``most_in_task`` different segments are compared by a shuffle on the
hash of each start's string instead, so no anchor is left out or cut.

keep="first" removes the strings of ``width`` bytes that match an earlier place (by id, then position) and keeps the
first; keep="none" also removes the first. Matches never cross documents and are judged on the input. Besides, each
text that shares ``passage`` bytes or more (300: about 50 words) with another document is marked.

Null texts count as empty. Documents with the same text are told apart by their id only: with keep="first" the
rows with the smallest id (null is smallest) stay. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, stage, table

GRAM = 32
_CHUNK_BITS = 21
_LOW = np.uint64((1 << _CHUNK_BITS) - 1)
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _least(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of each window of m values."""
    n = len(x) - m + 1
    pad = np.full(-len(x) % m, np.iinfo(np.uint64).max, np.uint64)
    rows = np.concatenate((x, pad)).reshape(-1, m)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[m - 1 : m - 1 + n])


def anchor_runs(data: bytes, ends: np.ndarray, passage: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents laid end to end (under 2^21 bytes each time): anchor hash, its place, first and last start of each run."""
    none = np.zeros(0, np.int64)
    if len(data) < passage:
        return none.astype(np.uint64), none, none, none
    w = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    n = len(data) - GRAM + 1
    h = w[:n] * _FACTORS[0]
    for i, f in enumerate(_FACTORS[1:], 1):
        h += w[8 * i : 8 * i + n] * f
        h ^= h >> np.uint64(32)
    h *= _FACTORS[1]
    h ^= h >> np.uint64(29)
    least = _least((h & ~_LOW) | np.arange(n, dtype=np.uint64), passage - GRAM + 1)
    valid = np.zeros(len(least), bool)
    for a, b in zip(np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True):
        if b - a >= passage:
            valid[a : b - passage + 1] = True
    starts = np.flatnonzero(valid)
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    at = (least[starts] & _LOW).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1))))
    return h[at[first]], at[first], starts[first], starts[np.concatenate((first[1:], [len(starts)])) - 1]


def _pieces(texts: list[bytes], passage: int) -> Iterator[list[int]]:
    """Indices of texts that together are under 2^21 bytes; a longer text comes alone."""
    now, size = [], 0
    for i, t in enumerate(texts):
        if len(t) < passage:
            continue
        if now and size + len(t) >= 1 << _CHUNK_BITS:
            yield now
            now, size = [], 0
        now.append(i)
        size += len(t)
    if now:
        yield now


def runs_of(texts: list[bytes], passage: int, width: int) -> list[list[tuple[int, int, int, int]]]:
    """For each text: (anchor hash, segment hash, first start, form) of each run; form: see form_of."""
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
    step = (1 << _CHUNK_BITS) - 1
    for part in _pieces(texts, passage):
        if len(part) == 1 and len(texts[part[0]]) > step:  # a long text in overlapping parts; a run that is cut is two runs
            t = texts[part[0]]
            groups = [(part, a, t[a : a + step], np.array([min(step, len(t) - a)])) for a in range(0, len(t) - passage + 1, step - passage + 1)]
        else:
            groups = [(part, 0, b"".join(texts[i] for i in part), np.cumsum([len(texts[i]) for i in part]))]
        for ids, shift, data, ends in groups:
            hashes, at, first, last = anchor_runs(data, ends, passage)
            which = np.searchsorted(ends, first, side="right")
            begin = np.concatenate(([0], ends[:-1]))[which] - shift
            off, n, first = at - first, last - first + 1, first - begin
            stop = np.minimum(last - begin + width, np.array([len(texts[i]) for i in ids])[which])
            form = form_of(n, off, stop - first)
            for h, a, b, f, i in zip(hashes.view(np.int64).tolist(), first.tolist(), stop.tolist(), form.tolist(), which.tolist(), strict=True):
                sh = xxhash.xxh3_64_intdigest(texts[ids[i]][a:b], f)
                out[ids[i]].append((h, sh - (1 << 64) if sh >> 63 else sh, a, f))
    return out


def form_of(n, off, size):
    """Number of starts, distance of the first start to the anchor, and bytes of a segment, in one integer."""
    return n << 40 | off << 20 | size


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def longest_previous(order: list[int], lcp: list[int]) -> list[int]:
    """Longest-previous-factor array of suffixes whose positions are in suffix order.

    lcp[i] is the common prefix of the suffixes i - 1 and i of that order. The previous and the next smaller
    position, found with a stack, are the only places whose match can be the longest earlier one.
    """
    n, out = len(order), [0] * len(order)
    for seq in (range(n), range(n - 1, -1, -1)):
        stack: list[list[int]] = []  # position, and the least lcp since it
        for i in seq:
            common = lcp[i] if seq.step > 0 else (lcp[i + 1] if i + 1 < n else 0)
            if stack:
                stack[-1][1] = min(stack[-1][1], common)
            while stack and stack[-1][0] > order[i]:
                least = stack.pop()[1]
                if stack:
                    stack[-1][1] = min(stack[-1][1], least)
            if stack and stack[-1][1] > out[i]:
                out[i] = stack[-1][1]
            stack.append([order[i], 1 << 60])
    return out


class Segment:
    """A representative of equal segments: its place, number of starts, distance to the anchor, bytes and whether several texts have it."""

    __slots__ = ("data", "digest", "first", "n", "off", "owner", "several", "text")

    def __init__(self, text, owner, digest, first, form, several, data):
        self.text, self.owner, self.digest, self.first, self.several, self.data = text, owner, digest, first, several, data
        self.n, self.off = form >> 40, form >> 20 & 0xFFFFF


def repeated_starts(segments: list[Segment], passage: int, width: int, keep: str) -> list[tuple[list[tuple[int, int]], bool]]:
    """Of different segments with one anchor: ranges of starts (0 is a segment's first) whose width bytes are repeats, and whether another text shares a passage."""
    place = sorted(range(len(segments)), key=lambda k: (segments[k].owner is not None, segments[k].owner or 0, segments[k].digest, segments[k].first + segments[k].off))
    rank = [0] * len(segments)
    for r, k in enumerate(place):
        rank[k] = r
    right = [s.data[s.off :] for s in segments]
    suffixes = sorted(range(len(segments)), key=right.__getitem__)
    lcp = [0] + [_common(right[a], right[b]) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    back = [segments[k].data[: segments[k].off][::-1] for k in suffixes]
    # what lies before the anchors, from the anchor on backwards: neighbours in this order make up the classes
    lefts = sorted(range(len(suffixes)), key=back.__getitem__)
    agree = [0] + [_common(back[a], back[b]) for a, b in zip(lefts, lefts[1:], strict=False)]

    ranges: list[list[tuple[int, int]]] = [[] for _ in segments]
    shared = [False] * len(segments)
    classes = [(0, len(lefts), -1)]  # a range of lefts, and the distance up to which the class above it reaches
    while classes:
        a, b, above = classes.pop()
        if b - a < 2:
            continue
        reach = min(agree[a + 1 : b])
        if reach > above:
            _class(segments, suffixes, lcp, rank, sorted(lefts[a:b]), above + 1, reach, passage, width, keep, ranges, shared)
        cuts = [a, *(i for i in range(a + 1, b) if agree[i] == reach), b]
        classes += [(x, y, reach) for x, y in zip(cuts, cuts[1:], strict=False)]
    return list(zip(ranges, shared, strict=True))


def _class(segments, suffixes, lcp, rank, members, low, high, passage, width, keep, ranges, shared) -> None:
    """Starts at distances low to high of the members (places in the suffix order), whose bytes before the anchor agree so far."""
    if len(members) == len(suffixes):
        common = lcp
    else:
        common = [0] + [min(lcp[x + 1 : y + 1]) for x, y in zip(members, members[1:], strict=False)]
    if max(common) + high < passage:
        return
    own = [suffixes[i] for i in members]
    order = [rank[k] for k in own]
    longest = longest_previous(order, common)
    if keep == "none":  # the longest later match too
        longest = [max(x, y) for x, y in zip(longest, longest_previous([-x for x in order], common), strict=True)]
    for k, r in zip(own, longest, strict=True):
        s = segments[k]
        far, near = min(high, s.off), max(low, s.off - s.n + 1, width - r)
        if near <= far:
            ranges[k].append((s.off - far, s.off - near))
    at = 0
    while at < len(own):  # suffixes that agree far enough for a passage at the largest distance
        end = at + 1
        while end < len(own) and common[end] + high >= passage:
            end += 1
        if end > at + 1 and (len({segments[k].text for k in own[at:end]}) > 1 or any(segments[k].several for k in own[at:end])):
            for k in own[at:end]:
                shared[k] = shared[k] or segments[k].off - segments[k].n < high
        at = end


_SEG = "h long, sh long, tid long, owner {id}, digest binary, first long, form long, several boolean, seg binary"
_FOUND = "tid long, a long, b long, shared boolean"


def _compare(rows: DataFrame, passage: int, width: int, keep: str) -> DataFrame:
    """Spans of repeats (tid, a, b, shared) in the segments of each anchor; a is null in rows that only mark the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, Segment] = {}
        now, found = None, []

        def finish():
            if len(group) > 1:
                segs = list(group.values())
                for s, (ranges, shared) in zip(segs, repeated_starts(segs, passage, width, keep), strict=True):
                    found.extend((s.text, s.first + x, s.first + y + width, shared) for x, y in ranges)
                    if shared and not ranges:
                        found.append((s.text, None, None, True))
            group.clear()

        def out():
            cols = list(zip(*found, strict=True)) or [[]] * 4
            found.clear()
            types = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["tid", "a", "b", "shared"])

        for batch in batches:
            for h, sh, *rest in zip(*(batch.column(x.split()[0]).to_pylist() for x in _SEG.split(", ")), strict=True):
                if h != now:
                    finish()
                    now = h
                if sh not in group:
                    group[sh] = Segment(*rest)
                if len(found) > 20_000:
                    yield out()
        finish()
        yield out()

    return rows.repartition("h").sortWithinPartitions("h", "sh").mapInArrow(run, _FOUND)


def _windows(rows: DataFrame, kind: str, size: int) -> DataFrame:
    """A row with the hash of each start's size bytes, of all segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tid, owner, digest, first, form, several, seg in zip(*(batch.column(c).to_pylist() for c in ("tid", "owner", "digest", "first", "form", "several", "seg")), strict=True):
                n = min(form >> 40, len(seg) - size + 1)
                if n > 0:
                    hashes = [xxhash.xxh3_128_digest(seg[i : i + size]) for i in range(n)]
                    same = lambda x, t: pa.array([x] * n, t)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), same(tid, pa.int64()), same(owner, batch.schema.field("owner").type), same(digest, pa.binary()), same(several, pa.bool_()), pa.array(range(first, first + n), pa.int64())], ["w", "tid", "owner", "digest", "several", "at"])

    return rows.mapInArrow(run, f"w binary, tid long, owner {kind}, digest binary, several boolean, at long")


def _by_window(large: DataFrame, kind: str, passage: int, width: int, keep: str) -> DataFrame:
    """As _compare, for anchors with many segments: equal strings meet by their hash."""
    where = F.struct(F.col("owner").isNotNull().alias("has"), "owner", "digest", "tid", "at")
    at = _windows(large, kind, width)
    hit = at.join(at.groupBy("w").agg(F.count(F.lit(1)).alias("c"), F.min(where).alias("rep")).filter("c > 1"), "w")
    if keep == "first":
        hit = hit.filter((F.col("tid") != F.col("rep.tid")) | (F.col("at") != F.col("rep.at")))
    spans = hit.select("tid", F.col("at").alias("a"), (F.col("at") + width).alias("b"), F.lit(False).alias("shared"))
    at = _windows(large, kind, passage)
    met = at.groupBy("w").agg(((F.min("tid") != F.max("tid")) | F.max("several")).alias("shared")).filter("shared")
    marks = at.join(met, "w", "left_semi").select("tid").distinct()
    none = F.lit(None).cast("long")
    return spans.union(marks.select("tid", none.alias("a"), none.alias("b"), F.lit(True).alias("shared")))


def repeats(docs: DataFrame, id_col: str = "doc_id", width: int = 400, keep: str = "none", passage: int = 300, most_in_task: int = 8_000) -> DataFrame:
    """digest (of the text), owner (smallest id with it), copies, spans: array of (a, b) to remove, and shared.

    With keep="none", a text of at least width bytes with several copies goes as a whole, whatever its spans."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = _digested(docs, id_col)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = runs_of(batch.column("data").to_pylist(), passage, width)
            cols = [pa.array([[r[i] for r in f] for f in found], pa.list_(pa.int64())) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), *cols], ["id", "digest", "h", "sh", "first", "form"])

    made = rows.select("id", "digest", F.col("text").cast("binary").alias("data")).mapInArrow(anchors, f"id {kind}, digest binary, h array<long>, sh array<long>, first array<long>, form array<long>")
    grouped = made.groupBy("digest").agg(F.min("id").alias("owner"), F.max(F.col("id").isNull()).alias("_null"), F.count(F.lit(1)).alias("copies"), F.first(F.arrays_zip("h", "sh", "first", "form")).alias("runs"))
    # each different text gets a number, which is smaller than its digest
    texts = stage(grouped.withColumn("owner", F.when(~F.col("_null"), F.col("owner"))).drop("_null").withColumn("tid", F.monotonically_increasing_id()))
    order = [F.col("owner").isNotNull().alias("has"), "owner", "digest"] if keep == "first" else []
    occ = texts.select("tid", *order, (F.col("copies") > 1).alias("copied"), F.inline("runs"))
    # staged before each join: a side that is only exchanged can be split where a key is hot
    often = stage(occ.groupBy("h").agg(F.count(F.lit(1)).alias("_c"), (F.min("sh") != F.max("sh")).alias("mixed")).filter("_c > 1").drop("_c"))
    often = stage(occ.join(often.hint("merge"), "h"))
    place = F.struct(*(["has", "owner", "digest"] if order else []), "tid", "first", "form")
    several = (F.min("tid") != F.max("tid")) | F.max("copied")
    segs = stage(often.groupBy("h", "sh").agg(F.min(place).alias("rep"), F.count(F.lit(1)).alias("count"), several.alias("several"), F.first("mixed").alias("mixed")))

    whole = often.join(segs.filter("count > 1").select("h", "sh", "rep", "several").hint("merge"), ["h", "sh"])
    size = F.col("form").bitwiseAND(F.lit(0xFFFFF))
    gone = size >= width
    if keep == "first":
        gone = gone & ((F.col("tid") != F.col("rep.tid")) | (F.col("first") != F.col("rep.first")))
    whole = whole.select("tid", F.when(gone, F.col("first")).alias("a"), F.when(gone, F.col("first") + size).alias("b"), F.col("several").alias("shared"))

    need = segs.filter("mixed").select("h", "sh", "rep.tid", "rep.first", "rep.form", "several")
    need = need.groupBy("tid").agg(F.collect_list(F.struct("h", "sh", "first", "form", "several")).alias("need"))
    need = stage(need.join(texts.select("tid", "owner", "digest"), "tid"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, plain = [x.split()[0] for x in _SEG.split(", ")], [pa.int64(), pa.int64(), pa.int64(), None, pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            types = [t or batch.schema.field("owner").type for t in plain]
            out = []
            for tid, owner, digest, data, wanted in zip(*(batch.column(c).to_pylist() for c in ("tid", "owner", "digest", "data", "need")), strict=True):
                for r in wanted:
                    out.append((r["h"], r["sh"], tid, owner, digest, r["first"], r["form"], r["several"], data[r["first"] : r["first"] + (r["form"] & 0xFFFFF)]))
                    if len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    # one row with the text is enough: the digest and the smallest id, so that copies don't meet on one key
    own = rows.join(need.hint("merge").withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & F.col("id").eqNullSafe(F.col("owner")))
    own = own.select("tid", "owner", "digest", F.col("text").cast("binary").alias("data"), "need").mapInArrow(cut, _SEG.format(id=kind))
    hot = stage(segs.filter("mixed").groupBy("h").agg(F.count(F.lit(1)).alias("_c")).filter(F.col("_c") > most_in_task).select("h"))
    if hot.isEmpty():
        spans = whole.union(_compare(own, passage, width, keep))
    else:
        cuts = stage(own)
        spans = whole.union(_compare(cuts.join(hot, "h", "left_anti"), passage, width, keep))
        spans = spans.union(_by_window(stage(cuts.join(hot, "h", "left_semi")), kind, passage, width, keep))
    spans = spans.groupBy("tid").agg(F.sort_array(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("spans"), F.max("shared").alias("shared"))
    return texts.select("tid", "digest", "owner", "copies").join(spans, "tid", "left")


def _digested(docs: DataFrame, id_col: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(named(id_col).alias("id"), text.alias("text"), F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"))


def union_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that overlap or touch made one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", width: int = 400, keep: str = "none", passage: int = 300, most_in_task: int = 8_000) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes), kept_sha256 and shared_passage, a row for each document."""
    kind = docs.schema[id_col].dataType.simpleString()
    found = stage(repeats(docs, id_col, width, keep, passage, most_in_task).filter("copies > 1 or spans is not null"))
    rows = _digested(docs, id_col).join(found.hint("merge"), "digest", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, data, owner, copies, spans, shared in zip(*(batch.column(c).to_pylist() for c in ("id", "data", "owner", "copies", "spans", "shared")), strict=True):
                several = (copies or 1) > 1
                if several and len(data) >= width and (keep == "none" or i != owner):
                    cuts = [(0, len(data))]
                else:
                    cuts = union_spans([(s["a"], s["b"]) for s in spans or []])
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(data[at:a])
                    at = b
                kept = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(kept), len(cuts), kept, hashlib.sha256(kept).hexdigest(), bool(shared) or several and len(data) >= passage))
            made = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(list(c), t) for c, t in zip(made, types, strict=True))], ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256", "shared_passage"])

    made = rows.select("id", F.col("text").cast("binary").alias("data"), "owner", "copies", "spans", "shared")
    return made.mapInArrow(run, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, shared_passage boolean").withColumnRenamed("id", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


ORACLE_SQL = r"""
with t as materialized (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as body from documents),
-- parts of 800 starts each, so that no start is counted from the beginning of a long text
parts as (select r, c, length(body) // 2 - c as rest, substr(body, 2 * c + 1, 2400) as part from (select r, body, unnest(range(0, greatest(length(body) // 2 - 299, 0), 800)) as c from t)),
starts as (select r, c, part, rest, unnest(range(0, least(800, rest - 299))) as i from parts),
pos as materialized (select r, c + i as a, md5_number(substr(part, 2 * i + 1, 600)) as short, case when rest - i >= 400 then md5_number(substr(part, 2 * i + 1, 800)) end as long from starts),
shared as (select distinct r from pos join (select short from pos group by short having min(r) <> max(r)) using (short)),
hit as (select r, a, lag(a) over (partition by r order by a) as before from pos join (select long from pos where long is not null group by long having count(*) > 1) using (long)),
runs as (select r, a, sum(case when before is null or a > before + 400 then 1 else 0 end) over (partition by r order by a) as k from hit),
spans as (select r, k, min(a) as a, max(a) + 400 as b from runs group by r, k),
kept as (select r, lag(b, 1, 0) over (partition by r order by k) as a, a as b from spans union all select r, max(b), null from spans group by r),
bodies as (select r, string_agg(substr(body, 2 * a + 1, 2 * (coalesce(b, length(body) // 2) - a)), '' order by a) as body from (select kept.r, kept.a, b, body from kept join t using (r)) group by r),
removed as (select r, count(*) as n_spans, sum(b - a) as n_removed from spans group by r)
select doc_id, length(t.body) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(coalesce(bodies.body, t.body))) as kept_sha256, shared.r is not null as shared_passage
from t left join removed using (r) left join bodies using (r) left join shared using (r)
"""
