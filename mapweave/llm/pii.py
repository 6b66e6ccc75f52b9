"""Personal data: fixed patterns, and a linear-chain conditional random field over word-shape features.

The patterns give emails, IP addresses, card and phone numbers. The random field adds secrets (tokens, keys,
passwords) and accounts (bank and identity numbers). It is trained from a small labelled table of sentences
(``labelled_sentences``, or another one), on the driver; sequences are sentences or lines, decoded by Viterbi in
padded numpy batches. A line whose words all have plain shapes is passed over only where the model's weights
prove that its best path has no span (``plain_is_outside``).

Null and empty texts have no spans. Added spans that touch a pattern's span are left out. One output row for each
input row, repeated ones too; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, named, table, texts_of

KINDS = ("email", "ip", "card", "phone")
ADDED = ("secret", "account")
LABELS = ("O", "B-secret", "I-secret", "B-account", "I-account")

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Matches begin where a run of digits begins and take whole runs, so this form finds the same ones in linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def _luhn(digits: list[str]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain, found from each @: the local part is the run before it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then by kind as listed."""
    out = [(a, b, "email") for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in (part.lstrip("0") for part in m[0].split("."))):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _DIGITS.findall(m[0])) <= 19 and _luhn(d):
                out.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.findall(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# ---- features

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_TRIGGERS = {"secret": "token key secret password passwd api_key apikey bearer", "account": "iban ssn account passport konto compte cuenta"}
_TRIGGER = {w: k for k, ws in _TRIGGERS.items() for w in ws.split()}
#: Anything that makes a word's shape other than plain.
_NOT_PLAIN = re.compile(rf"[0-9]|[^\x20\x09-\x0D]{{33}}|{'|'.join(_TRIGGER)}", re.I)
FEATURES = (
    "bias lower capital upper mixed mark short middle long huge digit digits hex base64 ssn iban equals "
    "trigger_secret trigger_account after_secret after_account quoted first"
).split()
_F = {f: i for i, f in enumerate(FEATURES)}


def bared(word: str) -> str:
    """The word without the marks at its ends, in linear time."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def shape(word: str) -> tuple[str, ...]:
    """Features of the word itself."""
    bare = bared(word)
    out = ["bias"]
    if not bare:
        out.append("equals" if word in ("=", ":", ":=", "=>") else "mark")
    elif bare.isalpha():
        out.append("lower" if bare.islower() else "upper" if bare.isupper() else "capital" if bare[1:].islower() else "mixed")
    else:
        out.append("mixed")
    n = len(bare)
    out.append("short" if n < 5 else "middle" if n < 13 else "long" if n < 33 else "huge")
    if (k := _TRIGGER.get(bare.lower())) or (k := _TRIGGER.get(bare.lower().rsplit("_", 1)[-1])):
        out.append(f"trigger_{k}")
    if re.search(r"\d", bare):
        out.append("digit")
        if bare.isdigit():
            out.append("digits")
        if re.fullmatch(r"[0-9a-fA-F]{16,}", bare) and not bare.isdigit():
            out.append("hex")
        elif n >= 16 and re.fullmatch(r"[A-Za-z0-9_+/-]+", bare) and re.search("[A-Za-z]", bare):
            out.append("base64")
        if re.fullmatch(r"\d{3}-\d{2}-\d{4}", bare):
            out.append("ssn")
        if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]*", bare):
            out.append("iban")
    if len(word) > 2 and word[0] in "\"'":
        out.append("quoted")
    return tuple(out)


def features(words: list[str]) -> list[list[int]]:
    """Feature ids of each word of a sequence; a trigger reaches over up to two marks or linking words."""
    shapes, out, reach = [shape(w) for w in words], [], ("", 0)
    for i, s in enumerate(shapes):
        ids = [_F[f] for f in s] + ([_F[f"after_{reach[0]}"]] if reach[1] else []) + ([_F["first"]] if i == 0 else [])
        out.append(ids)
        t = next((f[8:] for f in s if f.startswith("trigger_")), "")
        reach = (t, 3) if t else (reach[0], reach[1] - 1) if reach[1] and "digit" not in s else ("", 0)
    return out


def labelled_sentences() -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (word, label), a mark after a value standing for its B- and I-words."""
    rng = np.random.default_rng(3)
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    low, digits, hexa = "abcdefghilmnoprstuv", "0123456789", "0123456789abcdef"
    secrets = [lambda: pick(hexa, 40), lambda: pick(hexa, 32), lambda: "sk_" + pick(low + digits, 24) + "7q", lambda: pick(low.upper() + digits, 20) + "x9"]
    accounts = [
        lambda: [f"{pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}"],
        lambda: ["DE" + pick(digits, 20)],
        lambda: ["FR" + pick(digits, 2), *(pick(digits, 4) for _ in range(4))],
        lambda: ["ES" + pick(digits, 2), *(pick(digits, 4) for _ in range(5))],
    ]
    word = lambda: pick(low, int(rng.integers(2, 13))).capitalize() if rng.random() < 0.15 else pick(low, int(rng.integers(2, 13)))
    words = lambda n: [(word() + ("," if rng.random() < 0.1 else "*" * 3 if rng.random() < 0.05 else ""), "O") for _ in range(n)]
    out = []
    for i in range(120):
        row = words(int(rng.integers(0, 8)))
        kind = i % 8
        if kind in (0, 1):
            value, quote = secrets[i // 8 % 4](), '"' * int(rng.integers(0, 2))
            row += [(str(rng.choice(["token", "key", "api_key", "secret", "password"])), "O"), (str(rng.choice(["=", ":"])), "O"), (f"{quote}{value}{quote}", "B-secret")]
        elif kind == 2:
            row += [(str(rng.choice(["token", "secret", "key"])) + ":", "O"), (secrets[i // 8 % 4](), "B-secret")]
        elif kind in (3, 4):
            parts = accounts[i // 8 % 4]()
            row += [(str(rng.choice(["iban", "ssn", "account", "konto", "IBAN"])) + str(rng.choice(["", ":"])), "O")]
            row += [(p, "B-account" if j == 0 else "I-account") for j, p in enumerate(parts)]
        elif kind == 5:  # numbers that are none
            row += [(pick("123456789", int(rng.integers(1, 5))), "O"), *words(1), (f"{pick('12', 1)}{pick(digits, 3)}-{pick('01', 1)}{pick('123', 1)}", "O"), (pick(digits, 16), "O")]
            row += [(pick(low, 1) + pick(digits, int(rng.integers(1, 4))), "O") for _ in range(8)]
        elif kind == 6:  # triggers without a value
            row += [(str(rng.choice(["token", "key", "account", "secret", "password"])), "O"), *words(3)]
        else:
            row += [("+1", "O"), (f"({pick(digits, 3)})", "O"), (f"555-{pick(digits, 4)}", "O"), (word() + "@" + word() + ".com", "O"), (".".join(pick("123456789", 2) for _ in range(4)), "O")]
        out.append(row + words(int(rng.integers(1, 8))))
    return out


# ---- the random field


def _padded(feats: list[list[list[int]]], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Emissions (sequence, position, label) and the mask of real positions."""
    sizes = np.array([len(f) for f in feats])
    flat = [ids for f in feats for ids in f]
    lens = np.array([len(x) for x in flat])
    sums = np.add.reduceat(weights[np.concatenate([np.asarray(x) for x in flat])], np.concatenate(([0], np.cumsum(lens)[:-1])))
    mask = np.arange(sizes.max()) < sizes[:, None]
    out = np.zeros((*mask.shape, weights.shape[1]))
    out[mask] = sums
    return out, mask


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class Crf:
    def __init__(self, sentences: list[list[tuple[str, str]]], steps: int = 250, rate: float = 0.3, penalty: float = 0.02):
        feats = [features([w for w, _ in s]) for s in sentences]
        gold = [[LABELS.index(y) for _, y in s] for s in sentences]
        n = len(LABELS)
        self.w, self.t, self.start = np.zeros((len(FEATURES), n)), np.zeros((n, n)), np.zeros(n)
        seen = [np.zeros_like(self.w), np.zeros_like(self.t), np.zeros(n)]
        for f, g in zip(feats, gold, strict=True):
            seen[2][g[0]] += 1
            for ids, y in zip(f, g, strict=True):
                seen[0][ids, y] += 1
            for a, b in zip(g, g[1:], strict=False):
                seen[1][a, b] += 1
        past = [np.full_like(x, 1e-6) for x in seen]
        for _ in range(steps):
            wants = self._expected(feats)
            for x, s, e, p in zip((self.w, self.t, self.start), seen, wants, past, strict=True):
                grad = (s - e) / len(feats) - penalty * x / 10
                p += grad**2
                x += rate * grad / np.sqrt(p)
        self.plain_is_outside = self._proves_plain()

    def _expected(self, feats: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e, mask = _padded(feats, self.w)
        size = e.shape[1]
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = self.start + e[:, 0]
        for i in range(1, size):
            alpha[:, i] = np.where(mask[:, i, None], _lse(alpha[:, i - 1, :, None] + self.t, 1) + e[:, i], alpha[:, i - 1])
        for i in range(size - 2, -1, -1):
            beta[:, i] = np.where(mask[:, i + 1, None], _lse(self.t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2), 0)
        z = _lse(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        pair = np.zeros_like(self.t)
        for i in range(1, size):
            both = np.exp(alpha[:, i - 1, :, None] + self.t + (e[:, i] + beta[:, i])[:, None, :] - z[:, None, None])
            pair += (both * mask[:, i, None, None]).sum(axis=0)
        want = np.zeros_like(self.w)
        for f, row in zip(feats, p, strict=True):
            for ids, q in zip(f, row, strict=False):
                want[ids] += q
        return want, pair, p[:, 0].sum(axis=0)

    def _proves_plain(self) -> bool:
        """No stretch of plain words gains by leaving O: longest paths over the other labels, against all O."""
        forms = [(a, b) for a in ("lower", "capital", "upper", "mixed", "mark", "equals") for b in ("short", "middle", "long")]
        rows = np.array([self.w[[_F[f] for f in ("bias", a, b, *more)]].sum(axis=0) for a, b in forms for more in ((), ("quoted",), ("first",), ("quoted", "first"))])
        gain = (rows - rows[:, :1]).max(axis=0)[1:]
        step = self.t - self.t[0, 0]
        best = np.maximum(step[0, 1:], (self.start - self.start[0])[1:]) + gain
        for _ in LABELS:
            before, best = best, np.maximum(best, (best[:, None] + step[1:, 1:]).max(axis=0) + gain)
        return bool((before == best).all() and (best + np.maximum(step[1:, 0], 0) < 0).all())

    def decode(self, feats: list[list[list[int]]]) -> list[np.ndarray]:
        """The best labels of each sequence, in batches of like length."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(feats)
        order, at = sorted((i for i in range(len(feats)) if feats[i]), key=lambda i: len(feats[i])), 0
        while at < len(order):
            n = max(1, min(512, 60_000 // len(feats[order[min(at + 511, len(order) - 1)]])))
            part = order[at : at + n]
            at += n
            e, mask = _padded([feats[i] for i in part], self.w)
            best, back = self.start + e[:, 0], np.zeros(e.shape, np.int8)
            for i in range(1, e.shape[1]):
                via = best[:, :, None] + self.t
                to = via.argmax(axis=1)
                on = mask[:, i, None]
                back[:, i] = np.where(on, to, np.arange(len(LABELS)))
                best = np.where(on, np.take_along_axis(via, to[:, None, :], 1)[:, 0] + e[:, i], best)
            path = np.zeros(e.shape[:2], np.int8)
            path[:, -1] = best.argmax(axis=1)
            for i in range(e.shape[1] - 1, 0, -1):
                path[:, i - 1] = np.take_along_axis(back[:, i], path[:, i, None], 1)[:, 0]
            for i, p in zip(part, path, strict=True):
                out[i] = p[: len(feats[i])]
        return out


def sequences(text: str, all_lines: bool) -> Iterator[list[tuple[int, int]]]:
    """Word positions of each sentence of the lines that hold anything but plain words (or of all lines)."""
    at = 0
    while at < len(text):
        if not all_lines:
            m = _NOT_PLAIN.search(text, at)
            if not m:
                return
            at = text.rfind("\n", at, m.start()) + 1 or at
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        now: list[tuple[int, int]] = []
        plain = True
        for w in _WORD.finditer(text, at, end):
            now.append(w.span())
            plain = plain and not _NOT_PLAIN.search(w[0])
            if text[w.end() - 1] in ".!?":
                if all_lines or not plain:
                    yield now
                now, plain = [], True
        if now and (all_lines or not plain):
            yield now
        at = end + 1


def added_spans(texts: list[str], taken: list[list[tuple[int, int, str]]], crf: Crf) -> list[list[tuple[int, int, str]]]:
    """The random field's spans for each text, without those that touch a span in taken."""
    places, feats = [], []
    for k, text in enumerate(texts):
        for spans in sequences(text, not crf.plain_is_outside):
            places.append((k, spans))
            feats.append(features([text[a:b] for a, b in spans]))
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (k, spans), path in zip(places, crf.decode(feats), strict=True):
        i = 0
        while i < len(path):
            kind = LABELS[path[i]][2:]
            j = i + 1
            if kind:
                while j < len(path) and LABELS[path[j]] == f"I-{kind}":
                    j += 1
                text, (a, _), (_, b) = texts[k], spans[i], spans[j - 1]
                while a < b and not text[a].isalnum():
                    a += 1
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                if a < b and not any(x < b and a < y for x, y, _ in taken[k]):
                    out[k].append((a, b, kind))
            i = j
    return out


@cache
def fitted() -> Crf:
    """The field of the labelled sentences, fitted once in a process."""
    return Crf(labelled_sentences())


def find_pii(docs: DataFrame, crf: Crf | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry and spans: array of (start, end, kind), in code points, by start and then kind."""
    sent = docs.sparkSession.sparkContext.broadcast(crf or fitted())
    used = docs.select(*map(named, carry), "text")
    made = T.StructType.fromDDL("spans array<struct<start:long,end:long,kind:string>>")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch, batch.num_columns - 1)
            base = [pattern_spans(t) for t in texts]
            more = added_spans(texts, base, sent.value)
            rank = {k: i for i, k in enumerate(KINDS + ADDED)}
            rows = [sorted(a + b, key=lambda s: (s[0], rank[s[2]], s[1])) for a, b in zip(base, more, strict=True)]
            spans = pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], spans], [str(i) for i in range(batch.num_columns)])

    return in_batches(used, run, [*used.schema.fields[:-1], *made])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    n = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
