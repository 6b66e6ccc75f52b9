"""Column functions with the semantics that the mapping client expects: falsy values, trimming, joins, local names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: White space of scripts in browsers; U+0085 is none.
_BLANK = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"


def trim_all(col: Column) -> Column:
    """Trim every white-space character of scripts, Unicode spaces and U+FEFF too (trim() takes plain spaces only)."""
    return F.regexp_replace(col, rf"\A{_BLANK}+|{_BLANK}+\z", "")


def tokenize_home(query: Column) -> Column:
    """Identifiers of a free query: split at runs of commas and newlines, drop blank ones, trim."""
    return F.filter(F.transform(F.split(query, r"[\n,]+"), trim_all), lambda x: x != "")


def tokenize_search(query: Column) -> Column:
    """As tokenize_home, but blank tokens that aren't empty stay, as empty strings."""
    return F.transform(F.filter(F.split(query, r"[\n,]+"), lambda x: x != ""), trim_all)


def split_ids(ids: Column) -> Column:
    """Identifiers of a joined list: an empty list gives one empty identifier, null none."""
    return F.coalesce(F.split(ids, ","), F.array().cast("array<string>"))


def echo(ids: Column) -> Column:
    """The query text that a joined list is shown as: one identifier a line."""
    return F.replace(ids, F.lit(","), F.lit("\n"))


def asked(query: Column) -> Column:
    """Whether a free query starts a search: text that isn't empty (blanks do, with no identifiers)."""
    return present(query)


def join_ids(tokens: Column) -> Column:
    return join(tokens, ",")


def join(col: Column, delimiter: str = ", ") -> Column:
    """Elements end to end; null elements are empty, so is a null array."""
    return F.coalesce(F.array_join(col, delimiter, ""), F.lit(""))


def present(col: Column, kind: T.DataType | None = None) -> Column:
    """Truthiness: text that isn't empty, numbers other than 0 and NaN, any array that isn't null."""
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return col.isNotNull()
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.coalesce((col != 0) & ~F.isnan(col), F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(col != 0, F.lit(False))
    return F.coalesce(col != "", F.lit(False))


def not_empty(col: Column) -> Column:
    return col.isNotNull() & (F.size(col) > 0)


def or_empty(col: Column) -> Column:
    return F.coalesce(col, F.lit(""))


def curie_or_iri(curie: Column, iri: Column) -> Column:
    return F.coalesce(F.nullif(curie, F.lit("")), iri)


def after_last(col: Column, mark: str) -> Column:
    """What follows the last mark (the whole text without one): local names of IRIs with '#' or '/'."""
    return F.substring_index(col, mark, -1)


def labels_then_ids(labels: Column, ids: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce(labels, none), F.coalesce(ids, none))


def title(key: Column) -> Column:
    """A facet's title: underscores become spaces."""
    return F.replace(key, F.lit("_"), F.lit(" "))


def form_encode(col: Column) -> Column:
    return F.url_encode(col)


def component_encode(col: Column) -> Column:
    """As form_encode, with the exceptions of a URI component: %20 for a space, and !'()~ as they are."""
    pairs = {"+": "%20", "%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs.items(), F.url_encode(col))


def path_head(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(2))


def one_decimal(col: Column) -> Column:
    """Labels of a slider that goes in tenths."""
    return F.format_string("%.1f", col.cast("double"))


def to_number(text: Column) -> Column:
    """A number, 0 for an empty or null text and for text that is none."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def number_text(col: Column) -> Column:
    """A double in its shortest form, as scripts in browsers write it: 1 for 1.0, no exponent from 1e-6 up to 1e21."""
    size, plain = F.abs(col), col.cast("string")
    tenths = F.regexp_replace(plain.try_cast("decimal(38,23)").cast("string"), r"\.?0+$", "")
    power = F.regexp_replace(F.regexp_replace(plain, r"(\.0)?E(\d)", "e+$2"), r"(\.0)?E-", "e-")
    special = F.isnan(col) | (size == float("inf"))
    return (
        F.when(col == 0, "0")
        .when(special, plain)
        .when((size >= 1e-6) & (size < 1e15), tenths)
        .when((size >= 1e15) & (size < 1e21), col.cast("decimal(38,0)").cast("string"))
        .otherwise(power)
    )


def to_query(fields: dict[str, Column]) -> Column:
    """The fields as the text of a request's query."""
    pairs = [F.concat(F.lit(f"{k}="), form_encode(or_empty(v))) for k, v in fields.items()]
    return F.concat_ws("&", *pairs)


def form_decode(col: Column) -> Column:
    """Undo form_encode; percent signs that no two hexadecimal digits follow stay as they are. Only text with escapes is decoded."""
    whole = F.when(F.rlike(col, F.lit("%(?![0-9A-Fa-f]{2})")), F.regexp_replace(col, "%(?![0-9A-Fa-f]{2})", "%25")).otherwise(col)
    escaped = F.contains(col, F.lit("%")) | F.contains(col, F.lit("+"))
    return F.when(escaped, F.coalesce(F.try_url_decode(whole), col)).otherwise(col)


def _body(text: Column) -> Column:
    return F.concat(F.lit("&"), F.when(F.startswith(text, F.lit("?")), F.substr(text, F.lit(2))).otherwise(text), F.lit("&"))


def _escaped(body: Column) -> Column:
    """Whether a name in a request has escapes."""
    return F.rlike(body, F.lit("&[^=&]*[%+]"))


def _places(body: Column, name: str) -> list[Column]:
    """Where a field first stands with a value and without one, 0 for nowhere."""
    return [F.instr(body, f"&{name}="), F.instr(body, f"&{name}&")]


def _field(body: Column, escaped: Column, at: Column, bare: Column, name: str) -> Column:
    found = F.filter(F.split(body, "&"), lambda p: (p != "") & (form_decode(F.substring_index(p, "=", 1)) == name))
    first = F.get(found, F.lit(0))
    every = F.when(first.isNotNull(), F.when(F.contains(first, F.lit("=")), form_decode(F.substr(first, F.instr(first, "=") + 1))).otherwise(""))
    if not name or set(name) & set("&="):
        return every
    value = form_decode(F.substring_index(F.substr(body, at + len(f"&{name}=")), "&", 1))
    return F.when(escaped, every).when((at > 0) & ((bare == 0) | (at < bare)), value).when(bare > 0, "")


def from_query(text: Column, name: str) -> Column:
    """A field of a request's query, the first of repeated ones; null if it isn't there. A leading question mark is passed over.

    The field is found by its place in the text; pairs are gone through one by one only where names have escapes.
    """
    body = _body(text)
    return _field(body, _escaped(body), *_places(body, name), name)


def from_queries(rows: DataFrame, text: Column, names: list[str], keep: list[str]) -> DataFrame:
    """rows' columns keep and from_query of each of these names, with one search of the text for each place."""
    bodies = rows.select(*keep, _body(text).alias("_body"))
    places = [c.alias(f"_{kind}{i}") for i, k in enumerate(names) for kind, c in zip(("at", "bare"), _places(F.col("_body"), k), strict=True)]
    found = bodies.select(*keep, "_body", _escaped(F.col("_body")).alias("_escaped"), *places)
    return found.select(*keep, *(_field(F.col("_body"), F.col("_escaped"), F.col(f"_at{i}"), F.col(f"_bare{i}"), k).alias(k) for i, k in enumerate(names)))


def packed(text: Column) -> Column:
    """text as bytes that sort as it does, and that unpacked() turns back: 17 for 32 lower-case hex digits, which hashes have.

    16 bytes for the digits and one between those of the texts just before (0) and after (2) them. Any other text takes
    the place of the digits that it begins with, filled up so that it comes before or after all that go on with digits;
    the text itself follows.
    """
    whole = F.unhex(text)
    head = F.regexp_extract(text, r"\A[0-9a-f]{0,32}", 0)
    n = F.length(head)
    after = F.substr(text, n + 1, F.lit(1))
    low = (n < 32) & (after < "0")
    filled = F.when(low, F.rpad(head, 32, "0")).when((n < 32) & (after < "a"), F.rpad(F.concat(head, F.lit("9")), 32, "f")).otherwise(F.rpad(head, 32, "f"))
    mark = lambda k: F.unhex(F.lit(f"0{k}"))
    other = F.concat(F.unhex(filled), F.when(low, mark(0)).otherwise(mark(2)), text.cast("binary"))
    return F.when((F.octet_length(text) == 32) & (F.lower(F.hex(whole)) == text), F.concat(whole, mark(1))).otherwise(other)


def unpacked(data: Column) -> Column:
    """The text that packed() has made data of."""
    digits = F.lower(F.hex(F.substr(data, F.lit(1), F.lit(16))))
    plain = F.substr(data, F.lit(17), F.lit(1)) == F.unhex(F.lit("01"))
    return F.when(plain, digits).otherwise(F.substr(data, F.lit(18)).cast("string"))
