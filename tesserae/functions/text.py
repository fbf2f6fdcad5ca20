"""Product-text and code-text expressions."""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Markers and defaults that must equal the reference's.
BOS = "<|bos_semantic|>"
EOS = "<|eos_semantic|>"
UNKNOWN_PRODUCT = "Unknown product"
BRAND_PREFIX = "Brand: "
FEATURES_MARK = ". Features: "
ANSWER_PREFIX = "The product name and/or its metadata are: "

# Java's \s is ASCII. Together with these it is the Unicode whitespace set of Python strings.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
SPACES = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace())

# Decimal digits of other scripts and the ASCII digits they stand for.
_OTHER_DIGITS = "".join(
    c for c in map(chr, range(128, sys.maxunicode + 1)) if unicodedata.category(c) == "Nd"
)
_AS_ASCII = "".join(str(unicodedata.decimal(c)) for c in _OTHER_DIGITS)


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text) -> Column:
    """Without whitespace at either end."""
    return F.trim(_col(text), F.lit(SPACES))


def clean(text) -> Column:
    """Whitespace runs become one space; no space at either end."""
    return F.trim(F.regexp_replace(_col(text), f"{SPACE}+", " "))


def decimal_text(value) -> Column:
    """A floating-point number as scripts print it: plain from 1e-4 to below 1e16, else with a signed exponent.

    The JVM prints the same digits but changes to an exponent from 1e7 up and below 1e-3.
    """
    text = _col(value).cast("string")
    power = F.substring_index(text, "E", -1).cast("int")
    digits = F.regexp_replace(F.regexp_replace(F.substring_index(text, "E", 1), r"[-.]", ""), r"(?<=.)0+$", "")
    sign = F.when(F.startswith(text, F.lit("-")), "-").otherwise("")
    size = F.length(digits)
    whole = F.rpad(digits, F.greatest(size, power + 1), "0")
    large = F.concat(
        F.substring(whole, F.lit(1), power + 1), F.lit("."),
        F.when(size > power + 1, F.substring(whole, power + 2, size)).otherwise("0"),
    )
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
    tail = F.when(size > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), size))).otherwise("")
    mark = F.when(power < 0, "e-").otherwise("e+")
    scientific = F.concat(F.substring(digits, 1, 1), tail, mark, F.lpad(F.abs(power).cast("string"), F.greatest(F.lit(2), F.length(F.abs(power).cast("string"))), "0"))
    body = F.when(power.between(0, 15), large).when(power.between(-4, -1), small).otherwise(scientific)
    special = F.when(text == "NaN", "nan").when(text == "Infinity", "inf").when(text == "-Infinity", "-inf")
    return F.coalesce(special, F.when(F.contains(text, F.lit("E")), F.concat(sign, body)).otherwise(text))


def stringify(value, dtype: T.DataType) -> Column:
    """Text of a column of any type: null is empty, nested values are joined by spaces."""
    value = _col(value)
    if isinstance(dtype, T.ArrayType):
        text = F.array_join(F.transform(value, lambda x: stringify(x, dtype.elementType)), " ")
    elif isinstance(dtype, T.MapType):
        text = stringify(F.map_values(value), T.ArrayType(dtype.valueType))
    elif isinstance(dtype, T.StructType):
        fields = F.concat_ws(" ", *[stringify(value[f.name], f.dataType) for f in dtype.fields])
        text = F.when(value.isNotNull(), fields)
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(dtype, T.StringType):
        text = strip(value)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = decimal_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def flatten_paths(categories, dtype: T.DataType) -> Column:
    """Each category path as one cleaned string; empty ones dropped; a scalar is one entry."""
    value = _col(categories)
    if not isinstance(dtype, T.ArrayType):
        value, dtype = F.array(value), T.ArrayType(dtype)
    texts = F.transform(value, lambda p: clean(stringify(p, dtype.elementType)))
    kept = F.filter(texts, lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def brand_details(brand) -> Column:
    """``Brand: <brand>`` of a cleaned brand, or empty text."""
    brand = _col(brand)
    return F.when(brand != "", F.concat(F.lit(BRAND_PREFIX), brand)).otherwise(F.lit(""))


def product_name(titles: list[Column]) -> Column:
    """First non-empty of the cleaned candidates."""
    candidates = [F.nullif(t, F.lit("")) for t in titles]
    return F.coalesce(*candidates, F.lit(UNKNOWN_PRODUCT))


def product_features(chunks: list[Column]) -> Column:
    """Non-empty cleaned chunks in order, first occurrence of each."""
    return F.array_distinct(F.filter(F.array(*chunks), lambda x: x != ""))


def product_text(name, features, include, max_chars: int) -> Column:
    """The name, or name and the longest run of leading features that the budget admits.

    Feature i fits while the budget exceeds the summed lengths of features up to i plus one
    space for each before it. That sum only grows, so the fold may stop counting at the first
    feature that does not fit.
    """
    name, features, include = _col(name), _col(features), _col(include)
    budget = F.lit(max_chars) - F.length(name) - F.lit(len(FEATURES_MARK))
    start = F.struct(F.lit(0).alias("used"), F.lit(0).alias("fit"), F.lit(True).alias("open"))

    def take(acc, feature):
        fits = acc["open"] & (budget - acc["used"] - F.length(feature) > 0)
        return F.struct(
            (acc["used"] + F.length(feature) + 1).alias("used"),
            (acc["fit"] + fits.cast("int")).alias("fit"),
            fits.alias("open"),
        )

    fit = F.aggregate(features, start, take)["fit"]
    listed = F.array_join(F.slice(features, F.lit(1), fit), " ")
    full = F.concat(name, F.lit(FEATURES_MARK), listed)
    return F.when(include & (F.size(features) > 0), full).otherwise(name)


def format_ids(ids) -> Column:
    """Codes as ``<begin>c1,c2,...<end>``."""
    listed = F.array_join(F.transform(_col(ids), lambda c: c.cast("string")), ",")
    return F.concat(F.lit(BOS), listed, F.lit(EOS))


def parse_ids(text, size: int, code_range: int, fallback=None) -> Column:
    """The first ``size`` digit runs of the text clipped to [1, code_range], padded with 1.

    ``fallback`` ids always follow those found. A run too long for 38 digits is above any range.
    """
    ascii_digits = F.translate(_col(text), _OTHER_DIGITS, _AS_ASCII)
    runs = F.regexp_extract_all(ascii_digits, F.lit(r"(\d+)"), 1)
    top = F.lit(code_range).cast("decimal(38,0)")
    found = F.transform(runs, lambda r: F.coalesce(r.try_cast("decimal(38,0)"), top))
    if fallback is not None:
        extra = F.transform(_col(fallback), lambda x: x.cast("decimal(38,0)"))
        found = F.concat(found, F.coalesce(extra, F.array().cast("array<decimal(38,0)>")))
    one = F.lit(1).cast("decimal(38,0)")
    clipped = F.transform(
        F.slice(found, 1, size), lambda x: F.greatest(one, F.least(top, x)).cast("int")
    )
    return F.slice(F.concat(clipped, F.array_repeat(F.lit(1), size)), 1, size)


def code_tokens(ids) -> Column:
    """``<|CODE_c|>`` per code; null where the code is unknown (negative)."""
    return F.transform(
        _col(ids),
        lambda c: F.when(c >= 0, F.concat(F.lit("<|CODE_"), c.cast("string"), F.lit("|>"))),
    )


# Codebook tokens are looked up in a table of token ids if it has at most so many entries, and so many per code.
TABLE_ENTRIES, SPARSE = 1 << 16, 16


def lookup_codes(token_ids, codebook_tokens: list[int], size: int) -> Column:
    """Code index of each of the first ``size`` tokens; -1 when it is no codebook token.

    Where tokens lie close together, as ids of added tokens do, the index of a token stands in a
    table at its distance from the smallest one. Others are searched in the order of their ids, in
    batches. Of a repeated token the last index counts; null tokens are unknown.
    """
    low, high = min(codebook_tokens, default=0), max(codebook_tokens, default=-1)
    if high - low >= min(TABLE_ENTRIES, SPARSE * len(codebook_tokens)):
        return _searched(codebook_tokens)(F.slice(_col(token_ids), 1, size).cast("array<bigint>"))
    table = [-1] * (high - low + 1)
    for code, token in enumerate(codebook_tokens):
        table[token - low] = code
    known = F.lit(table) if table else F.array().cast("array<int>")

    def code_of(token):
        place = token.cast("bigint") - low
        inside = place.between(0, len(table) - 1)
        return F.coalesce(F.when(inside, F.get(known, place.cast("int"))), F.lit(-1)).cast("int")

    return F.transform(F.slice(_col(token_ids), 1, size), code_of)


def _searched(codebook_tokens: list[int]):
    """The same lookup by binary search among the sorted tokens, for any tokens."""
    codes = {token: code for code, token in enumerate(codebook_tokens)}
    known = np.array(sorted(codes), np.int64)
    code_of = np.array([codes[t] for t in known.tolist()], np.int32)

    @F.arrow_udf("array<int>")
    def search(rows: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        tokens = rows.flatten()
        asked = pc.fill_null(tokens, 0).to_numpy(zero_copy_only=False)
        place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = (known[place] == asked) & ~tokens.is_null().to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, pa.array(np.where(hit, code_of[place], -1).astype(np.int32)), mask=rows.is_null())

    return search


def normalize_answer(text, prefix: str = ANSWER_PREFIX) -> Column:
    """Stripped, without the fixed answer prefix, whitespace collapsed, lower case."""
    text = strip(text)
    rest = F.substring(text, F.lit(len(prefix) + 1), F.length(text))
    return F.lower(clean(F.when(F.startswith(text, F.lit(prefix)), rest).otherwise(text)))


def tokens(normalized) -> Column:
    """Words of a normalised text; empty text has none."""
    value = _col(normalized)
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.split(value, " "))
