"""Numbers as Python rounds and prints them, so that scores and hashes agree with records made elsewhere."""

from __future__ import annotations

import json
import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Splits a double into two halves whose products with a small integer are exact.
_SPLIT = 134217729.0
#: From here on a product has no room for a fraction.
_WHOLE = 9007199254740992.0


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed a single time, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def half_even(x: Column, digits: int = 0) -> Column:
    """A double rounded to so many decimals as Python's ``round`` does: by its exact binary value, ties to even.

    The product with the power of ten is taken together with its rounding error; the error decides where the product stands on a
    tie only because it was rounded. Null, NaN and infinities stay as they are.
    """
    scale = float(10**digits)

    def rounded(v: Column) -> Column:
        p = v * scale
        big = v * _SPLIT
        hi = big - (big - v)
        error = (hi * scale - p) + (v - hi) * scale
        low = F.floor(p).cast("double")
        tie = p - low == 0.5
        near = F.when(tie & (error > 0), low + 1.0).when(tie & (error < 0), low).otherwise(F.rint(p))
        return F.when(F.isnan(v) | (F.abs(p) >= _WHOLE), v).otherwise(near / scale)

    return once(x.cast("double"), rounded)


def half_even_sql(x: str, digits: int = 0) -> str:
    """The same for DuckDB; ``x`` is named several times and should be a column."""
    s, c = f"{10**digits}.0::DOUBLE", f"{_SPLIT:.1f}::DOUBLE"
    hi = f"({x} * {c} - ({x} * {c} - {x}))"
    error = f"(({hi} * {s} - {x} * {s}) + ({x} - {hi}) * {s})"
    tie = f"({x} * {s} - floor({x} * {s}) = 0.5)"
    return f"(CASE WHEN {tie} AND {error} > 0 THEN floor({x} * {s}) + 1 WHEN {tie} AND {error} < 0 THEN floor({x} * {s}) ELSE round_even({x} * {s}, 0) END / {s})"


def python_text(x: Column) -> Column:
    """A double as Python prints it: the shortest digits that give it back, a point or an exponent always, the exponent outside
    1e-4 to 1e16 and of two digits at least.

    Digits are Java's, of which up to three are given up where fewer give the same double back. A double of 15 digits or fewer is always
    printed alike; of those that need more, and of the smallest ones (below 1e-307), the last digit may differ where several are as near.
    """

    def shown(v: Column) -> Column:
        own = F.abs(v).cast("string")
        mantissa, power = F.substring_index(own, "E", 1), F.when(own.contains("E"), F.substring_index(own, "E", -1).cast("int")).otherwise(0)
        whole, part = F.substring_index(mantissa, ".", 1), F.substring_index(mantissa, ".", -1)
        raw = F.concat(whole, part)
        lead = F.length(raw) - F.length(F.ltrim(raw, F.lit("0")))
        digits = F.rtrim(F.substring(raw, lead + 1, F.length(raw)), F.lit("0"))
        point = F.length(whole) + power - lead  # digits before the decimal point

        def fewer(short: Column, n: int) -> Column:
            """The digits rounded to n, if there are more and they give the same double; a carry moves the point."""
            return once(short, lambda x: rounded(x, n))

        def rounded(x: Column, n: int) -> Column:
            cut = F.call_function("div", F.substring(x["d"], 1, n + 1).cast("long") + 5, F.lit(10)).cast("string")
            moved = x["p"] + F.length(cut) - n
            back = F.concat(F.lit("0."), cut, F.lit("E"), moved.cast("string")).cast("double")
            return F.when((F.length(x["d"]) > n) & (back == F.abs(v)), F.struct(F.rtrim(cut, F.lit("0")).alias("d"), moved.alias("p"))).otherwise(x)

        short = F.struct(digits.alias("d"), point.alias("p"))
        for n in (17, 16, 15):
            short = fewer(short, n)
        sign = F.when((v < 0) | own.isNull() | v.cast("string").startswith("-"), "-").otherwise("")

        def placed(x: Column) -> Column:
            d, point = x["d"], x["p"]
            n = F.length(d)
            e = point - 1
            small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), d)
            large = F.concat(d, F.repeat(F.lit("0"), point - n), F.lit(".0"))
            plain = F.concat(F.substring(d, F.lit(1), point), F.lit("."), F.substring(d, point + 1, n))
            rest = F.when(n > 1, F.concat(F.lit("."), F.substring(d, F.lit(2), n))).otherwise("")
            power = F.concat(F.lit("e"), F.when(e < 0, "-").otherwise("+"), F.when(F.abs(e) < 10, "0").otherwise(""), F.abs(e).cast("string"))
            return F.when((e < -4) | (e >= 16), F.concat(F.substring(d, 1, 1), rest, power)).when(point <= 0, small).when(point >= n, large).otherwise(plain)

        number = F.when(v == 0, "0.0").otherwise(once(short, placed))
        return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, number))

    return once(x.cast("double"), shown)


def _held(kind: T.DataType) -> bool:
    """Whether JSON has all that a type holds: maps with keys of text, and no dates, decimals or bytes."""
    if isinstance(kind, T.StructType):
        return all(_held(f.dataType) for f in kind.fields)
    if isinstance(kind, T.MapType):
        return isinstance(kind.keyType, T.StringType) and _held(kind.valueType)
    return _held(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.StringType, T.BooleanType, T.IntegralType, T.DoubleType, T.NullType))


def _plain(value: Column, kind: T.DataType) -> Column:
    """The value with all that JSON doesn't have as text."""
    if _held(kind):
        return value
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(_plain(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.transform_keys(value, lambda k, v: k.cast("string")), lambda k, v: _plain(v, kind.valueType))
    if isinstance(kind, T.FloatType):
        return value.cast("double")
    return F.base64(value) if isinstance(kind, T.BinaryType) else value.cast("string")


def _known(values: pa.Array, shown) -> list[str]:
    """Each distinct value is written once."""
    held = values.dictionary_encode()
    texts = [shown(x) for x in held.dictionary.to_pylist()]
    return [texts[i] for i in held.indices.to_numpy().tolist()]


def _texts(a: pa.Array) -> list[str]:
    """JSON of each value of a column, made of its children's, a column at a time."""
    if a.null_count:
        rest = iter(_texts(a.drop_null()))
        return [next(rest) if ok else "null" for ok in a.is_valid().to_pylist()]
    kind = a.type
    if pa.types.is_null(kind):
        return ["null"] * len(a)
    if pa.types.is_struct(kind):
        names = sorted(kind.names)
        parts = [_texts(x) for x in (a.flatten()[kind.get_field_index(n)] for n in names)]
        form = "{" + ",".join(json.dumps(n, ensure_ascii=False).replace("%", "%%") + ":%s" for n in names) + "}"
        return [form % row for row in zip(*parts)] if names else ["{}"] * len(a)
    if pa.types.is_list(kind) or pa.types.is_map(kind):
        ends = a.offsets.to_numpy() - a.offsets[0].as_py()
        n = a.offsets[-1].as_py() - a.offsets[0].as_py()
        if pa.types.is_list(kind):
            flat = _texts(a.values.slice(a.offsets[0].as_py(), n))
            return ["[" + ",".join(flat[i:j]) + "]" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
        keys, items = (x.slice(a.offsets[0].as_py(), n) for x in (a.keys, a.items))
        flat = list(zip(keys.to_pylist(), _texts(keys), _texts(items)))
        return ["{" + ",".join(f"{k}:{v}" for _, k, v in sorted(flat[i:j])) + "}" for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
    if pa.types.is_float64(kind):  # by their bits: a zero has a sign
        return _known(a.view(pa.int64()), lambda bits: json.dumps(struct.unpack("d", struct.pack("q", bits))[0]))
    return _known(a, lambda x: json.dumps(x, ensure_ascii=False))


@F.arrow_udf(T.StringType())
def _dumped(values: pa.Array) -> pa.Array:
    return pa.array([x for k in range(0, len(values), 512) for x in _texts(values.slice(k, 512))], pa.string())


def json_text(value: Column, kind: T.DataType) -> Column:
    """Canonical JSON of a value: keys by name, no spaces, nulls kept, numbers as Python prints them. Maps are objects, their keys strings;
    dates and timestamps are their text, binary values are base64.

    Python writes it, over Arrow batches: as one expression, a nested record is a plan of some ten thousand nodes."""
    return _dumped(_plain(value, kind))
