"""RESP2 values as columns: constructors, accessors and the wire form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CRLF = "\r\n"


def value(tag: str, text: Column | None = None, number: Column | None = None) -> Column:
    """STRUCT<tag, str, int>; tags are + - : $."""
    return F.struct(F.lit(tag).alias("tag"), (F.lit(None) if text is None else text).cast("string").alias("str"), (F.lit(None) if number is None else number).cast("bigint").alias("int"))


def simple(text: Column) -> Column:
    return value("+", text)


def error(text: Column) -> Column:
    return value("-", text)


def integer(n: Column) -> Column:
    return value(":", number=n)


def bulk(text: Column) -> Column:
    """A null text is the null bulk."""
    return value("$", text)


def as_error(v: Column) -> Column:
    return F.when(v["tag"] == "-", v["str"])


def as_bulk(v: Column) -> Column:
    return F.when(v["tag"] == "$", v["str"])


def encode_bulk(text: Column) -> Column:
    return F.when(text.isNull(), F.lit("$-1" + CRLF)).otherwise(F.concat(F.lit("$"), F.octet_length(text).cast("string"), F.lit(CRLF), text, F.lit(CRLF)))


def encode(v: Column) -> Column:
    """The wire form of a value."""
    return F.when(v["tag"] == "$", encode_bulk(v["str"])).when(v["tag"] == ":", F.concat(F.lit(":"), v["int"].cast("string"), F.lit(CRLF))).otherwise(F.concat(v["tag"], v["str"], F.lit(CRLF)))


def encode_array(texts: Column) -> Column:
    """An array of bulk strings, of ARRAY<STRING>."""
    return F.concat(F.lit("*"), F.size(texts).cast("string"), F.lit(CRLF), F.array_join(F.transform(texts, encode_bulk), ""))


def encode_command(name: Column, args: Column) -> Column:
    """An array of bulk strings: the name, then ARRAY<STRING> of arguments."""
    head = F.concat(F.lit("*"), (F.size(args) + 1).cast("string"), F.lit(CRLF), encode_bulk(name))
    return F.concat(head, F.array_join(F.transform(args, encode_bulk), ""))


def parse_command(wire: Column) -> Column:
    """STRUCT<ok, name, args> of an array of bulk strings of printable text; anything else isn't ok.

    Frames whose strings hold line ends or whose array is nested need sources.wire.
    """
    lines = F.split(wire, CRLF)
    count = F.substring(F.get(lines, F.lit(0)), 2, 10).try_cast("int")
    odd = F.filter(lines, lambda x, i: (i > 0) & (i % 2 == 0))
    sizes = F.filter(lines, lambda x, i: (i % 2 == 1) & (x != ""))
    agree = F.forall(F.arrays_zip(sizes.alias("s"), F.slice(odd, 1, F.greatest(F.size(sizes), F.lit(0))).alias("w")), lambda p: p["s"] == F.concat(F.lit("$"), F.octet_length(p["w"]).cast("string")))
    ok = wire.startswith("*") & wire.endswith(CRLF) & (count >= 1) & (F.size(odd) == count) & (F.size(sizes) == count) & agree
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, F.get(odd, F.lit(0))).alias("name"), F.when(ok, F.slice(odd, 2, F.greatest(F.size(odd) - 1, F.lit(0)))).alias("args"))
