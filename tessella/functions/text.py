"""String functions. Lengths and positions are code points, positions from 1."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.expr import Expr, call
from tessella.functions.registry import registry, scalar

lower, upper = scalar(F.lower), scalar(F.upper)
ascii_ = scalar(F.ascii)
char_length, length = scalar(F.char_length), scalar(F.length)
ltrim, rtrim = scalar(F.ltrim), scalar(F.rtrim)
reverse, initcap = scalar(F.reverse), scalar(F.initcap)
md5, sha1 = scalar(F.md5), scalar(F.sha1)
bit_length, octet_length = scalar(F.bit_length), scalar(F.octet_length)
left, right = scalar(F.left), scalar(F.right)
position, replace, repeat_ = scalar(F.position), scalar(F.replace), None


@scalar
def char(*codes: Column) -> Column:
    """The characters of codes, joined."""
    return F.concat(*[F.char(c) for c in codes])


@scalar
def chr_(code: Column) -> Column:
    """The character of a code, taken modulo 256."""
    return F.chr(code)


@scalar
def trim(s: Column, chars: Column | None = None) -> Column:
    return F.trim(s) if chars is None else F.btrim(s, chars)


@scalar
def concat(*parts: Column) -> Column:
    """Nulls are left out; an empty text where all are null."""
    return F.concat_ws("", *parts)


def concat_ws(separator: str, *parts: Any) -> Expr:
    """Joined by a separator; nulls are left out."""
    return call(f"concat_ws:{separator}", lambda *cs: F.concat_ws(separator, *cs), *parts)


def substr(s: Any, start: int, length: int | None = None) -> Expr:
    """From ``start`` (from 1, or from the end if negative)."""
    if start == 0:
        raise ValueError("positions start at 1")
    return call(f"substr{start},{length}", lambda c: F.substring(c, start, 2**31 - 1 if length is None else length), s)


@scalar
def instr(s: Column, part: Column) -> Column:
    return F.position(part, s)


def locate(part: str, s: Any, start: int = 1) -> Expr:
    return call(f"locate{part}{start}", lambda c: F.locate(part, c, start), s)


@scalar
def repeat(s: Column, n: Column) -> Column:
    return F.repeat(s, n.cast("int"))


repeat_ = repeat


def lpad(s: Any, n: int, pad: str = " ") -> Expr:
    return call(f"lpad{n}{pad}", lambda c: F.lpad(c, n, pad), s)


def rpad(s: Any, n: int, pad: str = " ") -> Expr:
    return call(f"rpad{n}{pad}", lambda c: F.rpad(c, n, pad), s)


@scalar
def space(n: Column) -> Column:
    return F.repeat(F.lit(" "), n.cast("int"))


def sha2(s: Any, bits: int = 256) -> Expr:
    return call(f"sha2{bits}", lambda c: F.sha2(c, bits), s)


registry.add("concat_ws", lambda sep, *cs: F.array_join(F.array_compact(F.array(*cs)), sep))
