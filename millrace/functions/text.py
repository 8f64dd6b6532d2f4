"""Text normalisation as Column expressions. Java needs (?U) to see white space as Unicode does."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, StringType

#: Characters without which a text is in NFC already.
_COMPOSABLE = (
    r"[\p{M}\u0340-\u0387\u0958-\u09DF\u0A33-\u0A5E\u0B5C\u0B5D\u0F43-\u0FB9\u1100-\u11FF\u1F71-\u1FFD\u2000\u2001\u2126\u212A\u212B"
    r"\u2329\u232A\u2ADC\uF900-\uFAFF\uFB1D-\uFB4E\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1F}]"
)
_CONTROL = r"[\p{Cc}\p{Cf}&&[^\n\t\x{200D}]]"
_UNCLEAN = r"[\u00a0\p{Cc}\p{Cf}&&[^\n\t\x{200D}]]"
#: White space beyond that of ASCII, which is what is left after the removal of control characters.
_WIDE = r"[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: Line ends beyond \n that survive the removal of control characters.
_LINES = r"[\n\u2028\u2029]"
_ALL_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"
_SPACE = r"(?U)[\s\x1C-\x1F]+"
_EDGES = r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$"
UNKNOWN = ("", *"无 未知 null none unknown".split())
_PLAIN = "[0-9A-Za-z一-鿿]"


def any_of(*words: str) -> str:
    """A group that matches any of the words."""
    return "(?:" + "|".join(words) + ")"


def _has(c: Column, pattern: str, least: str) -> Column:
    """Whether a pattern of characters from `least` on is met. Most texts have no such character, which
    one range tells much faster than the pattern's many."""
    return c.rlike(rf"[{least}-\x{{10FFFF}}]") & c.rlike(pattern)


def _composed(values: list) -> list:
    return [v if v is None else unicodedata.normalize("NFC", v) for v in values]


@F.arrow_udf(StringType())
def _nfc(x: pa.Array) -> pa.Array:
    return pa.array(_composed(x.to_pylist()), pa.string())


def nfc(c: Column) -> Column:
    """Unicode NFC. Only texts that may change go through Arrow; the others never leave the JVM."""
    return F.coalesce(_nfc(F.when(_has(c, _COMPOSABLE, r"\u0300"), c)), c)


@F.arrow_udf(ArrayType(StringType()))
def _nfc_each(x: pa.Array) -> pa.Array:
    return pa.array([v if v is None else _composed(v) for v in x.to_pylist()], pa.list_(pa.string()))


def nfc_each(c: Column) -> Column:
    """nfc() for the items of a list."""
    return F.coalesce(_nfc_each(F.when(F.exists(c, lambda x: _has(x, _COMPOSABLE, r"\u0300")), c)), c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, _EDGES, "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), then)[0]


def without_controls(c: Column) -> Column:
    """No-break spaces become spaces, line ends \\n, and control and format characters go, but for
    tabs, line ends and the joiner of emoji. Texts without any, nearly all, are only looked through."""
    done = F.regexp_replace(F.regexp_replace(F.translate(c, "\u00a0", " "), r"\r\n?", "\n"), _CONTROL, "")
    return F.when(c.rlike(_UNCLEAN), done).otherwise(c)


def _by_line(c: Column, ends: str) -> Column:
    lines = F.transform(F.split(c, ends), lambda x: stripped(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def _quickly(c: Column) -> Column:
    """_by_line() where spaces, tabs and \\n are the only white space, without taking lines apart."""
    return F.btrim(F.regexp_replace(F.regexp_replace(c, r"[ \t]{2,}|\t", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))


def one_line(c: Column) -> Column:
    """Every run of white space becomes a space."""
    plainly = lambda t: F.regexp_replace(t, r"[ \t\n]{2,}|[\t\n]", " ")
    return F.trim(let(without_controls(c), lambda t: F.when(_has(t, _WIDE, r"\u1680"), F.regexp_replace(t, _SPACE, " ")).otherwise(plainly(t))))


def kept_lines(c: Column) -> Column:
    """Lines are kept, each with single spaces and without edges; blank ones go."""
    return let(without_controls(c), lambda t: F.when(_has(t, _WIDE, r"\u1680"), _by_line(t, _LINES)).otherwise(_quickly(t)))


def normalized(c: Column, lines: bool = False) -> Column:
    """NFC, then one_line() or kept_lines(); a null is an empty text."""
    c = nfc(F.coalesce(c, F.lit("")))
    return kept_lines(c) if lines else one_line(c)


def simply_cleaned(c: Column, lines: bool = False) -> Column:
    """The lighter cleaning of the simple converter: no NFC, no removal of controls."""
    c = stripped(F.translate(F.coalesce(c, F.lit("")), "\u00a0", " "))
    return _by_line(c, _ALL_LINES) if lines else F.regexp_replace(c, _SPACE, " ")


def is_unknown(c: Column) -> Column:
    return F.lower(c).isin(*UNKNOWN)


def is_blank(c: Column) -> Column:
    return stripped(c) == ""


def plain_length(c: Column) -> Column:
    """Number of Chinese characters, ASCII letters and digits."""
    return F.regexp_count(c, F.lit(_PLAIN))


def plain(c: Column) -> Column:
    return F.regexp_replace(c, _PLAIN.replace("[", "[^", 1), "")
