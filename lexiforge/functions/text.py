"""Text functions: splitting symbols, segments, decoding. All built-in, so they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiforge.functions.patterns import HEAD, LETTERS, RUN_SYMBOLS, SCRIPT, SYMBOLS, char_class

#: The characters of ``(?U)\s``, listed: that class looks up the type of every character.
SPACE = r"[\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
#: The same characters as ``[SCRIPT]`` and as a class of SYMBOLS, with a bound first: most characters are decided by it.
SCRIPT_PATTERN = rf"[ [[\u2E80-\x{{10FFFF}}]&&[{SCRIPT}]]]"
SYMBOL_PATTERN = f"[{char_class(''.join(c for c in SYMBOLS if c < '~') + '~')}[[^\\x00-\\x7F]&&{char_class(''.join(c for c in SYMBOLS if c > '~'))}]]"


def strip(text: Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def rstrip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def truncate_lines(text: Column, n: int = 1000) -> Column:
    """At most ``n`` characters of a line."""
    return F.left(text, F.lit(n))


def split_symbols(text: Column, limit: int | None = 1000) -> Column:
    """A blank before every symbol that follows a non-blank and behind every symbol that a non-blank follows.

    Digits, accented letters and tabs are symbols here. ``limit`` cuts lines as truncate_lines does.
    """
    line = rstrip(text)
    if limit is not None:
        line = truncate_lines(line, limit)
    line = F.regexp_replace(line, f"(?<=[^ ])(?=[^{LETTERS}])", " ")
    return F.regexp_replace(line, f"(?<=[^{LETTERS}])(?=[^ ])", " ")


def split_symbol_runs(text: Column) -> Column:
    """A blank between any two neighbouring symbols of the fixed list."""
    run = char_class(RUN_SYMBOLS)
    return F.regexp_replace(strip(text), f"(?<={run})(?={run})", " ")


def split_digits(text: Column) -> Column:
    """Every digit stands alone."""
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[^ ])(?=[0-9])", " "), r"(?<=[0-9])(?=[^ ])", " ")


def digits_apart(text: Column) -> Column:
    """Text with the same words as that of ``split_digits``, by one look at each character; there may be more blanks."""
    return F.regexp_replace(text, "[0-9]", " $0 ")


def split_sentences(text: Column, stop: str = "。") -> Column:
    """An array of sentences, each with its stop; an empty rest is left out."""
    return F.filter(F.split(text, f"(?<={stop})"), lambda s: s != "")


def normalize_for_model(text: Column) -> Column:
    """A head mark first, and one for every blank."""
    return F.concat(F.lit(HEAD), F.translate(text, " ", HEAD))


def has_script(text: Column) -> Column:
    """Holds a character of Japanese script or a blank."""
    return text.rlike(SCRIPT_PATTERN)


def has_symbol(text: Column) -> Column:
    return text.rlike(SYMBOL_PATTERN)


def contains_keyword(text: Column, keyword: str) -> Column:
    return F.contains(text, F.lit(keyword))


def words(text: Column) -> Column:
    """An array of the words between Unicode white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def chars(text: Column) -> Column:
    """An array of code points."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def byte_pieces(char: Column) -> Column:
    """The pieces ``<0x..>`` of a character's UTF-8 bytes."""
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.concat(F.lit("<0x"), F.substring(digits, i * 2 + 1, F.lit(2)), F.lit(">")))


def byte_fallback(pieces: Column, is_known: Column) -> Column:
    """``pieces`` where those flagged unknown (an array of booleans beside them) become byte pieces."""
    return F.flatten(F.zip_with(pieces, is_known, lambda p, k: F.when(k, F.array(p)).otherwise(byte_pieces(p))))


def decode_pieces(pieces: Column) -> Column:
    """The text of a piece array: byte pieces as UTF-8, head marks as blanks, one leading blank dropped.

    Bytes that are no UTF-8 become U+FFFD, one for each longest start of a character, as Unicode recommends.
    """
    is_byte = lambda p: p.rlike("^<0x[0-9A-F]{2}>$")
    raw = lambda p: F.when(is_byte(p), F.substring(p, 4, 2)).otherwise(F.hex(F.encode(F.translate(p, HEAD, " "), "UTF-8")))
    data = F.unhex(F.array_join(F.transform(pieces, raw), ""))
    return F.regexp_replace(F.make_valid_utf8(data.cast("string")), "^ ", "")


def add_eod(ids: Column, eod: int, pair: Column | None = None) -> Column:
    """``ids EOD``, or ``ids EOD pair EOD``."""
    one = F.array_append(ids, F.lit(eod))
    return one if pair is None else F.concat(one, F.array_append(pair, F.lit(eod)))


def type_ids(ids: Column, pair: Column | None = None) -> Column:
    """0 for the first sequence and its end, 1 for the second."""
    zeros = F.array_repeat(F.lit(0), F.size(ids) + 1)
    return zeros if pair is None else F.concat(zeros, F.array_repeat(F.lit(1), F.size(pair) + 1))
