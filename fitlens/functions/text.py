"""HTML and whitespace cleaning as column expressions."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace in the Unicode sense, without and with the line feed. Java's \s is
# ASCII only, so the separators and the control spaces are listed.
BLANK = r"\t\x0B\f\r\x1C-\x1F\x85\p{Z}"
SPACE = BLANK + r"\n"

_ENTITY = r"&(?:[a-zA-Z][-.a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);?"
_OPEN_REFERENCE = r"(&(?:[a-zA-Z][-.a-zA-Z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+))(?=<)"
_BARE_AMPERSAND = r"&(?=(?:#[xX]?)?<)"
_MARKUP = "|".join((
    r"<(?i:(script|style))\b[^>]*+>(?s:.*?)(?:</(?i:\1)\s*+>|\z)",
    r"<!--(?s:.*?)-->",
    r"<![a-zA-Z\[][^>]*+>",
    r"<\?[^>]*+>",
    r"""</?[a-zA-Z](?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+>""",
))


def _as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """``body`` applied to ``value`` evaluated once per row. A lambda that captures an
    expression, or a chain of conditions that repeats it, would evaluate it many times."""
    return F.transform(F.array(value), body)[0]


_SPACE_CHARS = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(text: Column | str) -> Column:
    """Remove Unicode whitespace at both ends. ``trim`` with a character set reads the ends
    only, which matters for the many short lines of a long text."""
    return F.trim(_as_column(text), F.lit(_SPACE_CHARS))


def _entity_table() -> Column:
    """Every named HTML character reference, from the standard table of names."""
    names = {k.rstrip(";"): v for k, v in html.entities.html5.items()}
    return F.from_json(F.lit(json.dumps(names)), "map<string,string>")


def _decode_reference(ref: Column) -> Column:
    """One character reference to its text; an unknown name keeps its ampersand."""
    body = F.regexp_replace(ref, r"\A&|;\z", "")
    hexa = F.lower(F.substring(body, 2, 1)) == "x"
    # A number may have any count of leading zeros; one of more digits than these is too large
    # to be a character.
    number = F.regexp_replace(body, r"\A#[xX]?0*", "")
    digits = F.when(F.length(number) > F.when(hexa, 8).otherwise(10), "9999999").when(
        hexa, F.conv(number, 16, 10)).otherwise(F.when(number == "", "0").otherwise(number))
    code = digits.try_cast("bigint")
    windows = F.array(*[F.lit(bytes([i]).decode("cp1252", "replace")) for i in range(128, 160)])
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    numeric = (
        F.when(code.between(128, 159), F.try_element_at(windows, (code - 127).cast("int")))
        .when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        .otherwise("\ufffd")
    )
    named = F.coalesce(F.try_element_at(_entity_table(), body), F.concat(F.lit("&"), body))
    return F.when(body.startswith("#"), numeric).otherwise(named)


def decode_entities(text: Column | str) -> Column:
    """Decode character references exactly once.

    The distinct references of a text are few, so each is replaced in one sweep, those for
    the ampersand itself last. Where sweeps could touch each other's output (a reference
    without its semicolon, two spellings of the ampersand) the text is cut at every
    reference instead."""
    return let(_as_column(text), lambda t: F.when(~F.contains(t, F.lit("&")), t).otherwise(
        let(F.array_distinct(F.regexp_extract_all(t, F.lit(_ENTITY), F.lit(0))), lambda refs: _decode_all(t, refs))))


def _decode_all(text: Column, refs: Column) -> Column:
    pairs = F.transform(refs, lambda r: F.struct(r.alias("ref"), _decode_reference(r).alias("char")))

    def sweep(table: Column) -> Column:
        plain = F.filter(table, lambda p: p["char"] != "&")
        ampersands = F.filter(table, lambda p: p["char"] == "&")
        return F.aggregate(F.concat(plain, ampersands), text,
                           lambda done, p: F.replace(done, p["ref"], p["char"]))

    def cut(table: Column) -> Column:
        gaps = F.split(text, _ENTITY, -1)
        found = F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0))
        chars = let(F.map_from_entries(table), lambda m: F.transform(found, lambda r: F.element_at(m, r)))
        return F.array_join(F.zip_with(gaps, chars, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit("")))), "")

    return let(pairs, lambda table: F.when(
        F.forall(table, lambda p: p["ref"].endswith(";") & ~p["char"].startswith("&"))
        | ((F.size(F.filter(table, lambda p: p["char"].startswith("&"))) == 1)
           & F.forall(table, lambda p: p["ref"].endswith(";") & (~p["char"].startswith("&") | (p["char"] == "&")))),
        sweep(table)).otherwise(cut(table)))


def clean_html(text: Column | str) -> Column:
    """Text of an HTML fragment: scripts, styles, comments and tags dropped, entities
    decoded. Nothing is put between neighbouring text nodes."""
    text = F.coalesce(_as_column(text), F.lit(""))
    # A reference ends where markup begins. Closing it there keeps it apart from the text
    # that follows once the markup is gone.
    text = F.regexp_replace(F.regexp_replace(text, _OPEN_REFERENCE, "$1;"), _BARE_AMPERSAND, "&amp;")
    return decode_entities(F.regexp_replace(text, _MARKUP, ""))


def normalize_whitespace(text: Column | str) -> Column:
    """Three or more line feeds to two, runs of blanks to one, every line stripped.

    Line feeds collapse before the lines are stripped, so lines that hold only
    blanks still leave longer gaps."""
    text = F.coalesce(_as_column(text), F.lit(""))
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r" {2,}", " ")
    text = F.regexp_replace(text, rf"(?md)^[{BLANK}]++|[{BLANK}]++$", "")
    return F.regexp_replace(text, r"\A\n++|\n++\z", "")


def clean_text(text: Column | str) -> Column:
    """HTML cleaning followed by whitespace normalization."""
    return normalize_whitespace(clean_html(text))


def truncate(text: Column | str, size: int) -> Column:
    """The first ``size`` characters, the form in which texts are kept beside vectors."""
    return F.substring(_as_column(text), 1, size)


def contains_any(text: Column, words) -> Column:
    """True when the text holds at least one of the words as a substring. Pass a plain
    column or lambda variable, not an expression: it is read once per word.

    A word that holds another word of the list cannot change the answer and is left out."""
    needed = [w for w in dict.fromkeys(words) if not any(o != w and o in w for o in words)]
    hit = F.lit(False)
    for i, word in enumerate(needed):
        test = F.contains(text, F.lit(word))
        hit = hit | test if i else test
    return hit


def one_value(body: Column) -> Column:
    """Whether a text is one JSON value and nothing else. The JSON readers stop at the end of the first
    value; put into a list and into an object, no text with more behind it reads as the only item of both."""
    in_list = F.json_array_length(F.concat(F.lit("["), body, F.lit("]"))) == 1
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), body, F.lit("}"))).isNotNull()
    return F.coalesce(in_list & in_object, F.lit(False))
