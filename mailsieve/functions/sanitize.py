"""Clean-up of message text: invisible characters and HTML.

`html_to_text` is a chain of built-in expressions. Its contract: comments,
head, title, style, script and images vanish; links read `text [target]`, or
only the text when both are the same or the target is a page anchor; headings
are upper-cased; list items start with ` * `; paragraphs, headings, lists,
quotes and tables stand between blank lines; other blocks start a new line;
entities are decoded; lines longer than `wrap` break at blanks. Broken markup
is read as far as the patterns go.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailsieve.functions.text import bound
from mailsieve.rules import INVISIBLE, WS

# --- FIXED VALUES: named character references decoded ----------------------
ENTITIES = {
    "&nbsp;": "\u00a0", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&copy;": "©",
    "&reg;": "®", "&trade;": "™", "&hellip;": "…", "&mdash;": "—", "&ndash;": "–", "&lsquo;": "‘",
    "&rsquo;": "’", "&ldquo;": "“", "&rdquo;": "”", "&bull;": "•", "&middot;": "·", "&euro;": "€",
    "&pound;": "£", "&yen;": "¥", "&cent;": "¢", "&sect;": "§", "&para;": "¶", "&deg;": "°",
    "&laquo;": "«", "&raquo;": "»", "&times;": "×", "&amp;": "&",
}
# The first range lets the scan dismiss ASCII after one comparison.
_INVISIBLE = r"[\x{AD}-\x{E007F}&&" + INVISIBLE + "]"
# Private marks; removed from the input before use.
_UP, _DOWN, _ITEM, _BREAK = "\x02", "\x03", "\x04", "\x05"

# pattern -> replacement, in order; `$n` refers to groups. No pattern reads on
# behind the next tag of its kind, and none goes back into what it has read, so
# unclosed tags cost no more than closed ones. A link's tag has to be closed before its
# target is looked for, and only its first target is.
_TARGET = r"""\bhref\s*+=\s*+(?:"(?:mailto:)?([^"<>]*+)"|'(?:mailto:)?([^'<>]*+)'|(?:mailto:)?([^\s<>"']++))"""
_LINK = rf"(?i)<a\b(?=[^<>]*+>)(?>[^<>]*?{_TARGET})[^<>]*+>"
_INSIDE_LINK = r"[^<]*+(?:<(?!/?a\b)[^<]*+)*+"
_INSIDE_HEADING = r"[^<]*+(?:<(?!/?h[1-6]\b)[^<]*+)*+"
_MARKUP = [
    (
        r"(?i)<!--[\s\S]*?(?:-->|\z)|<script\b[\s\S]*?(?:</script\s*>|\z)|<style\b[\s\S]*?(?:</style\s*>|\z)"
        r"|<title\b[\s\S]*?(?:</title\s*>|\z)",
        "",
    ),
    (r"(?i)<head\b[^<]*+(?:<(?!/?(?:head|body)\b)[^<]*+)*+</head\s*+>|<!doctype[^<>]*+>|<img\b[^<>]*+>", ""),
    # White space to single blanks; a blank on its own is left alone.
    (r"[\t\n\x0B\f\r[\x{A0}-\x{FEFF}&&" + WS + "]]", " "),
    (" {2,}", " "),
    (rf"{_LINK} ?(?:\1|\2|\3) ?</a ?>", "$1$2$3"),
    (rf"""(?i)<a\b(?=[^<>]*+>)(?>[^<>]*?\bhref\s*+=\s*+["']?#)[^<>]*+>({_INSIDE_LINK})</a ?>""", "$1"),
    (rf"{_LINK}({_INSIDE_LINK})</a ?>", "$4 [$1$2$3]"),
    (rf"(?i)<h[1-6]\b[^<>]*+>({_INSIDE_HEADING})</h[1-6] ?>", f"\n\n{_UP}$1{_DOWN}\n\n"),
    (r"(?i)<br\b[^<>]*+>", "\n"),
    (r"(?i)<hr\b[^<>]*+>", "\n\n" + "-" * 40 + "\n\n"),
    (r"(?i)<li\b[^<>]*+>", f"{_BREAK}{_ITEM}"),
    (r"(?i)</?(?:p|ul|ol|dl|blockquote|pre|table)\b[^<>]*+>", "\n\n"),
    (
        r"(?i)</?(?:div|article|section|header|footer|nav|main|aside|address|form|fieldset|figure"
        r"|tr|dt|dd|caption|body|html)\b[^<>]*+>",
        _BREAK,
    ),
    (r"(?i)</t[dh] ?>", " "),
    (r"<[A-Za-z/!?][^<>]*+>", ""),
]
def strip_invisible(text: Column) -> Column:
    # All of them lie outside ASCII, where bytes and characters are as many.
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, text).otherwise(F.regexp_replace(text, _INVISIBLE, ""))


def _numeric_reference(piece: Column) -> Column:
    """`8364;rest` or `x20AC;rest`, the text behind an `&#`; null when it is
    not a reference or names a control character (this module's marks are)."""
    shape = r"^(?:([0-9]{1,7})|[xX]([0-9A-Fa-f]{1,6}));"
    code = F.coalesce(
        F.nullif(F.regexp_extract(piece, shape, 1), F.lit("")),
        F.conv(F.nullif(F.regexp_extract(piece, shape, 2), F.lit("")), 16, 10),
    ).try_cast("int")
    utf32 = F.unhex(F.lpad(F.hex(code), 8, "0"))
    valid = code.between(9, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    rest = F.substring(piece, F.locate(";", piece) + 1, F.length(piece))
    return F.when(valid, F.concat(F.decode(utf32, "UTF-32"), rest))


def decode_entities(text: Column) -> Column:
    """Each reference once; what is not known stays as it is."""
    names = F.create_map(*(F.lit(x) for name, char in ENTITIES.items() for x in (name[1:-1], char)))
    # All others that HTML knows; looked up only when the usual ones fail.
    known = {name[:-1]: char for name, char in html5.items() if name.endswith(";")}
    others = F.map_from_arrays(*(F.split(F.lit("\x01".join(x)), "\x01") for x in (known, known.values())))

    def one(piece: Column) -> Column:
        """`amp;rest`, the text behind an `&`."""
        name = F.substring_index(piece, ";", 1)
        char = F.when(F.contains(piece, F.lit(";")), F.coalesce(F.try_element_at(names, name), F.when(F.length(name) < 34, F.try_element_at(others, name))))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        numeric = F.when(F.startswith(piece, F.lit("#")), _numeric_reference(F.substring(piece, 2, 2**31 - 1)))
        return F.coalesce(F.concat(char, rest), numeric, F.concat(F.lit("&"), piece))

    def all_of(t: Column) -> Column:
        pieces = F.split(t, "&")
        tail = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one)
        return F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))

    return F.when(F.contains(text, F.lit("&")), bound(text, all_of)).otherwise(text)


def _upper_headings(text: Column) -> Column:
    def one(piece: Column) -> Column:
        inside = F.substring_index(piece, _DOWN, 1)
        return F.concat(F.upper(inside), F.substring(piece, F.length(inside) + 2, F.length(piece)))

    pieces = F.split(text, _UP)
    return F.concat(
        F.get(pieces, F.lit(0)),
        F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), one), ""),
    )


def wrap_lines(text: Column, width: int) -> Column:
    """Breaks lines at blanks; a longer word keeps a line of its own."""

    def one(line: Column) -> Column:
        broken = F.regexp_replace(line, rf"([^\n]{{1,{width}}})(?: +|\z)", "$1\n")
        return F.when(F.length(line) <= width, line).otherwise(F.regexp_replace(broken, r"\n+\z", ""))

    return F.array_join(F.transform(F.split(text, "\n"), one), "\n")


def _laid_out(text: Column) -> Column:
    """Blanks around line ends go, a _BREAK only counts where no other line
    end is, and there is at most one blank line at a time."""
    text = F.regexp_replace(text, r" *([\n\x05])[ \x05]*", "$1")
    text = F.replace(F.replace(text, F.lit(_BREAK + "\n"), F.lit("\n")), F.lit(_BREAK), F.lit("\n"))
    text = F.regexp_replace(F.regexp_replace(text, r"\n{3,}", "\n\n"), " {2,}", " ")
    return F.replace(F.btrim(text, F.lit(" \n")), F.lit(_ITEM), F.lit(" * "))


def html_to_text(html: Column, wrap: int | None = 120) -> Column:
    text = html
    for mark in (_UP, _DOWN, _ITEM, _BREAK):
        text = F.replace(text, F.lit(mark), F.lit(""))
    for pattern, replacement in _MARKUP:
        text = F.regexp_replace(text, pattern, replacement)
    text = bound(text, lambda t: bound(decode_entities(t), _upper_headings))
    text = _laid_out(text)
    return wrap_lines(text, wrap) if wrap else text


def body_or_html(body: Column, html: Column, wrap: int | None = 120) -> Column:
    """The plain body, or the converted HTML when there is none."""
    empty = F.coalesce(body, F.lit("")) == ""
    return F.when(empty & (F.coalesce(html, F.lit("")) != ""), html_to_text(html, wrap)).otherwise(
        F.coalesce(body, F.lit(""))
    )
