"""Markup to text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: entity names and the characters they stand for ---------------------------------
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\xa0", "iexcl": "¡", "cent": "¢",
    "pound": "£", "yen": "¥", "sect": "§", "copy": "©", "laquo": "«", "reg": "®", "deg": "°", "plusmn": "±",
    "para": "¶", "middot": "·", "raquo": "»", "iquest": "¿", "times": "×", "szlig": "ß", "auml": "ä", "ouml": "ö",
    "uuml": "ü", "Auml": "Ä", "Ouml": "Ö", "Uuml": "Ü", "agrave": "à", "aacute": "á", "acirc": "â", "ccedil": "ç",
    "egrave": "è", "eacute": "é", "ecirc": "ê", "iacute": "í", "ntilde": "ñ", "oacute": "ó", "uacute": "ú",
    "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "bull": "•",
    "hellip": "…", "euro": "€", "trade": "™",
}
# ---- End of fixed values --------------------------------------------------------------------------

# what is not text: comments, and script and style elements with their content; without an end, to the end
HIDDEN = (r"(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)")
# elements that begin and end lines
BLOCKS = (r"(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|"
          r"h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*(?:>|\z)")
TAGS = r"(?s)<[/!?]?[A-Za-z][^>]*(?:>|\z)"
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"


def entities_decoded(text: Column) -> Column:
    """The text with named and numbered characters in place, each decoded once.

    What is no known name, or no number of a character, stays as it stands.
    """
    known = F.create_map(*[F.lit(part) for pair in ENTITIES.items() for part in pair])

    def decoded(piece: Column) -> Column:
        name = F.regexp_extract(piece, REFERENCE, 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
            F.when(F.startswith(name, F.lit("#")), F.substring(name, 2, 7))).cast("int")
        there = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        number = F.lpad(F.hex(F.when(there, code).otherwise(F.lit(32))), 8, "0")
        character = F.when(there, F.decode(F.unhex(number), "UTF-32")).otherwise(F.try_element_at(known, name))
        rest = F.substring(piece, F.length(name) + 2, F.length(piece))
        return F.coalesce(F.concat(character, rest), F.concat(F.lit("&"), piece))

    pieces = F.split(text, "&")
    return F.array_join(F.transform(pieces, lambda piece, i: F.when(i == 0, piece).otherwise(decoded(piece))), "")


def markup_text(html: Column) -> Column:
    """The readable text of a page: one line per block element, white space run together, characters decoded.

    Comments, scripts and styles go with their content, other tags go alone. A tag ends at its first ``>``; one
    without an end goes to the end. NULL stays NULL, a page without text is empty.
    """
    shown = F.regexp_replace(html, HIDDEN, " ")
    flat = F.regexp_replace(shown, r"[ \t\n\x0B\f\r]+", " ")
    lines = F.regexp_replace(F.regexp_replace(flat, BLOCKS, "\n"), TAGS, "")
    tidy = F.btrim(F.regexp_replace(F.regexp_replace(lines, " +", " "), r" ?\n[ \n]*", "\n"), F.lit(" \n"))
    return F.when(F.contains(tidy, F.lit("&")), entities_decoded(tidy)).otherwise(tidy)
