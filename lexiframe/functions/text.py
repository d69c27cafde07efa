"""Column functions on text: predicates, heading clean-up, normalisation, pre-tokenization.

Everything here returns a ``Column`` of JVM expressions; no Python worker runs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour)
# ---------------------------------------------------------------------------
# Special tokens, in id order 0..6.
SPECIAL_TOKENS = ["[UNK]", "[PAD]", "[CLS]", "[SEP]", "[MASK]", "[EOS]", "[BOS]"]
# Boundary markers of the web-text variant (both ends).
WEB_MARKER = "<|endoftext|>"
# Pre-tokenizer: runs of word characters, or runs of other non-space characters.
WORD_PATTERN = r"\w+|[^\w\s]+"
# ---------------------------------------------------------------------------

# Java form of the heading clean-up.  ``\A(.*?)`` anchors the single
# replacement at the first heading line; (?d) makes \n the only line end and
# ``[^\n]`` is Python's ``.`` without DOTALL.
_JAVA_HEADING = r"(?sdm)\A(.*?)^ ?(?:= )+([^\n]+) ?(?:= ?)+$"

# Specials are swapped for marked numbers before normalisation, so they survive lower-casing and
# pre-tokenization as single tokens: a mark, digits, a mark, all Unicode noncharacters (untouched by NFD, case
# mapping and accent stripping).  A mark that stands in the text itself is doubled up with an escape first, so
# no text can pass for a special, and there is no limit on the number of specials.
_MARK, _ESCAPE = "\uFDD0", "\uFDD1"
_DIGITS = [chr(c) for c in range(0xFDD2, 0xFDF0)]
_SENTINEL_CLASS = "\\uFDD0-\\uFDEF"


def sentinel_for(index: int) -> str:
    digits = ""
    while True:
        index, d = divmod(index, len(_DIGITS))
        digits = _DIGITS[d] + digits
        if not index:
            return _MARK + digits + _MARK


def unescape(token: str) -> str:
    """A pre-token with its escaped marks restored."""
    return token.replace(_MARK + _ESCAPE, _MARK)


def non_blank(text: Column) -> Column:
    """True when the text has a non-whitespace character (Unicode aware)."""
    return text.rlike(r"(?U)\S")


def non_empty(text: Column) -> Column:
    """True unless the text is exactly the empty string."""
    return text != F.lit("")


def strip_heading(text: Column) -> Column:
    """Replace the first wiki heading line by its captured title."""
    return F.regexp_replace(text, _JAVA_HEADING, "$1$2")


def _is_ascii_or_sentinel(text: Column) -> Column:
    return ~text.rlike(f"[^\\x00-\\x7f{_SENTINEL_CLASS}]")


def _decomposed(text: Column) -> Column:
    """Canonical decomposition (NFD), by the Unicode library that Spark itself uses for collations."""
    return F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False))


def normalize(text: Column) -> Column:
    """NFD -> lowercase -> strip accents, in the JVM.

    ASCII rows are lower-cased only.  Characters are lowered one by one, so a final capital sigma is not
    special; accent marks (category Mark, as the JVM's Unicode version has them) go last.
    """
    other = F.lower(F.replace(_decomposed(text), F.lit("\u03A3"), F.lit("\u03C3")))
    return (F.when(_is_ascii_or_sentinel(text), F.lower(text))
            .when(text.isNotNull(), F.regexp_replace(other, r"\p{M}+", "")))


def pretokenize(text: Column) -> Column:
    """array<string> of pre-tokens: ``\\w+`` runs or runs of other non-space characters."""
    return F.regexp_extract_all(text, F.lit("(?U)" + WORD_PATTERN), 0)


def pretokenize_keep_specials(text: Column) -> Column:
    """Like ``pretokenize`` but every special is a token of its own (escaped marks stay escaped)."""
    pattern = (f"(?U){_MARK}[{_DIGITS[0]}-{_DIGITS[-1]}]+{_MARK}|\\w+"
               f"|(?:{_MARK}{_ESCAPE}|[^\\w\\s{_MARK}])+")
    return F.regexp_extract_all(text, F.lit(pattern), 0)


def protect_specials(text: Column, specials: list[str]) -> Column:
    """Replace every occurrence of a special string by its sentinel.

    One match test per row; only rows that contain a special are cut into
    special and ordinary segments by one regular expression, whatever the
    number of specials, and put together again."""
    escaped = F.regexp_replace(text, _MARK, _MARK + _ESCAPE)
    if not specials:
        return escaped
    any_special = "|".join(_java_quote(t) for t in specials)
    segments = F.regexp_extract_all(text, F.lit(f"(?s){any_special}|(?:(?!{any_special}).)+"), 0)
    names = F.from_json(F.lit(json.dumps(specials)), "array<string>")
    marks = F.from_json(F.lit(json.dumps([sentinel_for(i) for i in range(len(specials))])), "array<string>")

    def replaced(seg: Column) -> Column:
        at = F.array_position(names, seg)
        return F.when(at > 0, F.get(marks, (at - 1).cast("int"))).otherwise(
            F.regexp_replace(seg, _MARK, _MARK + _ESCAPE))

    return F.when(text.rlike(any_special), F.array_join(F.transform(segments, replaced), "")).otherwise(escaped)


def _java_quote(s: str) -> str:
    return "\\Q" + s.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def words(text: Column) -> Column:
    """Normalised pre-tokens of a text (what vocabulary training counts)."""
    return pretokenize(normalize(text))



#: Pre-token pattern of byte-level vocabularies (fixed value; must equal the vocabulary's own).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: visible Latin-1 characters for themselves, the others for
    U+0100 onwards in byte order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    return [chr(b) if b in visible else chr(0x100 + others.index(b)) for b in range(256)]


def byte_chars(text: Column) -> Column:
    """A text with each of its UTF-8 bytes written as the character that stands for it (JVM only)."""
    moved = [(chr(b), c) for b, c in enumerate(byte_alphabet()) if chr(b) != c]
    # Java's translate cannot hold U+0000 in a table, so that byte goes first
    latin = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    return F.translate(F.replace(latin, F.lit("\0"), F.lit(moved[0][1])), "".join(b for b, _ in moved[1:]),
                       "".join(c for _, c in moved[1:]))


def byte_pretokens(text: Column, specials: list[str]) -> Column:
    """array<string>: pre-tokens of the unchanged text (case and spaces kept) in byte characters; a special string
    is a token of its own, as its sentinel."""
    import re

    # (?U) for Unicode white space in \s; \p{L} and \p{N} are Unicode in either case
    named = "|".join(re.sub(r"([^\w])", r"\\\1", s) for s in specials)
    # an alternative before the others would not stop a run from swallowing a special, so the text is split first
    parts = F.split(text, f"(?={named})|(?<={named})") if specials else F.array(text)

    def tokens(part: Column) -> Column:
        out = F.transform(F.regexp_extract_all(part, F.lit("(?U)" + BYTE_LEVEL_PATTERN), 0), byte_chars)
        for i, s in enumerate(specials):
            out = F.when(part == F.lit(s), F.array(F.lit(sentinel_for(i)))).otherwise(out)
        return out

    return F.flatten(F.transform(parts, tokens))
