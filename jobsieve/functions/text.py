"""Text scalars. Strings are folded the same way everywhere, so keys can be equi-joined."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, functions as F

from .. import vocab

# Whitespace as web text has it: Java's \s leaves out the no-break space and kin.
SPACE = r"[\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
NOT_SPACE = r"[^\s\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: The kinds of white space that Java's class leaves out.
WIDE_SPACE = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Every kind of white space, one by one.
WHITE = " \t\n\x0b\f\r" + WIDE_SPACE
# The same classes for Java alone, which settles visible ASCII by one comparison.
_SPACE = f"[[^!-~]&&{SPACE}]"
#: Runs of white space that are not one blank already.
_UNEVEN = f" {_SPACE}+|[{_SPACE}&&[^ ]]{_SPACE}*"


def besides(chars: str) -> str:
    """The class of all characters but ``chars``, in a form that Java tests fast.

    It looks listed Latin-1 characters up in a table. A class that mixes ranges or wider ones with them is many times
    slower when negated, so that one is given as the ranges between its characters.
    """
    if max(chars) < "\u0100":
        return "[^" + "".join(f"\\x{ord(c):02x}" for c in chars) + "]"
    edges = [-1, *sorted({ord(c) for c in chars}), 0x110000]
    ranges = [(a + 1, b - 1) for a, b in zip(edges, edges[1:]) if b - a > 1]
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


def listed(pattern: str) -> str:
    """``pattern`` with its classes of ASCII letters and digits spelled out.

    Java looks such a class up in a table; ranges it tests one after the other, by calls.
    """
    for ranges, chars in (("a-z", string.ascii_lowercase), ("A-Z", string.ascii_uppercase), ("0-9", string.digits)):
        pattern = re.sub(rf"(?<=\[)([^\]^]*?){ranges}", lambda m, c=chars: m[1] + c, pattern)
    return pattern


# ASCII word edges.
EDGE_BEFORE = r"(?<![A-Za-z0-9_])"
EDGE_AFTER = r"(?![A-Za-z0-9_])"


def trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")


def filled(text: Column) -> Column:
    """Whether a text has more than white space: ``trim(text) != ""`` without a regular expression."""
    return F.ltrim(text, F.lit(WHITE)) != ""


def optional(text: Column) -> Column:
    """Trimmed text, with blank meaning absent."""
    return F.nullif(trim(text), F.lit(""))


def required(text: Column) -> Column:
    """Trimmed text, with absent meaning blank."""
    return F.coalesce(trim(text), F.lit(""))


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


# Plural endings of a token: "-ies" becomes "-y"; "-es" goes after s, x, z, ch and sh if two letters
# stand before these; any other "-s" goes unless it follows s, u or i.
# What stands before is looked at last: few letters are an "e" or an "s".
_IES = "ies(?![a-z0-9])(?<=[a-z0-9]ies)"
_S = "(?:es(?![a-z0-9])(?<=[a-z0-9]{2}[sxz]es|[a-z0-9][cs]hes)|s(?![a-z0-9])(?<=[a-z0-9][a-hj-rtv-z0-9]s))"


def fold_plural(tokens: Column) -> Column:
    """The form a plain plural shares with its singular, and nothing more.

    For one lower-case token, or any number of them in one text.
    """
    return F.regexp_replace(F.regexp_replace(tokens, _IES, "y"), _S, "")


def term_key(text: Column) -> Column:
    """Folded tokens joined by one space: the comparison key of a term or field."""
    return fold_plural(F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")))


def plain(text: Column, extra_quote: bool = False) -> Column:
    """Case, quote, dash and whitespace differences removed."""
    quotes = r"[\u2018\u2019\u201b]" if extra_quote else r"[\u2018\u2019]"
    out = F.regexp_replace(text, quotes, "'")
    out = F.regexp_replace(out, r"[\u201c\u201d]", '"')
    out = F.regexp_replace(out, r"[\u2010-\u2015]", "-")
    # a text without any of these needs one step
    return F.lower(F.trim(F.when(_simple(text), _even_ascii(text)).otherwise(F.regexp_replace(out, _UNEVEN, " "))))


def squash(text: Column) -> Column:
    return F.lower(F.trim(F.when(_simple(text), _even_ascii(text)).otherwise(F.regexp_replace(text, _UNEVEN, " "))))


def _simple(text: Column) -> Column:
    """Whether a text surely has no white space beyond ASCII, no curled quote and no dash.

    Those from U+2000 to U+203F begin with the same two bytes.
    """
    wide = [c for c in WIDE_SPACE if not "\u2000" <= c <= "\u203f"]
    some = F.contains(text.cast("binary"), F.lit(b"\xe2\x80"))
    for c in wide:
        some = some | F.contains(text, F.lit(c))
    return (F.octet_length(text) == F.length(text)) | ~some


def _even_ascii(text: Column) -> Column:
    """One blank for each run of ASCII white space."""
    other = r"[\t\n\x0b\f\r]"
    return F.regexp_replace(text, rf" [ \t\n\x0b\f\r]+|{other}[ \t\n\x0b\f\r]*", " ")


def title_case_token(token: Column) -> Column:
    """``acme-labs`` to ``Acme Labs``; letters inside a word keep their case."""
    spaced = F.regexp_replace(token, "[-_]+", " ")
    # A word starts wherever an ASCII word character follows something else.
    marked = F.regexp_replace(spaced, r"(?<![A-Za-z0-9_])([A-Za-z0-9_])", "\u0001$1")
    parts = F.split(marked, "\u0001")
    return trim(
        F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when(i == 0, p).otherwise(
                    F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
                ),
            ),
            "",
        )
    )


def bullet_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def word_count(text: Column) -> Column:
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(inner == "", 0).otherwise(F.array_size(F.split(inner, f"{_SPACE}+")))


def dehyphenate(text: Column) -> Column:
    return F.regexp_replace(text, r"(\p{Ll})-\n(\p{Ll})", "$1$2")


def distinctive_terms(text: Column) -> Column:
    """Distinct content words, numbers kept whole, light plural folding."""
    raw = F.transform(
        F.split(F.lower(text), r"[^a-z0-9.]+"), lambda t: F.regexp_replace(t, r"^\.+|\.+$", "")
    )
    stop = F.array(*[F.lit(w) for w in vocab.LETTER_STOPWORDS])
    kept = F.filter(raw, lambda t: (F.length(t) >= 2) & ~F.array_contains(stop, t))
    return F.array_distinct(
        F.transform(
            kept,
            lambda t: F.when(
                (F.length(t) >= 4) & t.endswith("s") & ~t.endswith("ss"),
                F.left(t, F.length(t) - 1),
            ).otherwise(t),
        )
    )


WORD = r"[\p{L}\p{N}'’]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def snippet(text: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, f"{SPACE}+", " "))
    return F.when(
        F.length(flat) > vocab.SNIPPET_LIMIT,
        F.concat(F.left(flat, F.lit(vocab.SNIPPET_LIMIT - 1)), F.lit("…")),
    ).otherwise(flat)


def plural(count: Column, one: str, many: str | None = None) -> Column:
    return F.when(count == 1, F.lit(one)).otherwise(F.lit(many or one + "s"))


def first_json_object(reply: Column, fenced: bool = False) -> Column:
    """From the first ``{`` to the last ``}``, or null when there is no such pair."""
    text = reply
    if fenced:
        inner = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1)
        has_fence = reply.rlike(r"(?s)```(?:json)?\s*(.*?)```")
        text = trim(F.when(has_fence, inner).otherwise(reply))
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
