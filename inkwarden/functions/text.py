"""Text functions: normalising, signals, redaction and the decodings, on Python strings and as columns."""

from __future__ import annotations

import base64
import codecs
import html
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from urllib.parse import unquote, unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Look-alike letters and the Latin ones they pass for.
LOOKALIKE = "аАеЕоОрРсСуУхХіІјЈѕЅԁԌӏԛѵԝԍптΑΒΕΗΙΚΜΝΟΡΤΥΧοιρϲν"
PASSES_FOR = "aAeEoOpPcCyYxXiIjJsSdGlqvwgntABEHIKMNOPTYXoipcv"
#: Typographic quotes and hyphens and the plain ones.
TYPOGRAPHIC, PLAIN = "’‘“”‐‑", "''\"\"--"
#: Ranges of characters that don't show, and of those that turn the reading direction.
INVISIBLE = "[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufeff\U000e0000-\U000e007f]"
BIDI = "[\u061c\u200e\u200f\u202a-\u202e\u2066-\u2069]"
#: The same for Java's regular expressions.
JAVA_INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{FEFF}\x{E0000}-\x{E007F}]"
JAVA_BIDI = r"[\x{61C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
#: Regions whose tag flags are in general use; their tags are no anomaly.
FLAG_REGIONS = ("gbeng", "gbsct", "gbwls")
FLAGS = tuple("\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in r) + "\U000e007f" for r in FLAG_REGIONS)
EVIDENCE_CHARS = 420

_INVISIBLE, _BIDI = re.compile(INVISIBLE), re.compile(BIDI)
_FLAGS = re.compile("|".join(FLAGS))
_FOLD = dict(zip(LOOKALIKE + TYPOGRAPHIC, PASSES_FOR + PLAIN, strict=True))
_FOLDED = re.compile(f"[{re.escape(LOOKALIKE + TYPOGRAPHIC)}]")
_CONFUSE = str.maketrans(LOOKALIKE, PASSES_FOR)
_BLANKS = re.compile(r"[\t\f\v ]{2,}|[\t\f\v]")  # a single blank stays
_NON_ASCII = re.compile(r"[^\x00-\x7f]+")


@lru_cache(maxsize=1 << 14)
def _without_accents(some: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", some) if unicodedata.category(c) != "Mn")


def normalise(text: str) -> str:
    """One spelling for what reads alike: compatibility forms, look-alikes, quotes, accents, case and blanks folded, invisible characters gone."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = _INVISIBLE.sub("", _FOLDED.sub(lambda m: _FOLD[m[0]], text))
        # ASCII characters are no accents and end the order of those around them, so that passages between them stand alone.
        text = _NON_ASCII.sub(lambda m: _without_accents(m[0]) if len(m[0]) <= 64 else _without_accents.__wrapped__(m[0]), text)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return _BLANKS.sub(" ", text).casefold().strip(" ")


def is_disguised(text: str) -> bool:
    """Whether look-alikes, invisible characters or compatibility forms are in the text."""
    return not text.isascii() and (text.translate(_CONFUSE) != text or bool(_INVISIBLE.search(text)) or not unicodedata.is_normalized("NFKC", text))


def first_bidi(text: str) -> int | None:
    m = None if text.isascii() else _BIDI.search(text)
    return m.start() if m else None


def first_invisible(text: str) -> int | None:
    """Place of the first invisible character that isn't part of a tag flag in general use."""
    if text.isascii():
        return None
    flags = [m.span() for m in _FLAGS.finditer(text)]
    return next((m.start() for m in _INVISIBLE.finditer(text) if not any(a <= m.start() < b for a, b in flags)), None)


#: What is masked in evidence, in this order, with what.
REDACTIONS = (
    (r"(?i)-----BEGIN [^-]*PRIVATE KEY-----[\s\S]*?(?:-----END [^-]*PRIVATE KEY-----|$)", "[REDACTED PRIVATE KEY]"),
    (r"(?i)(\b(?:[\w.-]*(?:secret|password|passwd|token|api[_-]?key|credential)[\w.-]*|authorization)\b[\"']?\s*[:=]\s*)(?:[\"'][^\"'\r\n]*[\"']|[^\s,;<>]+)", "${1}[REDACTED]"),
    (r"(?i)\bBearer\s+[^\s\"'<>]+", "Bearer [REDACTED]"),
    (r"(?i)(https?://)[^\s/@]+:[^\s/@]+@", "${1}[REDACTED]@"),
    (r"(?i)([?&](?:token|key|secret|password|api_key|access_token)=)[^&\s]+", "${1}[REDACTED]"),
    (r"\b(?:sk-[\w-]{8,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{12,}|[A-Za-z0-9+/_=-]{28,})\b", "[REDACTED TOKEN]"),
)
_REDACTIONS = [(re.compile(p), r.replace("${1}", r"\g<1>")) for p, r in REDACTIONS]


def masked(text: str) -> str:
    """A whole text without secrets, invisible characters spelled out."""
    for pattern, mask in _REDACTIONS:
        text = pattern.sub(mask, text)
    spell = lambda m: f"\\u{ord(m[0]):04x}" if ord(m[0]) < 0x10000 else f"\\U{ord(m[0]):08x}"
    return _INVISIBLE.sub(spell, text)


def redact(text: str) -> str:
    """Evidence: :func:`masked`, at most EVIDENCE_CHARS long."""
    return masked(text)[:EVIDENCE_CHARS]


def masked_col(text: Column) -> Column:
    """:func:`masked` in built-in functions, but for the spelling out of invisible characters."""
    for pattern, mask in REDACTIONS:
        text = F.regexp_replace(text, pattern, mask.replace("${1}", "$1"))
    return text


def redact_col(text: Column) -> Column:
    """:func:`redact` in built-in functions, but for the spelling out of invisible characters."""
    return F.substring(masked_col(text), 1, EVIDENCE_CHARS)


# ---- decodings ---------------------------------------------------------------------------------


class DecodingLimit(ValueError):
    """An encoded passage is longer than may be decoded."""


#: The shapes of encoded passages and the longest that is decoded.
PERCENT = r"%[0-9a-fA-F]{2}"
_NEXT = "%[89ab][0-9a-f]"
PERCENT_UTF8 = (
    rf"(?i:(?:%[0-7][0-9a-f]|%(?:c[2-9a-f]|d[0-9a-f]){_NEXT}|%e0%[ab][0-9a-f]{_NEXT}|%ed%[89][0-9a-f]{_NEXT}|%e[1-9a-cef]{_NEXT}{_NEXT}"
    rf"|%f0%[9ab][0-9a-f]{_NEXT}{_NEXT}|%f4%8[0-9a-f]{_NEXT}{_NEXT}|%f[1-3]{_NEXT}{_NEXT}{_NEXT})+)"
)
PLUSES = r"[A-Za-z]\+(?:[A-Za-z]+\+){2}[A-Za-z]"
ENTITY = r"&(?:#[xX]?[0-9a-fA-F]+|[a-zA-Z]+);"
ESCAPE = r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|U[0-9a-fA-F]{8})"
CONCATENATION = "[\"'`]\\s*\\+\\s*[\"'`]"
SPELLED = r"(?<!\w)(?:[A-Za-z][ \t\r\n]){3,}[A-Za-z](?!\w)"
ROT13_SIGNS = r"\b(?:vtaber|vtaben|vtabevrer|vtaberm|vafgehpgvbaf|flfgrz|frpergf|rksvygengr|rot13)\b"
BASE64_LINES = r"(?<![A-Za-z0-9+/])(?:[A-Za-z0-9+/]{8,}[ \t]*\r?\n){1,128}[A-Za-z0-9+/]{4,}={0,2}(?![A-Za-z0-9+/=])"
HEX_PAIRS = r"(?<!\w)(?:[0-9a-fA-F]{2}[ \t:-]){7,}[0-9a-fA-F]{2}(?!\w)"
HEX_RUN = r"(?<!\w)(?:0x)?(?:[0-9a-fA-F]{2}){10,}(?!\w)"
BASE64_TOKEN = r"(?<![\w+/=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![\w+/=-])"
LONGEST_TOKEN = 131_072
PRINTABLE_SHARE, PRINTABLE_LEAST = 0.93, 8
_P = {k: re.compile(v) for k, v in {"percent": PERCENT, "utf8": PERCENT_UTF8, "pluses": PLUSES, "entity": ENTITY, "escape": ESCAPE, "concat": CONCATENATION, "spelled": SPELLED}.items()}
_ROT13 = re.compile(ROT13_SIGNS, re.I)
_ROT13_WORDS = re.findall(r"\w{5,}", ROT13_SIGNS)


def is_printable(text: str) -> bool:
    return len(text) >= PRINTABLE_LEAST and "\x00" not in text and sum(c.isprintable() or c.isspace() for c in text) / len(text) >= PRINTABLE_SHARE


def unquote_some(text: str) -> str:
    """Percent signs decoded where that gives UTF-8; others are text."""
    return _P["utf8"].sub(lambda m: bytes.fromhex(m[0].replace("%", "")).decode(), text)


def unescape(text: str, since: int = 0) -> str:
    def one(m: re.Match) -> str:
        if m.start() < since:
            return m[0]
        point = int(m[0][2:], 16)
        return " " if point > 0x10FFFF or 0xD800 <= point < 0xE000 else chr(point)

    return _P["escape"].sub(one, text)


def join_spelled(text: str, since: int = 0) -> str:
    return _P["spelled"].sub(lambda m: m[0] if m.start() < since else re.sub(r"[ \t\r\n]", "", m[0]), text)


def _from_base64(value: str, url_safe: bool) -> str:
    value = re.sub(r"\s+", "", value)
    return base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if url_safe else None, validate=True).decode("utf-8")


def _from_hex(value: str) -> str:
    return bytes.fromhex(re.sub(r"[ \t:-]", "", value.removeprefix("0x"))).decode("utf-8")


_PASSAGES = (
    (re.compile(BASE64_LINES), "base64-wrapped", lambda v: _from_base64(v, False)),
    (re.compile(HEX_PAIRS), "hex-spaced", _from_hex),
    (re.compile(HEX_RUN), "hex", _from_hex),
    (re.compile(BASE64_TOKEN), "base64", lambda v: _from_base64(v, True)),
)


def _readings(passage: str, decode: Callable[[str], str]) -> Iterator[str]:
    """What a passage decodes to; of lines that don't decode, what the longest rest of two lines or more does: they may run on from a word before them.

    A word may decode with the lines, too: behind a first line of another width than the second, the next rest that decodes is given as well.
    """
    lines = [line.rstrip() for line in passage.split("\n")]
    whole, at, again = "".join(lines), 0, False
    for line, after in zip(lines, lines[1:] or lines, strict=False):
        rest = whole[at:]
        try:
            if at:  # most rests show in their first bytes that they are no text
                codecs.utf_8_decode(base64.b64decode(rest[: min(64, len(rest) // 4 * 4)]))
            out = decode(rest)
        except ValueError:
            out = ""
        if is_printable(out):
            yield out
            if again or len(line) == len(after):
                return
            again = True
        at += len(line)


def decodings(text: str, since: int = 0, strict: bool = True) -> Iterator[tuple[str, str]]:
    """What the text may stand for, with the name of the encoding; whole-text decodings first, then passages.

    Encoded passages that begin before ``since`` stay as they are; ROT13 turns all. Percent signs that aren't UTF-8
    when decoded are an error if ``strict``, and text otherwise.
    """
    behind = lambda decode: lambda t: t[:since] + decode(t[since:])
    percent = _P["percent"].search(text)
    whole: list[tuple[bool, str, object]] = [
        (bool(percent), "url", behind(lambda t: unquote(t, errors="strict") if strict else unquote_some(t))),
        ("+" in text and bool(percent or _P["pluses"].search(text)), "url-form", behind(lambda t: unquote_plus(t, errors="strict") if strict else unquote_some(t.replace("+", " ")))),
        ("&" in text and bool(_P["entity"].search(text)), "html-entity", behind(html.unescape)),
        ("+" in text, "string-concatenation", lambda t: _P["concat"].sub(lambda m: m[0] if m.start() < since else "", t)),
        (True, "split-letters", lambda t: join_spelled(t, since)),
    ]
    for k, (applies, name, decode) in enumerate(whole):
        if k == 3 and "\\" in text and (out := unescape(text, since)) != text:
            yield out, "unicode-escape"
        if applies and (out := decode(text)) != text:
            yield out, name
    folded = text.casefold()
    if any(w in folded for w in _ROT13_WORDS) and _ROT13.search(text):
        yield codecs.decode(text, "rot_13"), "rot13"
    for pattern, name, decode in _PASSAGES:
        for m in pattern.finditer(text):
            if m.start() < since:
                continue
            if len(m[0]) > LONGEST_TOKEN:
                raise DecodingLimit(name)
            for out in _readings(m[0], decode):
                yield out, name


# ---- columns -----------------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def normalise_udf(text: pd.Series) -> pd.Series:
    return text.map(normalise, na_action="ignore")


@F.pandas_udf(T.StringType())
def masked_udf(text: pd.Series) -> pd.Series:
    return text.map(masked, na_action="ignore")


def unquoted(text: str) -> str | None:
    """The text with its percent signs decoded; None where that isn't UTF-8."""
    try:
        return unquote(text, errors="strict")
    except UnicodeDecodeError:
        return None


@F.pandas_udf(T.StringType())
def unquoted_udf(text: pd.Series) -> pd.Series:
    return text.map(unquoted, na_action="ignore")


def fold_confusables(text: Column) -> Column:
    return F.translate(text, LOOKALIKE, PASSES_FOR)


def simple_normal(text: Column) -> Column:
    """The part of :func:`normalise` that built-in functions express: quotes, look-alikes, invisible characters, blanks, lower case."""
    folded = F.translate(text, LOOKALIKE + TYPOGRAPHIC, PASSES_FOR + PLAIN)
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(folded, JAVA_INVISIBLE, ""), r"[\t\f\x0B ]+", " ")))


def unicode_signal(text: Column) -> Column:
    """BIDI_CONTROL before INVISIBLE_CHARACTERS, null without either."""
    rest = F.regexp_replace(text, "|".join(FLAGS), "")
    return F.when(text.rlike(JAVA_BIDI), "BIDI_CONTROL").when(rest.rlike(JAVA_INVISIBLE), "INVISIBLE_CHARACTERS")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def rot13(text: Column) -> Column:
    turned = _UPPER[13:] + _UPPER[:13]
    return F.translate(text, _UPPER + _UPPER.lower(), turned + turned.lower())


def join_concatenated(text: Column) -> Column:
    return F.regexp_replace(text, CONCATENATION, "")


def base_name(path: Column, longest: int) -> Column:
    return F.substring(F.regexp_extract(F.translate(path, "\\", "/"), "[^/]*$", 0), 1, longest)


def lock_stripe(path: Column) -> Column:
    """One of 128 stripes, by the first 32 bits of the path's SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(path, 256), 1, 8), 16, 10).cast("long"), F.lit(128))


def short_hash(digest: Column) -> Column:
    return F.concat(F.substring(digest, 1, 12), F.lit("…"), F.substring(digest, -8, 8))
