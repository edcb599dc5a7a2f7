"""Text analysis of single strings, for queries on the driver; text.py has it for columns."""

import html.entities
import re
import unicodedata

ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789#"

# letters outside A-Z whose Unicode decomposition is a letter and a mark, and some without one
_BASE = {
    "A": "ÀÁÂÃÄÅ", "C": "Ç", "E": "ÈÉÊË", "I": "ÌÍÎÏİ", "D": "Ð", "N": "Ñ", "O": "ÒÓÔÕÖØ", "U": "ÙÚÛÜ", "Y": "Ý", "S": "ŠŞ", "Z": "Ž", "G": "Ğ",
    "a": "àáâãäå", "c": "ç", "e": "èéêë", "i": "ìíîïı", "d": "ð", "n": "ñ", "o": "òóôõöø", "u": "ùúûü", "y": "ýÿ", "s": "šş", "z": "ž", "g": "ğ",
}
SINGLE = {c: k.lower() for k, v in _BASE.items() for c in v} | {chr(c): chr(c + 32) for c in range(65, 91)}
SINGLE_FROM, SINGLE_TO = "".join(SINGLE), "".join(SINGLE.values())
MULTI = {"Æ": "ae", "Œ": "oe", "Þ": "th", "æ": "ae", "œ": "oe", "þ": "th", "ß": "ss", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]")
_COMMENT, _TAG = re.compile(r"(?s)<!--.*?-->"), re.compile(r"""<[^\s](?:[^'">]|"[^"]*"|'[^']*')*(?:>|$)""")


def _piece(text: str) -> str:
    """What a decoded reference amounts to in a cleaned text."""
    out = ""
    for c in _MARKS.sub("", text):
        c = MULTI.get(c) or SINGLE.get(c, c)
        out += c if re.fullmatch("[a-z0-9]+", c) else " "
    return out


NAMES = {k[:-1]: _piece(v) for k, v in sorted(html.entities.html5.items()) if k.endswith(";")}
CODES = {ord(c): v for c, v in [*SINGLE.items(), *MULTI.items()]} | {ord(c): c for c in ALPHABET if c != "#"}
CODES |= {c: "" for a, z in ((0x300, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF)) for c in range(a, z + 1)}


def strip_tags(text: str) -> str:
    return _TAG.sub("", _COMMENT.sub("", text))


def _valid(code: int) -> bool:
    return 32 <= code < 127 or code in (9, 10) or (code >= 160 and not 0xD800 <= code <= 0xDFFF and code <= 0x10FFFF and not 0xFDD0 <= code <= 0xFDEF and code % 65536 < 65534)


def decode_entities(text: str, keep: bool = False) -> str:
    """As in text.py; with ``keep`` references become the characters they stand for."""

    def one(m):
        if m[1]:
            code = int(m[1][1:], 16) if m[1][0] in "xX" else int(m[1])
            return (chr(code) if keep else CODES.get(code, " ")) if _valid(code) else m[0]
        name = m[2]
        return (html.entities.html5[name + ";"] if keep else NAMES[name]) if name in NAMES else m[0]

    return re.sub("&(?:#([xX]0*[0-9a-fA-F]{1,6}|0*[0-9]{1,7})|([a-zA-Z][a-zA-Z0-9]*));", one, text)


def transliterate(text: str) -> str:
    for x, y in MULTI.items():
        text = text.replace(x, y)
    return text.translate(str.maketrans(SINGLE))


def normalize(text: str, compose: bool = False) -> str:
    text = strip_tags(text)
    text = unicodedata.normalize("NFC", decode_entities(text, True)) if compose else _MARKS.sub("", decode_entities(text))
    return re.sub("[^a-z0-9]+", " ", transliterate(text)).strip(" ")


def tokenize(text: str | None) -> list[str]:
    """Distinct trigrams of the text's words, in order of first occurrence."""
    out: dict[str, None] = {}
    for w in normalize(text or "").split():
        w = f"#{w}#"
        for i in range(len(w) - 2):
            out[w[i : i + 3]] = None
    return list(out)
