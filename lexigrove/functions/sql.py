"""The text functions as DuckDB SQL, to hold the column expressions against."""

from . import analyze as A


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_MAP = "MAP {" + ", ".join(f"{_quote(k)}: {_quote(v)}" for k, v in A.NAMES.items()) + "}"


_CODES = "MAP {" + ", ".join(f"{k}: {_quote(v)}" for k, v in A.CODES.items()) + "}"


def strip_tags(x: str) -> str:
    return f"""regexp_replace(regexp_replace({x}, '<!--.*?-->', '', 'gs'), '<[^\\s](?:[^''">]|"[^"]*"|''[^'']*'')*(?:>|$)', '', 'gs')"""


def decode_entities(x: str, numeric: bool = False) -> str:
    name = "regexp_extract(p, '^([a-zA-Z][a-zA-Z0-9]*);', 1)"
    one = f"CASE WHEN {name} <> '' AND map_contains({_MAP}, {name}) THEN element_at({_MAP}, {name})[1] || substr(p, length({name}) + 2) ELSE '&' || p END"
    if numeric:
        hexa, deci = "^#[xX]0*([0-9a-fA-F]{1,6});", "^#0*([0-9]{1,7});"
        code = f"(CASE WHEN regexp_matches(p, '{hexa}') THEN ('0x' || regexp_extract(p, '{hexa}', 1))::BIGINT WHEN regexp_matches(p, '{deci}') THEN regexp_extract(p, '{deci}', 1)::BIGINT ELSE -1 END)"
        valid = "c BETWEEN 32 AND 126 OR c IN (9, 10) OR (c >= 160 AND NOT c BETWEEN 55296 AND 57343 AND c <= 1114111 AND NOT c BETWEEN 64976 AND 65007 AND c % 65536 < 65534)"
        one = f"CASE WHEN ({valid.replace('c ', code + ' ')}) THEN coalesce(element_at({_CODES}, {code})[1], ' ') || regexp_replace(p, '^#[0-9a-zA-Z]+;', '') ELSE {one} END"
    return f"(CASE WHEN contains({x}, '&') THEN string_split({x}, '&')[1] || array_to_string(list_transform(string_split({x}, '&')[2:], lambda p: {one}), '') ELSE {x} END)"


def drop_marks(x: str) -> str:
    return f"regexp_replace({x}, '[\\x{{0300}}-\\x{{036F}}\\x{{1AB0}}-\\x{{1AFF}}\\x{{1DC0}}-\\x{{1DFF}}\\x{{20D0}}-\\x{{20FF}}]', '', 'g')"


def transliterate(x: str) -> str:
    for a, b in A.MULTI.items():
        x = f"replace({x}, '{a}', '{b}')"
    return f"translate({x}, '{A.SINGLE_FROM}', '{A.SINGLE_TO}')"


def normalize(x: str, html: bool = True, numeric: bool = False) -> str:
    if html:
        x = decode_entities(strip_tags(x), numeric)
    return f"trim(regexp_replace({transliterate(drop_marks(x))}, '[^a-z0-9]+', ' ', 'g'))"


def trigrams(normal: str) -> str:
    """All trigrams of a normalised text, in order."""
    per = "list_transform(generate_series(1, length(v)), lambda i: substr('#' || v || '#', i, 3))"
    return f"flatten(list_transform(list_filter(string_split({normal}, ' '), lambda u: u <> ''), lambda v: {per}))"


def tokenize(normal: str) -> str:
    """Distinct trigrams of a normalised text, in no order."""
    return f"list_distinct({trigrams(normal)})"
