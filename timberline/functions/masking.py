"""Tokens, masks, captures and patterns of log lines as Spark columns and as DuckDB SQL.

Both engines run the same regular expressions, without look-around. A lone
structural character (one of ``] { } , : <``) is a token by itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: white space, limits, lexical classes and the order of masks
WS = r" \t\n\f\r"
MOST_BYTES = 65_536
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
IP = OCTET + r"(?:\." + OCTET + r"){3}"
ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z"
HEX = r"[0-9a-fA-F]"
UUID = f"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}"
GENERIC = r'\[[^\]]*\]?|"[^"]*"?|<[0-9]*>[0-9]*|' + ISO + "|" + IP + r':[0-9]+|[^ \t\n\f\r\[\]"{},:<]+|[\]{},:<]'
JSON = r'"[^"]*"?|[{},:]|[^ \t\n\f\r{},:"]+'
BLANK = rf"\A[{WS}]*\z"
JSON_START = rf"\A[{WS}]*\{{"
PRI = r"<[0-9]*>[0-9]+"
HTTP = r"(?s)[A-Za-z]+ /.* HTTP/.*"
VERSION = r"^[0-9]+([.][0-9]+|[^.0-9]|$)"
BRACKET_TIME = r"(?s)\[[^:]*:[^:]*:.*\]"
NUMBER = r"-*[0-9.]+"
URL = r"(?i)(?:https?|ftp)://[^ ]+"
#: A URL up to white space, a quote or what closes it; before the other tokens.
WHOLE_URL = r'(?:[hH][tT][tT][pP][sS]?|[fF][tT][pP])://[^ \t\n\f\r\[\]"{}<>,]+'
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: Tokens without any of this stay as they are: no mask can match.
MAYBE = rf'[0-9/"\[@]|^{HEX}{{8}}'
ORDER = ["<TS>", "<UUID>", "<IP>", "<PATH>", "<HEX>", "<NUM>"]


def _full(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def parse_status(raw: Column) -> Column:
    """``empty``, ``too_long`` or ``ok``; a null line is empty."""
    return F.when(raw.isNull() | raw.rlike(BLANK), "empty").when(F.octet_length(raw) > MOST_BYTES, "too_long").otherwise("ok")


def tokens(raw: Column, *, urls: bool = False) -> Column:
    """The tokens of a line that parses, else an empty array; ``urls`` keeps a URL in one token, as its mask needs."""
    every = F.when(raw.rlike(JSON_START), F.regexp_extract_all(raw, F.lit(JSON), F.lit(0))).otherwise(F.regexp_extract_all(raw, F.lit(f"{WHOLE_URL}|{GENERIC}" if urls else GENERIC), F.lit(0)))
    return F.when(parse_status(raw) == "ok", every).otherwise(F.array().cast("array<string>"))


class Mask:
    """A named predicate over a token; ``replace`` gives the masked token (the name by default)."""

    def __init__(self, name: str, matches: Callable[[Column], Column], replace: Callable[[Column], Column] | None = None):
        self.name, self.matches, self.replace = name, matches, replace or (lambda t: F.lit(name))


def _inner(t: Column) -> Column:
    return F.substring(t, F.lit(2), F.length(t) - 2)


def _quoted(t: Column) -> Column:
    return t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)


# Cheap looks at bytes stand before each regular expression, which most tokens then never reach.


def _hex(t: Column) -> Column:
    return (F.octet_length(t) >= 8) & t.rlike(_full("[0-9]*[a-fA-F]" + HEX + "*"))


def _uuid(t: Column) -> Column:
    return (F.octet_length(t) == 36) & t.rlike(_full(UUID))


def _number(t: Column) -> Column:
    """Dashes, then digits and dots, with at least one digit."""
    return t.rlike(_full(r"-*[.]*[0-9][0-9.]*"))


COMPOSITES = [
    Mask("pri", lambda t: t.startswith("<") & t.rlike(_full(PRI)), lambda t: F.regexp_replace(t, "^<[0-9]*>", "<NUM>")),
    Mask("host_port", lambda t: t.contains(":") & t.contains(".") & t.rlike(_full(IP + ":[0-9]+")), lambda t: F.lit("<IP>:<NUM>")),
    Mask(
        "http",
        lambda t: _quoted(t) & t.contains(" HTTP/") & _inner(t).rlike(_full(HTTP)) & F.substring_index(_inner(t), " HTTP/", -1).rlike(VERSION),
        lambda t: F.concat(F.lit('"'), F.substring_index(_inner(t), " ", 1), F.lit(" <PATH> HTTP/"), F.substring_index(_inner(t), " HTTP/", -1), F.lit('"')),
    ),
    Mask("quoted_uuid", lambda t: _quoted(t) & _uuid(_inner(t)), lambda t: F.lit('"<UUID>"')),
    Mask("quoted_hex", lambda t: _quoted(t) & _hex(_inner(t)), lambda t: F.lit('"<HEX>"')),
]
PLAIN = {
    "<TS>": Mask("<TS>", lambda t: (t.startswith("[") & t.rlike(_full(BRACKET_TIME)) & t.rlike("[0-9]")) | ((F.octet_length(t) == 24) & t.rlike(_full(ISO)))),
    "<UUID>": Mask("<UUID>", _uuid),
    "<IP>": Mask("<IP>", lambda t: t.contains(".") & t.rlike(_full(IP))),
    "<PATH>": Mask("<PATH>", lambda t: t.contains("/") & (F.octet_length(t) > 1)),
    "<HEX>": Mask("<HEX>", _hex),
    "<NUM>": Mask("<NUM>", _number),
    # off by default
    "<URL>": Mask("<URL>", lambda t: t.contains("://") & t.rlike(_full(URL))),
    "<EMAIL>": Mask("<EMAIL>", lambda t: t.contains("@") & t.rlike(_full(EMAIL))),
    "<QUOTED>": Mask("<QUOTED>", _quoted),
}


def dictionary(order: list[str] | None = None, extra: list[Mask] | None = None) -> list[Mask]:
    """Composites, then the plain masks named in ``order``, then ``extra``: the first that matches decides."""
    return [*COMPOSITES, *(PLAIN[n] for n in order or ORDER), *(extra or [])]


def rich_dictionary() -> list[Mask]:
    """The masks with URLs and addresses before paths, and quoted text last."""
    return dictionary(["<TS>", "<UUID>", "<IP>", "<URL>", "<EMAIL>", "<PATH>", "<HEX>", "<NUM>", "<QUOTED>"])


def mask_token(t: Column, masks: list[Mask] | None = None) -> Column:
    out = F
    if masks is None:
        out = F.when(~t.rlike(MAYBE), t)
    for m in masks or dictionary():
        out = out.when(m.matches(t), m.replace(t))
    return out.otherwise(t)


def masked(tokens: Column, masks: list[Mask] | None = None) -> Column:
    return F.transform(tokens, lambda t: mask_token(t, masks))


def pattern(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


def _capture(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("placeholder"), value.alias("value"))


def captures(tokens: Column) -> Column:
    """Ordered array of (placeholder, original) of what the default masks replaced."""
    none = F.array().cast("array<struct<placeholder:string,value:string>>")

    def of(t: Column) -> Column:
        m = mask_token(t)
        inner = _inner(t)
        path = F.substring(inner, F.length(F.substring_index(inner, " ", 1)) + 2, F.length(inner) - F.length(F.substring_index(inner, " ", 1)) - 1 - F.length(F.substring_index(inner, " HTTP/", -1)) - 6)
        out = F.when(m == t, none)
        out = out.when(COMPOSITES[0].matches(t), F.array(_capture("<NUM>", F.regexp_extract(t, "^<[0-9]*>", 0))))
        out = out.when(COMPOSITES[1].matches(t), F.array(_capture("<IP>", F.substring_index(t, ":", 1)), _capture("<NUM>", F.substring_index(t, ":", -1))))
        out = out.when(COMPOSITES[2].matches(t), F.array(_capture("<PATH>", path)))
        out = out.when(COMPOSITES[3].matches(t), F.array(_capture("<UUID>", inner)))
        out = out.when(COMPOSITES[4].matches(t), F.array(_capture("<HEX>", inner)))
        return out.otherwise(F.array(F.struct(m.alias("placeholder"), t.alias("value"))))

    return F.flatten(F.transform(tokens, of))


# ---- the same as DuckDB SQL


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_status(raw: str) -> str:
    return f"CASE WHEN {raw} IS NULL OR regexp_matches({raw}, {_q(BLANK)}) THEN 'empty' WHEN octet_length(encode({raw})) > {MOST_BYTES} THEN 'too_long' ELSE 'ok' END"


def sql_tokens(raw: str, urls: bool = False) -> str:
    generic = f"{WHOLE_URL}|{GENERIC}" if urls else GENERIC
    return f"CASE WHEN ({sql_status(raw)}) <> 'ok' THEN CAST([] AS VARCHAR[]) WHEN regexp_matches({raw}, {_q(JSON_START)}) THEN regexp_extract_all({raw}, {_q(JSON)}) ELSE regexp_extract_all({raw}, {_q(generic)}) END"


def sql_mask(t: str) -> str:
    inner, m = f"substr({t}, 2, length({t}) - 2)", lambda x, p: f"regexp_matches({x}, {_q(p)})"
    quoted = f"(starts_with({t}, '\"') AND ends_with({t}, '\"') AND length({t}) >= 2)"
    after = f"list_extract(str_split({inner}, ' HTTP/'), -1)"
    hexed = lambda x: f"({m(x, _full(HEX + '{8,}'))} AND {m(x, '[a-fA-F]')})"
    return (
        f"CASE WHEN {m(t, _full(PRI))} THEN regexp_replace({t}, '^<[0-9]*>', '<NUM>') WHEN {m(t, _full(IP + ':[0-9]+'))} THEN '<IP>:<NUM>' "
        f"WHEN {quoted} AND {m(inner, _full(HTTP))} AND {m(after, VERSION)} THEN '\"' || split_part({inner}, ' ', 1) || ' <PATH> HTTP/' || {after} || '\"' "
        f"WHEN {quoted} AND {m(inner, _full(UUID))} THEN '\"<UUID>\"' WHEN {quoted} AND {hexed(inner)} THEN '\"<HEX>\"' "
        f"WHEN ({m(t, _full(BRACKET_TIME))} AND {m(t, '[0-9]')}) OR {m(t, _full(ISO))} THEN '<TS>' WHEN {m(t, _full(UUID))} THEN '<UUID>' WHEN {m(t, _full(IP))} THEN '<IP>' "
        f"WHEN contains({t}, '/') AND octet_length(encode({t})) > 1 THEN '<PATH>' WHEN {hexed(t)} THEN '<HEX>' WHEN {m(t, _full(NUMBER))} AND {m(t, '[0-9]')} THEN '<NUM>' ELSE {t} END"
    )


def sql_rich_mask(t: str) -> str:
    """Of ``rich_dictionary``: composites, times, ids and addresses, then URLs and e-mail, then the rest, and quoted text last."""
    m = lambda p: f"regexp_matches({t}, {_q(p)})"
    early = f"{m(_full(PRI))} OR {m(_full(IP + ':[0-9]+'))} OR {sql_mask(t)} IN ('<TS>', '<UUID>', '<IP>') OR (starts_with({t}, '\"') AND {sql_mask(t)} NOT IN ({t}, '<PATH>'))"
    quoted = f"(starts_with({t}, '\"') AND ends_with({t}, '\"') AND length({t}) >= 2)"
    return f"CASE WHEN {early} THEN {sql_mask(t)} WHEN {m(_full(URL))} THEN '<URL>' WHEN {m(_full(EMAIL))} THEN '<EMAIL>' WHEN {sql_mask(t)} <> {t} THEN {sql_mask(t)} WHEN {quoted} THEN '<QUOTED>' ELSE {t} END"


def sql_masked(tokens: str) -> str:
    return f"list_transform({tokens}, lambda t: {sql_mask('t')})"
