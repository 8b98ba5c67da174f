"""Apache LogFormat strings, compiled once on the driver to a pattern and the
columns that read its groups."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Common presets.
PRESETS = {
    "common": '%h %l %u %t "%r" %>s %b',
    "combined": '%h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i"',
    "vhost_combined": '%v:%p %h %l %u %t "%r" %>s %b "%{Referer}i" "%{User-Agent}i"',
}
SIMPLE = set("halutrmUqHsbBDTIOSvVpPkXRf")
#: Where the other directives go: keys of ``extra``, alone and by their parameter.
ALONE = {"I": "bytes_in", "O": "bytes_out", "S": "bytes_total", "p": "port", "P": "pid", "k": "keepalive", "X": "conn_status", "R": "handler", "f": "filename"}
NAMED = {"i": "", "o": "out:", "C": "cookie:", "n": "note:", "e": "env:", "x": "ssl:", "p": "port:", "P": "pid:"}
NUMERIC, TIME = r"-?\d*|-", r"\[[^\]]*\]"
HEADERS = {"referer": "referer", "user-agent": "user_agent", "host": "host_header", "x-forwarded-for": "forwarded_raw", "content-type": "request_type"}


class LogFormatError(ValueError):
    """A format that cannot be read."""


@dataclass(frozen=True)
class Token:
    literal: str = ""
    letter: str = ""
    name: str | None = None
    quoted: bool = False


def tokenize(fmt: str) -> list[Token]:
    """Literals and directives of a format; ``%%`` is a percent sign, and
    modifiers (``<``, ``>``, ``!``, status lists) are read and dropped."""
    out, at, text = [], 0, ""
    directive = re.compile(r"%(?:[!<>]|\d+,?)*(?:\{([^}]*)\})?(?:\^?)([A-Za-z])")
    while at < len(fmt):
        if fmt.startswith("%%", at):
            text, at = text + "%", at + 2
            continue
        m = directive.match(fmt, at)
        if fmt[at] == "%" and not m:
            raise LogFormatError(f"unreadable directive at {at}: {fmt[at : at + 10]!r}")
        if not m:
            text, at = text + fmt[at], at + 1
            continue
        if text:
            out.append(Token(literal=text))
        after = fmt[m.end() : m.end() + 1]
        out.append(Token(letter=m[2], name=m[1], quoted=text.endswith('"') and after == '"'))
        text, at = "", m.end()
    return [*out, Token(literal=text)] if text else out


def _group(t: Token) -> str:
    if t.quoted:
        return r'((?:[^"\\]|\\.)*)'
    if t.letter == "t":
        return rf"({TIME})" if t.name is None else (r"(\S+(?: \S+)*?)" if " " in t.name else r"(\S+)")
    if t.letter in "sbBDTIOSpPk":
        return rf"({NUMERIC}|\S+)" if t.letter not in "sbB" else rf"({NUMERIC})"
    if t.letter == "U":
        return r"([^\s?]*)"
    return r"(.*?)" if t.letter in "ru" else r"(\S*)"


def pattern(tokens: list[Token]) -> tuple[str, list[Token]]:
    """A pattern for whole lines, and the directive of each group.  Trailing
    directives may be missing, each together with the literal before it."""
    fields = [t for t in tokens if t.letter]
    for t in fields:
        if t.name is None and t.letter not in SIMPLE:
            raise LogFormatError(f"unknown directive %{t.letter}")
    for a, b in zip(tokens, tokens[1:], strict=False):
        if a.letter and b.letter and (a.letter, b.letter) != ("U", "q"):
            raise LogFormatError(f"%{a.letter} and %{b.letter} need something between them")
    units, lit, quoted = [], "", False
    for t in tokens:
        if t.literal:
            text = t.literal
            if quoted and text.startswith('"'):  # the closing quote belongs to its directive
                units[-1], text, quoted = units[-1] + r"\"", text[1:], False
            lit += re.sub(r"([^A-Za-z0-9 ])", r"\\\1", text)
        else:
            units.append(lit + (r"(\?.*?)?" if t.letter == "q" else _group(t)))
            lit, quoted = "", t.quoted
    need = next((k + 1 for k, t in enumerate(fields) if t.letter in "r" or (t.letter == "U")), 1)
    body, tail = "".join(units[:need]), ""
    for k in range(len(units) - 1, need - 1, -1):
        tail = f"(?:{units[k]}{tail})?"
    return f"^{body}{tail}{lit}\\s*$", fields


def unescape(c: Column) -> Column:
    r"""``\"``, ``\\``, ``\t``, ``\n`` and ``\r`` as the server wrote them."""
    out = F.replace(c, F.lit("\\\\"), F.lit("\0"))
    for a, b in (('\\"', '"'), ("\\t", "\t"), ("\\n", "\n"), ("\\r", "\r"), ("\0", "\\")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clf_time(c: Column) -> Column:
    """``[10/Oct/2023:13:55:36 +0000]``; a missing or bad zone is UTC."""
    body = F.regexp_replace(c, r"^\[|\]$", "")
    full = F.try_to_timestamp(body, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    return F.coalesce(full, F.try_to_timestamp(F.split(body, " ")[0], F.lit("dd/MMM/yyyy:HH:mm:ss")))


ENTRY = [
    "remote_host", "remote_logname", "remote_user", "forwarded_for", "ts", "response_usec", "method", "path", "query", "protocol",
    "raw_request", "status", "bytes_sent", "referer", "user_agent", "host_header", "server_name", "content_type", "scheme", "extra",
]


def columns(fields: list[Token], groups: list[Column]) -> dict[str, Column]:
    """Entry columns from the groups of a line.  "-" is null, but empty stays."""
    none = F.lit(None).cast("string")
    out: dict[str, Column] = {c: none for c in ENTRY}
    out |= {"remote_host": F.lit("-"), "path": F.lit(""), "raw_request": F.lit(""), "status": none.cast("int"), "ts": none.cast("timestamp")}
    out |= {"bytes_sent": none.cast("bigint"), "response_usec": none.cast("bigint")}
    out["forwarded_for"] = F.array().cast("array<string>")
    extra: list[Column] = []
    query = None
    for t, raw in zip(fields, groups, strict=True):
        v = F.when(raw != "-", unescape(raw))
        name = (t.name or "").lower()
        number = v.try_cast("bigint")
        if t.letter in "ha" and t.name is None:
            out["remote_host"] = F.coalesce(v, F.lit("-"))
        elif t.letter == "i" and name == "x-forwarded-for":
            hops = F.transform(F.slice(F.split(v, ","), 1, 32), lambda x: F.trim(x))
            out["forwarded_for"] = F.coalesce(F.filter(hops, lambda x: x != ""), F.array().cast("array<string>"))
        elif t.letter == "i" and name in HEADERS and HEADERS[name] in out:
            out[HEADERS[name]] = v
        elif t.letter == "o" and name == "content-type":
            out["content_type"] = v
        elif (t.letter in NAMED and t.name is not None) or t.letter in ALONE:
            key = ALONE[t.letter] if t.name is None else NAMED[t.letter] + t.name
            extra.append(F.struct(F.lit(key).alias("key"), v.alias("value")))
        elif t.letter == "t":
            out["ts"] = clf_time(v) if t.name is None else F.coalesce(
                F.timestamp_seconds(F.when(F.lit(name in ("sec", "")), v.try_cast("double"))),
                F.timestamp_seconds(F.when(F.lit(name == "msec"), v.try_cast("double") / 1e3)),
                F.timestamp_seconds(F.when(F.lit(name == "usec"), v.try_cast("double") / 1e6)),
                clf_time(v),
            )
        elif t.letter == "r":
            p = F.split(v, " ", -1)
            good = F.size(p) == 3
            out |= {
                "method": F.when(good, p[0]), "protocol": F.when(good, F.get(p, F.lit(2))),
                "path": F.coalesce(F.when(good, F.split(F.get(p, F.lit(1)), r"\?", 2)[0]), F.lit("")),
                "query": F.when(good & F.get(p, F.lit(1)).contains("?"), F.get(F.split(F.get(p, F.lit(1)), r"\?", 2), F.lit(1))),
                "raw_request": F.when(~F.coalesce(good, F.lit(False)), F.coalesce(v, F.lit(""))).otherwise(""),
            }
        elif t.letter == "m":
            out["method"] = v
        elif t.letter == "U":
            out["path"] = F.coalesce(v, F.lit(""))
        elif t.letter == "q":
            query = F.when(raw.startswith("?"), F.substring(raw, F.lit(2), F.length(raw)))
        elif t.letter == "H":
            out["protocol"] = v
        elif t.letter == "s":
            out["status"] = v.try_cast("int")
        elif t.letter in "bB":
            out["bytes_sent"] = F.when((raw == "-") & F.lit(t.letter == "b"), F.lit(0).cast("bigint")).otherwise(number)
        elif t.letter == "D":
            out["response_usec"] = number
        elif t.letter == "T":
            out["response_usec"] = F.bround(v.try_cast("double") * 1e6).cast("bigint")
        elif t.letter == "l":
            out["remote_logname"] = v
        elif t.letter == "u":
            out["remote_user"] = v
        elif t.letter in "vV":
            out["server_name"] = v
    if query is not None:
        out["query"] = query
    if extra:
        out["extra"] = F.map_from_entries(F.filter(F.array(*extra), lambda x: x["value"].isNotNull()))
    else:
        out["extra"] = F.create_map().cast("map<string,string>")
    return out
