"""Problem 7: credentials embedded in source code and commands.

Method: token formats, key armor and connection strings are one deterministic automaton. The part of it that leads
to the heads of the grammars is a trie with failure links, which reads the whole text once, in overlapping
windows; from a head on all grammars that begin so are read together, by states made when they are first
met (automaton.py). Further heads (names of credentials, command options, encodings) lead to an expression each, anchored
at the head. Spans are absolute, so what two windows see counts once, and a placeholder is spliced in for each.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeweave.llm.automaton import Automaton
from lodeweave.plans.runtime import spread

WINDOW, OVERLAP = 1 << 16, 1 << 10

# Public formats of tokens by their heads.
_FORMATS = {
    "akia": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "asia": r"ASIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "ghp_": r"ghp_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "gho_": r"gho_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "ghu_": r"ghu_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "ghs_": r"ghs_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "ghr_": r"ghr_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "github_pat_": r"github_pat_[A-Za-z0-9_]{22,}",
    "glpat-": r"glpat-[A-Za-z0-9_\-]{20}(?![A-Za-z0-9])",
    "xoxb-": r"xoxb-[0-9]{6,}-[A-Za-z0-9\-]{16,}",
    "xoxp-": r"xoxp-[0-9]{6,}-[A-Za-z0-9\-]{16,}",
    "xoxa-": r"xoxa-[0-9]{6,}-[A-Za-z0-9\-]{16,}",
    "sk_live_": r"sk_live_[A-Za-z0-9]{16,}",
    "rk_live_": r"rk_live_[A-Za-z0-9]{16,}",
    "aiza": r"AIza[A-Za-z0-9_\-]{35}",
    "npm_": r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "sk_test_": r"sk_test_[A-Za-z0-9]{16,}",
    "whsec_": r"whsec_[A-Za-z0-9+/=]{24,}",
    "sg.": r"SG\.[A-Za-z0-9_\-]{16,32}\.[A-Za-z0-9_\-]{32,64}(?![A-Za-z0-9])",
    "hf_": r"hf_[A-Za-z0-9]{34}(?![A-Za-z0-9])",
    "dckr_pat_": r"dckr_pat_[A-Za-z0-9_\-]{20,}",
    "sk-proj-": r"sk-proj-[A-Za-z0-9_\-]{20,}",
    "sk-ant-": r"sk-ant-[a-z0-9]+-[A-Za-z0-9_\-]{20,}",
    "pypi-ageic": r"pypi-AgEIc[A-Za-z0-9_\-]{40,}",
    "shpat_": r"shpat_[0-9a-fA-F]{32}(?![0-9A-Za-z])",
    "dop_v1_": r"dop_v1_[0-9a-f]{64}(?![0-9A-Za-z])",
    "xapp-": r"xapp-[0-9]-[A-Z0-9]+-[0-9]+-[0-9a-f]{32,}",
    "age-secret-key-": r"AGE-SECRET-KEY-1[0-9A-Z]{58}(?![0-9A-Za-z])",
    "ya29.": r"ya29\.[A-Za-z0-9_\-]{30,}",
    "hooks.slack.com/services/": r"hooks\.slack\.com/services/T[A-Z0-9]{6,}/B[A-Z0-9]{6,}/[A-Za-z0-9]{20,}",
    "/api/webhooks/": r"/api/webhooks/[0-9]{15,}/[A-Za-z0-9_\-]{40,}",
    "eyj": r"eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}",
}
# Names under which credentials are kept.
_NAMES = [
    "password", "passwd", "passphrase", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "accesskey", "access-key",
    "signing_key", "signingkey", "private_key", "privatekey", "credential", "bearer", "authkey", "auth_key",
    "storage_key", "account_key", "accountkey", "encryption_key", "master_key", "private-token", "_pass", "-pass",
]
#: Grammars by the kind of what they find, each with its head, in lower case.
_GRAMMARS = {
    "format": _FORMATS,
    "armor": {"-----begin ": r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[ BLOCK]{0,6}-----"},
    "connection": {"://": r"://[^\s/:@\"'`<>]*:[^\s/@\"'`]+@"},
}
_ARMOR_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_ARMOR_BODY = re.compile(r"(?:[A-Za-z0-9+/=]|\\[nrt]|\s|[\"'+,]|: |Proc-Type|DEK-Info|ENCRYPTED)*?(?=-----END|[^A-Za-z0-9+/=\s\\\"'+,:])|(?:[A-Za-z0-9+/=\\\s]*)")
_BODY_LINE = re.compile(r"^[ \t]*[A-Za-z0-9+/]{20,76}={0,2}[ \t]*\\?n?[ \t]*$")

# Placeholders are closed forms; what a grammar cuts at white space or a quote may lack its closing mark ($(cmd, <your, $conf[).
_PLACEHOLDER = re.compile(
    r"^(?:<.*>|\[.*\]|\(.*\)|%(?-i:[A-Z][A-Z0-9_]*|[a-z][a-z0-9_]*)%|@[\w:./\-]+@|\$\$?\w+)$|^\{[^{}]*\}|\{[^{}]*\}$|^\$\(|^\$[a-z_]\w*(?:->|\[|:[a-z_])|^%\(\w+\)|\{%"
    r"|^[<\[{(][a-z]+(?:[_.\-][a-z]+)*$|^@[a-z]+(?:_[a-z]+)*$"
    r"|\$\{|\{\{|^(?:null|none|nil|true|false|undefined|todo|fixme|redacted\w*|changeme\w*|change[_-]?me|replace[_-]?me|replace[_-]\w+|your[_-]\w+|my[_-]?\w*(?:password|token|secret)|insert[_-]\w+|example\w*|dummy\w*|sample\w*|test|fake\w*|secret|password|token)$"
    r"|(.)\1{5,}|^[x*.\-_#0]+$|(?:your|paste|insert|enter)[_-]?(?:\w+[_-])*(?:here|key|token|password)|process\.env|os\.environ|getenv|EXAMPLE",
    re.I,
)
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_NO_SECRET_NAME = re.compile(
    r"(?:(?:^|[_\-.])(?:id|field|name|file|path|url|uri|type|count|len|length|hash|digest|checksum|sha\d*|md5|fingerprint|pub|public|stdin|ttl|expiry|size|limit|index|prefix|suffix|format|env|var|label|kind)s?|(?:Id|Field|Name|File|Path|Url|Uri|Type|Count|Len|Length|Hash|Digest|Checksum|Pub|Public|Size|Limit|Index|Prefix|Suffix|Format|Label|Kind)s?)(?:_?\d+)?$"
)
_WORDS = re.compile(r"[a-z]+(?:[_.\-/:][a-z]+)*|[A-Z]+(?:[_.\-][A-Z]+)*|(?:[a-z]+|[A-Z][a-z]+)(?:[A-Z][a-z]+)*|[A-Z][a-z]+")
_NUMBER = re.compile(r"[+\-]?[\d_.,:]+[a-zA-Z]{0,2}")


def _is_phrase(value: str, name: str) -> bool:
    """What is_secret leaves out, but a literal under the name of a password holds: short with a digit, or four and more words."""
    if not re.search(r"passw|passphrase|pwd|secret", name, re.I) or _PLACEHOLDER.search(value):
        return False
    return bool(re.fullmatch(r"(?=[A-Za-z]*\d)(?=\d*[A-Za-z])[A-Za-z0-9]{6,7}", value) or re.fullmatch(r"[a-z]{3,}(?:-[a-z]{3,}){3,}", value))


def is_secret(value: str) -> bool:
    """Whether a value in the place of a credential can be one: no placeholder, variable, plain word, number or UUID."""
    if len(value) < 8 or _PLACEHOLDER.search(value) or _UUID.fullmatch(value) or _NUMBER.fullmatch(value) or _WORDS.fullmatch(value):
        return False
    if any(c.isspace() for c in value) or "://" in value or value[0] == "/" or value.startswith(("./", "~/", "../")):
        return False
    lower, upper = any(c.islower() for c in value), any(c.isupper() for c in value)
    digit, other = any(c.isdigit() for c in value), any(not c.isalnum() for c in value)
    return (digit and (lower or upper)) or (lower and upper) or (other and (lower or upper) and not re.fullmatch(r"[\w.\-/]+", value))


_QUOTED = r"(?:\"\"\"|'''|[\"'`])"
_ASSIGN = re.compile(
    r"(?P<rest>[A-Za-z0-9_\-.]*)[\"'`]?\]?[ \t]{0,8}(?::[ \t]{0,2}&?(?:'static )?[A-Za-z][\w<>\[\]]*[ \t]{0,8}(?==))?(?P<op>=>|:=|=(?!=)|:(?!:))(?P<gap>[ \t]*)"
    r"(?:concat!\([ \t]*|String::from\([ \t]*|[brfu]{1,2}(?=[\"'])|new String\([ \t]*)?(?P<q>" + _QUOTED + r")?"
)
_LITERAL = {q: re.compile(r"(?:[^" + q + r"\\\n]|\\.)*") for q in "\"'`"}
_JOIN = re.compile(r"[ \t]*(?:[+.]|,|\\)?[ \t]*(?:\\?\n[ \t]*(?:[+.][ \t]*)?)?(?P<q>[\"'])")
_BARE = re.compile(r"[^\s\"'`;,<>()]+")
_ARG = re.compile(r"\w*[\"'][ \t]*,[ \t]*[\"'](?P<v>[^\"'\n]+)[\"']")
_OPTION = re.compile(r"(?:=|[ \t]+)[\"']?(?P<v>[^\s\"']+)")
_PROSE = re.compile(r"[ \t]+(?P<v>[^\s\"']+)")
_HEADER_VALUE = re.compile(r"[\w\-]*:[ \t]*(?:[A-Z][a-z]+[ \t]+)?(?P<v>[^\s\"']+)(?=[\"'])")
_TOKEN_VALUE = re.compile(r"[ \t]+(?P<v>[^\s\"'`]+)(?=[\"'`])")
_INI_VALUE = re.compile(r"[A-Za-z0-9+/]{32,}={0,2}[ \t]*$", re.M)
_BEARER = re.compile(r"[ \t]+(?P<v>[A-Za-z0-9_\-.+/=~]+)")
_BASIC = re.compile(r"basic[ \t]+(?P<v>[A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/])", re.I)
_USER_OPTION = re.compile(r"-u[ \t]*[\"']?[\w.@\-]+:(?P<v>[^\s\"']+)")
_SSHPASS = re.compile(r"sshpass[ \t]+-p[ \t]*[\"']?(?P<v>[^\s\"']+)", re.I)
_P_OPTION = re.compile(r"-p(?P<q>[\"'])(?P<v>[^\"'\n]+)(?P=q)")
# Clients and the option that holds their password. The option is sought up to the end of the command.
_CLIENT_OPTIONS = {
    "redis-cli": r"(?:-a|--pass)(?:[ \t]|\\\n)+",
    "mysql": r"-p(?=[^\s\"'])",
    "mariadb": r"-p(?=[^\s\"'])",
    "mongo": r"-p(?:[ \t]|\\\n)*",
    "ldapsearch": r"-w(?:[ \t]|\\\n)*",
    "sqlcmd": r"-P(?:[ \t]|\\\n)*",
}
_CLIENTS = {
    c: re.compile(
        c + r"[\w.\-]*(?=\s|\\\n)(?:\\[\s\S]|\"[^\"\n]*\"|'[^'\n]*'|(?!(?i:" + c + r"))[^\n|;&\"'\\])*?(?<=\s)(?-i:" + option + r")(?:(?P<q>[\"'])(?P<v>[^\"'\n]+)(?P=q)|(?P<bare>[^\s\"'`|;&<>()]+))", re.I
    )
    for c, option in _CLIENT_OPTIONS.items()
}
_DECODE = re.compile(r"(?P<v>[A-Za-z0-9+/]{12,}={0,2})[\"']?[ \t]*(?:\|[ \t]*|<<<[ \t]*)?$")


def _decoded(value: str) -> str | None:
    try:
        return base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (ValueError, UnicodeDecodeError):
        return None


def _login(text: str | None) -> bool:
    """Whether decoded text is user:password, or an encoded key."""
    if not text or not text.isprintable():
        return bool(text and "PRIVATE KEY" in text)
    user, colon, password = text.partition(":")
    return bool(colon and user and re.fullmatch(r"[\w.@\-]+", user) and len(password) >= 6 and not _PLACEHOLDER.search(password))


def _armor(text: str, at: int) -> tuple[int, int] | None:
    head = _grammars()["armor"].longest(text, at)
    if not head:
        return None
    end = _ARMOR_END.search(text, head)
    if end and "-----BEGIN" not in text[head : end.start()]:
        return at, end.end()
    body = re.compile(r"(?:[A-Za-z0-9+/=]|\\n|\\r|\s)*").match(text, head)  # cut off: what is there of its body
    return at, len(text[: body.end()].rstrip())


def _armor_rest(text: str, at: int) -> tuple[int, int] | None:
    """The end of a key whose beginning is not in the record: from the first line of its body on."""
    m = _ARMOR_END.match(text, at)
    if not m or "-----BEGIN" in text[:at]:
        return None
    start = text.rfind("\n", 0, at) + 1
    begin = at if not text[start:at].strip() else start + len(text[start:at]) - len(text[start:at].lstrip(" \t\"'"))
    while start:
        before = text.rfind("\n", 0, start - 1) + 1
        if not _BODY_LINE.match(text[before : start - 1]):
            break
        start = before
        begin = start + len(text[start:]) - len(text[start:].lstrip(" \t"))
    return begin, m.end()


def _skipped(text: str, at: int) -> int:
    """The place behind the last character before `at` that is neither blank nor tab."""
    while at and text[at - 1] in " \t":
        at -= 1
    return at


def _after_user(text: str, at: int) -> bool:
    """Whether a user and a slash stand before `at`."""
    i = _skipped(text, at)
    if text[i - 1 : i] != "/":
        return False
    user = _skipped(text, i - 1)
    return user > 0 and (text[user - 1].isalnum() or text[user - 1] in "_.@-")


def _in_quoted_word(text: str, at: int) -> bool:
    """Whether the word that `at` stands in begins behind a quote."""
    while at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        at -= 1
    return text[at - 1 : at] in ("'", '"')


def _named(text: str, at: int, end: int) -> tuple[int, int] | None:
    """A literal or value given to a name that ends in or holds text[at:end]."""
    if text[max(0, at - 2) : at] == "--" or text[at - 1 : at] == "-" and text[at - 2 : at - 1].isspace():
        m = _OPTION.match(text, end)
        if m and not m["v"].startswith("-") and is_secret(m["v"]):
            return m.span("v")
    if _after_user(text, at):
        m = _PROSE.match(text, end)
        if m and is_secret(m["v"]):
            return m.span("v")
    m = _ARG.match(text, end)
    if m and is_secret(m["v"]) and not _NO_SECRET_NAME.search(m.group(0).partition('"')[0]):
        return m.span("v")
    if text[at - 1 : at] in ("'", '"') or _in_quoted_word(text, at):  # a header of a request, quoted
        if (m := _HEADER_VALUE.match(text, end)) and is_secret(m["v"]):
            return m.span("v")
    if text[at:end].lower() == "token" and (text[at - 1 : at] in ("'", '"', "`") or text.endswith("uthorization:", 0, _skipped(text, at))):
        if (m := _TOKEN_VALUE.match(text, end)) and is_secret(m["v"]):
            return m.span("v")
    m = _ASSIGN.match(text, end)
    if not m or text[at:end].lower() in ("_pass", "-pass") and m["rest"]:
        return None
    if _NO_SECRET_NAME.search(m["rest"]) or m["rest"].endswith("."):
        return None
    q = m["q"]
    if q:
        if len(q) == 3:
            stop = text.find(q, m.end())
            value, last = text[m.end() : stop if stop >= 0 else len(text)].strip(), stop
            return (m.end(), stop) if stop >= 0 and is_secret(value) else None
        lit = _LITERAL[q].match(text, m.end())
        value, last = lit.group(0), lit.end()
        while last < len(text) and text[last] == q:  # the literal may be joined from several
            j = _JOIN.match(text, last + 1)
            if not j or j["q"] != q or (j.group(0).strip()[:1] == "," and "concat!" not in m.group(0)) or j.group(0) == q:
                break
            lit = _LITERAL[q].match(text, j.end())
            value, last = value + lit.group(0), lit.end()
        return (m.end(), last) if is_secret(value) or _is_phrase(value, text[at:end]) else None
    bare = _BARE.match(text, m.end())
    if not bare or text[bare.end() : bare.end() + 1] in ("(", "[", "{") or "(" in bare.group(0):
        return None
    line = text[text.rfind("\n", 0, at) + 1 : at]
    after = text[bare.end() :].partition("\n")[0]
    if m["op"] == "=" and not m["gap"] and "=" == text[m.end() - 1]:
        return bare.span() if is_secret(bare.group(0)) else None
    if m["op"] == "=" and m["gap"] and re.fullmatch(r"[ \t]*[\w.\-]*", line) and _INI_VALUE.match(text, m.end()) and is_secret(bare.group(0)):
        return bare.span()
    if m["op"] == ":" and m["gap"] and not after.strip() and re.fullmatch(r"[ \t\-]*[\w.\-]*", line):
        return bare.span() if is_secret(bare.group(0)) else None
    return None


@functools.cache
def _grammars() -> dict[str, Automaton]:
    return {kind: Automaton(grammars.values()) for kind, grammars in _GRAMMARS.items()}


@functools.cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    heads = {h: (kind, _grammars()[kind]) for kind, grammars in _GRAMMARS.items() for h in grammars}
    heads |= {n: ("name", None) for n in _NAMES}
    heads |= {"-----end ": ("rest", None), "basic ": ("basic", None), "-u ": ("user", None), "sshpass": ("sshpass", None), "-p'": ("p", None), '-p"': ("p", None)}
    heads |= {c: ("client", g) for c, g in _CLIENTS.items()}
    heads |= {"base64 -d": ("decode", None), "base64 --decode": ("decode", None), "ls0tls1crudjti": ("encoded", None)}
    for head, (kind, grammar) in heads.items():
        a.add_word(head, (len(head), kind, grammar))
    a.make_automaton()
    return a


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def _read(text: str, at: int, end: int, kind: str, grammar) -> tuple[int, int, str] | None:
    if kind == "format":
        before = text[at - 1 : at]
        stop = 0 if before.isalnum() and before.isascii() and text[at].isalnum() else grammar.longest(text, at)
        if stop and not _PLACEHOLDER.search(text[at:stop]):
            return at, stop, "TOKEN"
    elif kind == "name":
        if text[at:end].lower() == "bearer" and (m := _BEARER.match(text, end)) and is_secret(m["v"]):
            return *m.span("v"), "TOKEN"
        if span := _named(text, at, end):
            return *span, "PASSWORD" if text[at].lower() == "p" else "SECRET"
    elif kind == "armor":
        if span := _armor(text, at):
            return *span, "KEY"
    elif kind == "rest":
        if span := _armor_rest(text, at):
            return *span, "KEY"
    elif kind == "connection":
        if stop := grammar.longest(text, at):
            begin = text.index(":", at + 3) + 1
            value = text[begin : stop - 1]
            if len(value) >= 4 and not _PLACEHOLDER.search(value) and value.lower() not in ("pass", "password", "pwd", "secret", "user"):
                return begin, stop - 1, "PASSWORD"
    elif kind == "basic":
        if (m := _BASIC.match(text, at)) and _login(_decoded(m["v"])):
            return *m.span("v"), "TOKEN"
    elif kind == "user":
        m = _USER_OPTION.match(text, at)
        if m and len(m["v"]) >= 4 and not _PLACEHOLDER.search(m["v"]) and not text[at - 1 : at].isalnum():
            return *m.span("v"), "PASSWORD"
    elif kind == "p":
        m = _P_OPTION.match(text, at)
        if m and len(m["v"]) >= 4 and not _PLACEHOLDER.search(m["v"]) and text[at - 1 : at].isspace() and " " not in m["v"]:
            return *m.span("v"), "PASSWORD"
    elif kind == "sshpass":
        m = _SSHPASS.match(text, at)
        if m and len(m["v"]) >= 4 and not _PLACEHOLDER.search(m["v"]):
            return *m.span("v"), "PASSWORD"
    elif kind == "client":
        m = grammar.match(text, at)
        v = m and (m["v"] or m["bare"])
        if m and len(v) >= 4 and not _PLACEHOLDER.search(v) and not re.fullmatch(r"--?[a-z][a-z\-]*", v) and (text[at:end].lower() == "redis-cli" or is_secret(v)):
            return *m.span("v" if m["v"] else "bare"), "PASSWORD"
    elif kind == "decode":
        line = text.rfind("\n", 0, at) + 1
        m = _DECODE.search(text[line:at])
        if m and (_login(plain := _decoded(m["v"])) or (plain and is_secret(plain))):
            return line + m.start("v"), line + m.end("v"), "TOKEN"
    elif kind == "encoded":
        if m := re.compile(r"LS0tLS1CRUdJTi[A-Za-z0-9+/=]{20,}").match(text, at):
            plain = _decoded(m.group(0)[: len(m.group(0)) // 4 * 4].rstrip("="))
            if plain is None or "PRIVATE" in plain:
                return at, m.end(), "KEY"
    return None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every credential, in order and without overlaps."""
    found: set[tuple[int, int, str]] = set()
    a = _automaton()
    for lo in range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP):
        part = text[lo : lo + WINDOW].translate(_ASCII_LOWER) if not text.isascii() else text[lo : lo + WINDOW].lower()
        for last, (size, kind, grammar) in a.iter(part):
            at = lo + last + 1 - size
            if span := _read(text, at, at + size, kind, grammar):
                found.add(span)
    if not found and (rest := _headless(text)):
        found.add(rest)
    out: list[tuple[int, int, str]] = []
    for s in sorted(found):
        if out and s[0] < out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1] = (out[-1][0], s[1], out[-1][2])
        else:
            out.append(s)
    return out


def _headless(text: str) -> tuple[int, int, str] | None:
    """The inside of a key: a record that begins with lines of its body and has neither of its ends."""
    if not _BODY_LINE.match(text[:80].partition("\n")[0]) or "-----" in text:
        return None
    lines = text.split("\n")
    n = 0
    while n < len(lines) and _BODY_LINE.match(lines[n]):
        n += 1
    if n < 3 or len(lines[0].strip()) != 64:
        return None
    return 0, len("\n".join(lines[:n])), "KEY"


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """text with a placeholder for each span; line breaks stay, so that lines keep their numbers."""
    out, at = [], 0
    for start, end, kind in spans:
        out += [text[at:start], f"REDACTED_{kind}", "\n" * text.count("\n", start, end)]
        at = end
    return "".join([*out, text[at:]])


_OUT = "origin string, record_key string, redacted string, found array<struct<line_no:int,kind:string,start_at:int,end_at:int>>"


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for origin, key, text in zip(rows["origin"], rows["record_key"], rows["text"]):
            if spans := find_spans(text):
                found = [(text.count("\n", 0, s) + 1, k, s, e) for s, e, k in spans]
                out.append((origin, key, redact(text, spans), found))
        if out:
            yield pd.DataFrame(out, columns=["origin", "record_key", "redacted", "found"])


def credentials(records: DataFrame) -> DataFrame:
    """Every record of (origin, record_key, text) that holds credentials, with these and the text without them.

    Result: origin, record_key, redacted, found: array of (line_no from 1, kind, start_at, end_at in characters from 0).
    Whole texts of any length are read. A record whose beginning or end of a key is cut off counts from the first line
    of the key it still holds. Public keys, checksums, UUIDs, placeholders, variables and the names of credentials are
    none. Records with NULL key or NULL or empty text, and those without a credential, give no row. Repeated records
    (same origin, key and text) count once. An empty table gives an empty result; other columns are ignored.
    """
    rows = records.select("origin", F.col("record_key").cast("string").alias("record_key"), "text").filter("record_key is not null and length(text) > 0")
    return spread(rows).mapInPandas(_run, _OUT).dropDuplicates(["origin", "record_key", "redacted"])
