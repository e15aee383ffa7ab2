"""Credentials embedded in source code.

Method: token formats, key armour and connection-string and assignment grammars are combined into
one deterministic automaton (``automaton``), which decides with exact counts where a rule matches.
Texts are scanned in overlapping chunks, and what goes on beyond its chunk is followed by the same
automaton; each match is split by the grammar of its rule into context and value, the absolute spans
of the values are deduplicated, and `mask` splices placeholders over them. An exact check then drops
stand-ins, references to values that are held elsewhere and values too plain to be a secret.

Defined results: null and empty codes and rows without a key give nothing; repeated rows give their spans again; positions
count characters from 0; of overlapping spans the one of the stronger rule stays (key armour, links,
assignments, token formats); an opening armour line without its closing line gives nothing; texts of
any length are read whole; an empty table gives an empty result; extra columns don't matter.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.automaton import Automaton, compile_rules

CHUNK, OVERLAP, MOST_CHARS = 1 << 16, 1 << 13, 1 << 21

#: Endings of names that hold a secret.
_NAMES = (
    r"pass(?:word|wd|wort|[-_]?phrase|code)?|kennwort|p(?:s?wd|w)|secret|token|auth|credentials?|contrase[nñ]a|senha|mot_?de_?passe"
    r"|(?:api|access|secret|private|signing|hmac|encryption|master|auth|account|deploy|shared(?:access)?|ssh|session|service|client)[-_]?key"
)
_NAME = rf"[\w.-]*(?:(?i:{_NAMES})|[a-z_]Pin|_pin|_PIN|PIN|pin)"
_SET = r"[ \t]*(?:=>|:=|\+=|=|:[ \t]*[A-Za-z]+[ \t]+=|:)[ \t]*"
_B64 = r"[A-Za-z0-9+/]"
_WORD = r"(?i:password|passwort|passphrase|pass phrase|passwd|pwd|pw|token|secret|api key|access key|pin)"

#: The grammars; group v is the secret. Order is strength.
RULES = {
    "armour_begin": r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "armour_end": r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----",
    "link_login": r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@"'<>`]*:(?P<v>[^\s/@"'<>`]+)@""",
    "link_hook": r"""https?://(?:hooks?\.[\w.-]+|[\w.-]+/api/webhooks|[\w.-]+/hooks?)/(?:[\w.~-]+/)*(?P<v>[\w.~-]{8,})""",
    "netrc": r"machine[ \t]+\S+[ \t]+login[ \t]+\S+[ \t]+password[ \t]+(?P<v>\S+)",
    "markup_pair": rf"""(?i:key|name)=["'](?:{_NAME})["'][ \t]+(?i:value)=["'](?P<v>[^"'\r\n]+)["']""",
    "connect_call": r"""(?i:connect|login|authenticate)\([ \t]*["'][^"'\r\n]*["'],[ \t]*["'][^"'\r\n]*["'],[ \t]*["'](?P<v>[^"'\r\n]+)["']""",
    "assign_double": rf"""{_NAME}["'\]]{{0,2}}{_SET}[rbuf]?"(?P<v>(?:[^"\\\r\n]|\\.)+)\"""",
    "assign_single": rf"""{_NAME}["'\]]{{0,2}}{_SET}[rbuf]?'(?P<v>(?:[^'\\\r\n]|\\.)+)'""",
    "assign_back": rf"""{_NAME}["'\]]{{0,2}}{_SET}`(?P<v>[^`\r\n]+)`""",
    "assign_bare": rf"""{_NAME}{_SET}(?P<v>[^\s"'`,;(){{}}\[\]<>$][^\s"'`,;(){{}}\[\]<>]*)""",
    "environment": rf"(?:ENV|ARG|setenv)[ \t]+{_NAME}[ \t]+(?P<v>[^\s\"'`=$][^\s\"'`]*)",
    "user_option": r"""(?:-u|--user)[ \t=]["']?[^\s:"'/]+:(?P<v>[^\s"']+)""",
    "password_option": rf"""--{_NAME}[ \t=]+["']?(?P<v>[^\s"'$][^\s"']*)""",
    "client_option": r"""(?:mysql|mysqldump|mysqladmin|mariadb)[ \t](?:[^\r\n]*[ \t])?-p(?P<v>[^\s"'$][^\s"']*)""",
    "bearer": r"(?i:bearer)[ \t]+(?P<v>[\w.~+/-]{12,}={0,2})",
    "basic": rf"(?i:basic)[ \t]+(?P<v>{_B64}{{6,}}={{0,2}})",
    "remark": rf"{_WORD}(?:[ \t]+[a-z]+){{0,4}}[ \t]*(?::|[ \t]is|[ \t]was|=)[ \t]+(?P<v>[^\s\"'`]{{6,}})",
    "token_access_id": r"(?P<v>(?:AKIA|ASIA|AROA|AIDA)[0-9A-Z]{16})",
    "token_google": r"(?P<v>AIza[\w-]{30,40})",
    "token_github": r"(?P<v>(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{22,}))",
    "token_prefixed": r"(?P<v>(?:glpat-|npm_|hf_|dop_v1_|pypi-|shpat_|lin_api_|hbk_|sk_live_|sk_test_|rk_live_|pk_live_|whsec_)[\w-]{16,})",
    "token_chat": r"(?P<v>xox[abeoprs]-[A-Za-z0-9-]{10,})",
    "token_mail": rf"(?P<v>(?:key-[a-z0-9]{{32}}|SG\.[\w-]{{16,}}\.[\w-]{{16,}}|sk-[A-Za-z0-9]{{32,}}))",
    "token_model": r"(?P<v>sk-(?:proj|ant|svcacct|admin)-[\w-]{20,})",
    "token_session": r"(?P<v>ya29\.[\w-]{20,})",
    "token_phone": r"(?P<v>SK[0-9a-f]{32})",
    "token_shop": r"(?P<v>sq0(?:atp|csp|idp)-[\w-]{22,})",
    "token_bot": r"(?P<v>[0-9]{6,12}:AA[\w-]{33})",
    "token_list": r"(?P<v>[0-9a-f]{32}-us[0-9]{1,2})",
    "token_signed": r"(?P<v>eyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,})",
}
#: Rules that begin with a name: they start where a run of name characters does.
_NAMED = frozenset(n for n in RULES if n.startswith("assign") or n == "remark")
#: Tokens of one length: nothing may go on after them.
_FIXED = frozenset({"token_access_id", "token_phone", "token_bot", "token_list"})
_STRENGTH = {name: i for i, name in enumerate(RULES)}
_COMPILED = {name: re.compile(p) for name, p in RULES.items()}

#: Whole values that stand for another.
_STAND_IN = re.compile(
    r"(?:change[-_ ]?(?:me|this|it)|replace[-_ ]?(?:me|this)|my[-_ ]?(?:password|secret|token|key)|place[-_ ]?holder|examples?|dummy|sample|fake|mock|todo|tbd|fixme|redacted|masked|hidden|removed|none|null|nil|undefined|unset|empty|true|false"
    r"|yes|no|n/a|default|string|str|text|value|pass(?:word|wd)?|secret|token|(?:api[-_]?)?key|test(?:ing)?|foo(?:bar)?|bar|baz|abc|required|optional|\W+|x+|(.)\1*|.*x{6,}.*|.*\*{3,}.*|.*\.{3,}|.*…)",
    re.I | re.S,
)
#: Words that begin a stand-in if plain words follow.
_STAND_IN_HEAD = re.compile(r"(?:change[-_ ]?(?:me|this|it)|replace[-_ ]?(?:me|this|with)|your|(?:an?[-_ ])?examples?|.{0,20}?place[-_ ]?holder|dummy|sample|fake|mock|todo|fixme)", re.I | re.S)
_ASK = re.compile(r"(?:put|insert|enter|add|set|use)[-_ ](?:[A-Za-z]+[-_ .])*(?:here|value|key|token|password|secret|in|from|your|me|the|via|env|vault|this|it|manager|instead)(?:[-_ .][A-Za-z]+)*", re.I)
_PLAIN_REST = re.compile(r"(?:[-_ .:/][-_ .:/A-Za-z]*|[A-Z][-_ .:/A-Za-z]*)?[-_ ]?\d{0,4}")
#: Small words that make several words a label or a remark and no pass phrase.
_SMALL_WORDS = frozenset("a an and are at be been by can cannot do does enter expired field for forgot from get has have here if in incorrect invalid is it its length long match minimum missing more must new no not of on or please required reset set short should than that the this to too try type use valid was which will with wrong you your".split())


def stand_in(v: str) -> bool:
    """Whether a value stands for another: one of the known ones, or one of the heads with nothing but plain words behind it."""
    if _STAND_IN.fullmatch(v) or _ASK.fullmatch(v):
        return True
    head = _STAND_IN_HEAD.match(v)
    return bool(head and _PLAIN_REST.fullmatch(v, head.end()) and not (v[head.end() - 1].isupper() and v[head.end() : head.end() + 1].isupper()))


def _phrase(words: list[str]) -> bool:
    """Whether several words are a pass phrase: plain words in small letters, none of them a small word."""
    return len(words) >= 3 and all(w.isalpha() and w.islower() and len(w) >= 3 for w in words) and not _SMALL_WORDS & set(words)


_REFERENCE = re.compile(
    r"(?:\$[A-Za-z_]\w*|%[A-Za-z_]\w*%|.*\$\{.*|.*\{\{.*|.*\$\(.*|.*%\(\w+\)s.*|.*<[\w -]+>.*|\{[\w.]*\}|%s|(?:vault|env|ssm|sops|file|secret|secrets|secretsmanager|keyvault|kms|op|bw|gcp|arn|ref|!\w+)[:/].*|(?:/run|/etc|/var|\./|~/).*"
    r"|(?:os|process|env|config|settings|self|this|request|params|System|Deno|vault|secrets|cfg|ctx|args|options|props|data|app|conf|context)[.\[(].*|https?://[^@]*)",
    re.S,
)
_PATH_OF_NAMES = re.compile(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)*")
_INSIDE = np.array([chr(c).isalnum() or chr(c) in "_.-" or c == 128 for c in range(129)])
_DIGEST = re.compile(r"(?:sha\d+[:-]|md5[:-]|h1:).*", re.I)


def _encoded(v: str) -> bool:
    """Whether v is base64 of a printable text."""
    try:
        plain = base64.b64decode(v, validate=True)
    except (ValueError, binascii.Error):
        return False
    return len(plain) >= 6 and all(32 <= c < 127 for c in plain)


_CAMEL = re.compile(r"_*[A-Za-z]?[a-z]*(?:_?[A-Z][a-z]+)*_*")


def _scrambled(v: str) -> bool:
    """Whether v changes between small and capital letters often and isn't made of capitalised words."""
    return len(v) >= 10 and not _CAMEL.fullmatch(v) and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", v)) + len(re.findall(r"(?<=[a-z])[A-Z](?=[a-z])", v)) >= 4


def _acceptable(rule: str, text: str, whole: tuple[int, int], a: int, b: int) -> bool:
    v = text[a:b]
    if len(v) < 4 or stand_in(v) or _REFERENCE.fullmatch(v) or _DIGEST.fullmatch(v) or "-----BEGIN" in v:
        return False
    if rule == "basic":
        try:
            return b":" in base64.b64decode(v + "=" * (-len(v) % 4), validate=True)
        except (ValueError, binascii.Error):
            return False
    if rule == "bearer":
        return bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) or _scrambled(v)
    if rule in ("assign_bare", "environment", "remark", "client_option", "password_option", "netrc"):
        after = text[b : b + 1]
        if after and not after.isspace() and after not in ";,\"'`)}]&<":
            return False
    if rule == "assign_bare":
        if after in ("[", "(", "<", "{"):
            return False
        sep = text[whole[0] : a]
        tight = sep[-1] == "=" and not sep[-2:-1].isspace() and sep[-2:] not in (":=", "+=")
        strong = bool(re.search(r"\d", v)) or bool(re.search(r"[^\w.]", v)) or _encoded(v) or _scrambled(v)
        if not tight and not strong:
            return False
        if not tight and _PATH_OF_NAMES.fullmatch(v) and "." in v:
            return False
        if tight and not strong and (len(v) < 8 or v.islower() or v.isupper()):
            return False
        return len(v) >= 6 and not re.fullmatch(r"[\d.]+", v)
    if rule == "remark":
        mixed = bool(re.search(r"\d", v)) or bool(re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and re.search(r"[!#$%&*@^~]", v)) or _scrambled(v)
        return mixed and bool(re.search(r"[A-Za-z]", v)) and len(v) >= 8 and not v.startswith(("/", "./", "--"))
    if rule in ("assign_double", "assign_single", "assign_back", "markup_pair"):
        words = v.split()
        return len(words) == 1 or bool(re.search(r"\d", v)) and not _SMALL_WORDS & {w.lower() for w in words} or _phrase(words)
    return not (rule in _FIXED and text[b : b + 1].isalnum())


@lru_cache(maxsize=1)
def automaton() -> Automaton:
    """The automaton of all rules, made once a process."""
    return compile_rules(RULES, _NAMED, frozenset(n for n in RULES if n.startswith("token")))


def _tidy(rule: str, text: str, a: int, b: int) -> tuple[int, int]:
    if rule in ("remark", "assign_bare", "environment"):
        while b > a and text[b - 1] in ",;" or text[a:b].endswith("*/"):
            b -= 2 if text[a:b].endswith("*/") else 1
    return a, b


def scan(machine: Automaton, texts: list[str]) -> Iterator[tuple[int, int, int, str]]:
    """(index of the text, start, length, rule) of each secret, in order."""
    # overlapping chunks of each text, a bounded number of characters at a time; the spans of one text are settled together
    held, total = [], 0
    for i, t in enumerate(texts):
        mine = [(i, at) for at in range(0, max(1, len(t) - OVERLAP if len(t) > CHUNK else 1), CHUNK - OVERLAP)]
        if held and total + len(t) > MOST_CHARS:
            yield from _settle(texts, _matches(machine, texts, held))
            held, total = [], 0
        if len(t) > MOST_CHARS:
            found: dict[int, set[tuple[int, int, str]]] = {}
            step = max(1, MOST_CHARS // CHUNK)
            for first in range(0, len(mine), step):
                for k, v in _matches(machine, texts, mine[first : first + step]).items():
                    found.setdefault(k, set()).update(v)
            yield from _settle(texts, found)
            continue
        held += mine
        total += len(t)
    if held:
        yield from _settle(texts, _matches(machine, texts, held))


def _matches(machine: Automaton, texts: list[str], pieces: list[tuple[int, int]]) -> dict[int, set[tuple[int, int, str]]]:
    parts = [texts[i][at : at + CHUNK] for i, at in pieces]
    codes = np.frombuffer("\x00".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = machine.codes(codes)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    classes[begins[1:] - 1] = machine.classes[129]
    low = np.minimum(codes, 128)
    inside = _INSIDE[low]
    # matches start where a run of name characters does; within one after dashes and dots, or at dashes
    fresh, dashes = np.ones(len(low), bool), np.zeros(len(low), bool)
    fresh[1:] = ~inside[:-1] | ~inside[1:]
    for p, (i, at) in enumerate(pieces):  # a chunk may begin inside a run
        if at and sizes[p] and inside[begins[p]] and _INSIDE[min(ord(texts[i][at - 1]), 128)]:
            fresh[begins[p]] = False
    dashes[1:] = ~fresh[1:] & (((low[:-1] == 45) | (low[:-1] == 46)) & (low[1:] != 45) | (low[1:] == 45) & (low[:-1] != 45))
    place = fresh | dashes
    starts, alone = np.flatnonzero(machine.first[0][low] & place), np.flatnonzero(machine.first[1][low] & place)
    state = np.concatenate([np.where(dashes[starts], 2, 1), np.full(len(alone), 3)])
    starts = np.concatenate([starts, alone])
    results, unfinished = machine.longest(classes, starts, state)
    which = np.searchsorted(begins, starts, side="right") - 1
    beyond: dict[int, list[tuple[int, int]]] = {}
    open_ = set()
    for lane in unfinished.tolist():
        i, at = pieces[int(which[lane])]
        if at + CHUNK < len(texts[i]):
            open_.add(lane)
            a = int(starts[lane] - begins[which[lane]]) + at
            if a < at + CHUNK - OVERLAP:  # else the next chunk begins before it
                beyond.setdefault(i, []).append((a, int(state[lane])))
    out: dict[int, set[tuple[int, int, str]]] = {}
    for r, (lanes, ends) in enumerate(results):
        for lane, end in zip(lanes.tolist(), ends.tolist(), strict=True):
            if lane not in open_:
                p = int(which[lane])
                i, at = pieces[p]
                out.setdefault(i, set()).add((int(starts[lane] - begins[p]) + at, int(end - begins[p]) + at, machine.names[r]))
    for i, lanes in beyond.items():
        out.setdefault(i, set()).update(_follow(machine, texts[i], lanes))
    return out


def _follow(machine: Automaton, text: str, lanes: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """Matches that begin at the given places and go on beyond their chunk, by the automaton in growing windows of the text."""
    size = 4 * CHUNK
    while lanes:
        first = min(a for a, _ in lanes)
        near = [x for x in lanes if x[0] < first + size // 2]
        codes = machine.codes(np.frombuffer(text[first : first + size].encode("utf-32-le", "surrogatepass"), np.uint32))
        results, open_ = machine.longest(codes, np.array([a - first for a, _ in near]), np.array([x for _, x in near]))
        again = set(open_.tolist()) if first + size < len(text) else set()
        for r, (which, ends) in enumerate(results):
            yield from ((near[k][0], int(e) + first, machine.names[r]) for k, e in zip(which.tolist(), ends.tolist(), strict=True) if k not in again)
        lanes = [near[k] for k in sorted(again)] + [x for x in lanes if x[0] >= first + size // 2]
        size *= 4 if again else 1


def _settle(texts: list[str], matches: dict[int, set[tuple[int, int, str]]]) -> Iterator[tuple[int, int, int, str]]:
    """The secrets among the matches of each text."""
    for i, found in sorted(matches.items()):
        text = texts[i]
        spans: set[tuple[int, int, str]] = set()
        closing: dict[str, list[tuple[int, int]]] = {}
        for a, b, rule in sorted(found):
            if rule == "armour_end":
                closing.setdefault(text[a + 9 : b], []).append((a, b))
        done = -1
        for a, b, rule in sorted(x for x in found if x[2] == "armour_begin"):
            ends = closing.get(text[a + 11 : b], [])
            k = bisect_left(ends, (b, b))
            if k < len(ends) and a >= done:
                done = ends[k][1]
                spans.add((a, done, "armour_begin"))
        for a, b, rule in found:
            if rule.startswith("armour"):
                continue
            m = _COMPILED[rule].match(text, a, b)
            if not m:
                continue
            x, y = _tidy(rule, text, *m.span("v"))
            if _acceptable(rule, text, m.span(), x, y):
                spans.add((x, y, rule))
        kept: list[tuple[int, int, str]] = []  # in order and apart, so only the neighbours can overlap
        for a, b, rule in sorted(spans, key=lambda s: (_STRENGTH[s[2]], s[0], -s[1])):
            k = bisect_left(kept, (a, b, rule))
            if (k == 0 or kept[k - 1][1] <= a) and (k == len(kept) or kept[k][0] >= b):
                kept.insert(k, (a, b, rule))
        for a, b, rule in kept:
            yield i, a, b - a, rule


def find_secrets(rows: DataFrame, key: str, code: str) -> DataFrame:
    """(key, start_pos, n_chars, rule) of each secret of each text."""
    machine = rows.sparkSession.sparkContext.broadcast(automaton())
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, texts = batch[key].tolist(), batch[code].tolist()
            for first in range(0, len(texts), 2048):
                part = texts[first : first + 2048]
                out = [(ids[first + i], a, n, rule) for i, a, n, rule in scan(machine.value, part)]
                yield pd.DataFrame(out, columns=[key, "start_pos", "n_chars", "rule"])

    return rows.select(key, code).where(F.col(key).isNotNull() & F.col(code).isNotNull() & (F.col(code) != "")).mapInPandas(run, f"`{key}` {kind}, start_pos int, n_chars int, rule string")


def masked(machine: Automaton, texts: list[str | None], placeholder: str = "REDACTED") -> list[str | None]:
    """The texts with their secrets replaced by the placeholder; everything around them stays and null stays null."""
    spans: dict[int, list[tuple[int, int]]] = {}
    for i, a, n, _ in scan(machine, [t or "" for t in texts]):
        spans.setdefault(i, []).append((a, n))
    out = list(texts)
    for i, found in spans.items():
        parts, done = [], 0
        for a, n in sorted(found):
            parts += [texts[i][done:a], placeholder]
            done = a + n
        out[i] = "".join(parts) + texts[i][done:]
    return out


def mask(text: str | None, machine: Automaton | None = None, placeholder: str = "REDACTED") -> str | None:
    """`masked` for one text."""
    return masked(machine or automaton(), [text], placeholder)[0]


def mask_secrets(code: Column, placeholder: str = "REDACTED") -> Column:
    """`masked` as a Column; null stays null."""
    machine = automaton()

    @F.pandas_udf("string")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(masked(machine, [None if t is None else t for t in batch], placeholder), dtype=object)

    return apply(code)
