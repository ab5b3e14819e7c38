"""Secret redaction in the JVM: the leftmost candidate of any class goes, ties by class order.

All classes stand in one regular expression, an alternative for each kind of candidate in class
order, so the engine itself takes the leftmost accepted candidate, decides ties by class and goes on
behind it. Guards are look-arounds within an alternative: a candidate that they reject is no match,
and a later class or start is tried. A URL scheme has at most 256 characters, which keeps the search linear. A match is first set between marks with its value
in its class's place; counting is counting marks, and a placeholder replaces them. A placeholder that
is already there is a class of its own, kept as it stands, so redacting twice changes nothing.

Groups that repeat are possessive, which Java runs without recursion, and a text is searched only if it
holds a literal that some class needs. Nulls stay null; lengths count characters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token prefixes with the shortest tail, and whether the tail is letters and digits only.
PREFIXES = [
    ("sk-ant-", 10, False), ("sk-", 10, False), ("sk_live_", 20, True), ("rk_live_", 20, True), ("xoxb-", 8, False), ("xoxp-", 8, False), ("xoxa-", 8, False),
    ("xoxr-", 8, False), ("xoxc-", 8, False), ("xoxs-", 8, False), ("xapp-", 8, False), ("ghp_", 20, False), ("gho_", 20, False), ("ghs_", 20, False),
    ("ghu_", 20, False), ("ghr_", 20, False), ("github_pat_", 20, False), ("glpat-", 20, False), ("npm_", 36, True), ("hf_", 30, True), ("gsk_", 40, True),
    ("xai-", 40, True), ("dop_v1_", 40, True), ("shpat_", 32, True), ("shpss_", 32, True), ("AIza", 30, False),
]
# Keys whose values are secrets, and words that make a blob one.
KEYS = "password|passwd|secret|api_key|apikey|api-key|access_token|secret_key|client_secret|auth_token|token"
HINTS = ["secret", "token", "password", "passwd", "api_key", "apikey", "key", "credential", "auth"]
# Class of a candidate and what its placeholder says.
LABELS = {"private_key": "private_key", "assignment": "secret", "api_key": "api_key", "jwt": "jwt", "email": "email", "blob": "secret"}

TOKEN, LOCAL, RUN = "A-Za-z0-9_-", "A-Za-z0-9._%+-", "A-Za-z0-9+/=_-"
HINT_WINDOW = 48
KEPT = "kept"  # the class of placeholders that are there already
#: marks about a match, between its classes, and before what a text has of these four itself
OPEN, NEXT, CLOSE, QUOTE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"
_SIGNS = ((QUOTE, "~"), (OPEN, "^"), (NEXT, "&"), (CLOSE, "`"))


def _prefixes() -> str:
    """A prefix of another one never stands for it."""
    names = [p for p, _, _ in PREFIXES]
    found = []
    for name, least, pure in PREFIXES:
        longer = "".join(f"(?!{n.removeprefix(name)})" for n in names if n != name and n.startswith(name))
        found.append(f"{name}{longer}[{'A-Za-z0-9' if pure else TOKEN}]{{{least},}}")
    return "|".join(found)


def _hinted() -> str:
    return "(?<=" + "|".join(f"(?is:{h}.{{0,{HINT_WINDOW - len(h)}}})" for h in HINTS) + ")"


def candidates() -> list[tuple[str, str, str, str]]:
    """(class, guard before, what is kept, value) of each kind of candidate in the order that decides ties."""
    token, fresh = rf"(?<![{TOKEN}])", r"(?!\[REDACTED:)"
    header = "[A-Z0-9 ]{0,80}"
    body = (
        r"(?:[\r\n]++[^ \r\n:]{1,40}: [^\r\n]{0,60})*+(?:[\r\n]++[ \t]*+[A-Za-z0-9+/=]{16,}+[ \t]*+(?=[\r\n]|\z))++"
        r"(?:[\r\n]++[ \t]*+[A-Za-z0-9+/=]{1,15}+[ \t]*+(?=[\r\n]|\z))?+"
    )
    bare = r"(?![A-Za-z]{1,7}(?:[ \t\r\n,;)]|\z))(?![^ \t\r\n,;)]*\()[^ \t\r\n,;)]{3,}"
    return [
        (KEPT, "", "", r"\[REDACTED:[^\]]*\]"),
        ("private_key", "", "", rf"-----BEGIN {header}PRIVATE KEY{header}-----(?:(?s:.*?)-----END {header}PRIVATE KEY{header}-----|{body})"),
        (
            "assignment", token, rf"(?i:{KEYS})[ \t]*[=:][ \t]*(?:\"(?=[^\"]{{3,}}\")|'(?=[^']{{3,}}')|(?![\"']))",
            rf"{fresh}(?:(?<=\")[^\"]++|(?<=')[^']++|(?<![\"']){bare})",
        ),
        ("assignment", token, r"[A-Za-z][A-Za-z0-9+.-]{0,255}+://[^:@/ \t\r\n\"']*+:", rf"{fresh}[^$@/ \t\r\n\"'][^@/ \t\r\n\"']*+(?=@)"),
        ("api_key", "(?<![A-Za-z0-9_])", r"(?i:authorization):[ \t]*+", rf"{fresh}[^ \t\r\n][^\r\n]*+"),
        ("api_key", token, "", r"(?i:bearer) ++(?:(?=[A-Za-z0-9_.-]{16})|(?=[A-Za-z]*+[0-9_.-]))[A-Za-z0-9_.-]{8,}+"),
        ("api_key", token, "", rf"AKIA[A-Z0-9]{{16,}}+|{_prefixes()}"),
        ("jwt", token, "", rf"(?=eyJ[.{TOKEN}]{{37}})eyJ[{TOKEN}]++\.[{TOKEN}]{{4,}}+\.[{TOKEN}]{{4,}}+"),
        ("email", rf"(?<![{LOCAL}])", "", rf"[{LOCAL}]++@[A-Za-z0-9.-]*?\.[A-Za-z]{{2,}}+(?=\.*+(?![A-Za-z0-9.-]))"),
        ("blob", rf"{token}(?=[{RUN}]{{32}}){_hinted()}", "", rf"(?:[0-9a-fA-F]{{32,}}+(?![{RUN}])|[{TOKEN}]{{40,}}+(?![{RUN}])|[A-Za-z0-9+/=]{{40,}}+(?![{RUN}]))"),
    ]


#: what a text needs one of before a class is looked for, as it stands or in lower case; each is part of every match or of its hint
LITERALS = {
    "private_key": ["PRIVATE KEY"], "assignment": ["=", ":"], "api_key": ["AKIA", *dict.fromkeys(p[:3] for p, _, _ in PREFIXES)], "jwt": ["eyJ"], "email": ["@"], "blob": [],
}
LOWER_LITERALS = {"api_key": ["authorization", "bearer"], "blob": HINTS}


def pattern(classes: list[str]) -> tuple[str, str]:
    """The expression of ``classes`` and the replacement that sets a match between marks."""
    order = [KEPT, *classes]
    parts, values, kept = [], {c: "" for c in order}, ""
    for i, (kind, guard, keep, value) in enumerate(candidates()):
        if kind not in order:
            continue
        parts.append(f"{guard}{f'(?<k{i}>{keep})' if keep else ''}(?<v{i}>{value})")
        values[kind] += f"${{v{i}}}"
        kept += f"${{k{i}}}" if keep else ""
    return "|".join(parts), OPEN + kept + "".join(NEXT + v for v in values.values()) + CLOSE


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _classes(classes: list[str] | None) -> list[str]:
    return [c for c in LABELS if classes is None or c in classes]


def marked(text: Column, classes: list[str] | None = None) -> Column:
    """``text`` with every redacted stretch between marks."""
    found = _classes(classes)
    expression, replacement = pattern(found)
    plain = dict.fromkeys(s for c in found for s in LITERALS[c])
    lower = dict.fromkeys(s for c in found for s in LOWER_LITERALS.get(c, []))

    def search(held: Column) -> Column:
        x = held["text"]
        own = x
        for mark, sign in _SIGNS:
            own = F.replace(own, F.lit(mark), F.lit(QUOTE + sign))
        base = F.when(x.rlike(f"[{OPEN}-{QUOTE}]"), own).otherwise(x)
        changed = F.regexp_replace(base, expression, replacement)
        wanted = F.lit(False)
        for where, literals in (("text", plain), ("lower", lower)):
            for literal in literals:
                wanted = wanted | F.contains(held[where], F.lit(literal))
        return F.when(wanted, changed).otherwise(base)

    text = F.struct(text.alias("text"), (F.lower(text) if lower else F.lit(None).cast("string")).alias("lower"))
    return _once(text, search)


def unmarked(text: Column, classes: list[str] | None = None) -> Column:
    """``marked`` text with placeholders for its marked stretches."""
    order = [KEPT, *_classes(classes)]

    def place(x: Column) -> Column:
        done = x
        for i, kind in enumerate(order):
            said = "$2" if kind == KEPT else f"[REDACTED:{LABELS[kind]}]"
            done = F.regexp_replace(done, f"{OPEN}([^{NEXT}]*+){NEXT}{{{i + 1}}}([^{NEXT}{CLOSE}]++){NEXT}{{{len(order) - 1 - i}}}{CLOSE}", f"$1{said}")
        own = done
        for mark, sign in reversed(_SIGNS):
            own = F.replace(own, F.lit(QUOTE + sign), F.lit(mark))
        return F.when(x.rlike(f"[{OPEN}{QUOTE}]"), own).otherwise(x)

    return _once(text, place)


def redact(text: Column, classes: list[str] | None = None) -> Column:
    """``text`` with a placeholder for each secret of ``classes``, all of them by default."""
    return unmarked(marked(text, classes), classes)


def counts(found: Column, classes: list[str] | None = None) -> dict[str, Column]:
    """How many stretches of each class a ``marked`` text has."""
    order = [KEPT, *_classes(classes)]
    return {
        kind: F.coalesce(F.regexp_count(found, F.lit(f"{OPEN}[^{NEXT}]*+{NEXT}{{{i + 1}}}[^{NEXT}{CLOSE}]")), F.lit(0)).cast("long")
        for i, kind in enumerate(order)
        if kind != KEPT
    }


_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d{1,2})"
#: 10/8, 172.16/12, 192.168/16 and 100.64/10, an octet with or without leading zeros
PRIVATE_V4 = rf"(?:0?10\.{_OCTET}|172\.0?(?:1[6-9]|2\d|3[01])|192\.168|100\.(?:0?(?:6[4-9]|[7-9]\d)|1[01]\d|12[0-7]))\.{_OCTET}\.{_OCTET}"
# Domains of private networks, and public forges whose git user is nobody's.
PRIVATE_DOMAINS = r"local|internal|lan|corp|home\.arpa|ts\.net|localdomain"
FORGES = r"github\.com|gitlab\.com|bitbucket\.org|codeberg\.org"


def private_addresses(text: Column) -> Column:
    """Private IPv4 and unique or link-local IPv6 addresses go; versions and longer dotted numbers stay."""
    v4 = F.regexp_replace(text, rf"(?<![.vV])\b{PRIVATE_V4}\b(?!\.\d)", "[REDACTED:ip]")
    return F.regexp_replace(v4, r"(?i)\b(?:fd[0-9a-f]{2}|fc[0-9a-f]{2}|fe80):[0-9a-f:]{2,}\b", "[REDACTED:ip]")


def edged_private_v4(text: Column) -> Column:
    """Private IPv4 addresses go as engines without look-around find them: each takes a character of its edges along, so of two that share one the second stays."""
    gone = F.regexp_replace(text, rf"(^|[^.0-9A-Za-z_])(?:{PRIVATE_V4})(\.?\z|\.[^0-9]|[^.0-9A-Za-z_])", "$1[REDACTED:ip]$2")
    return F.when(text.rlike(PRIVATE_V4), gone).otherwise(text)  # the edge before an address is dear to search for


def private_names(text: Column) -> Column:
    """Host names in private domains go, but not those of addresses (user@host). A name has at most 126 labels."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.regexp_replace(text, rf"(?i)\b(?=[a-z0-9-]{{1,63}}\.)(?<!@[a-z0-9.-]{{0,253}})(?:{label}\.){{1,126}}(?:{PRIVATE_DOMAINS})\b", "[REDACTED:host]")


def ssh_targets(text: Column) -> Column:
    """user@host behind ssh:// or an ssh, scp, sftp or rsync command goes, the git user of public forges stays."""
    public = rf"(?!git@(?:{FORGES})(?![A-Za-z0-9._-]))"
    return F.regexp_replace(text, rf"(?i)((?:git\+)?ssh://|\b(?:ssh|scp|sftp|rsync)\s++(?:-[A-Za-z0-9]++\s++)*+){public}[A-Za-z0-9._-]++@[A-Za-z0-9._-]++", "$1[REDACTED:ssh]")


def scrub(text: Column, addresses: bool = True, names: bool = True, targets: bool = True) -> Column:
    """The scrub profile for hosts: ssh targets, then private addresses, then private names."""
    for wanted, step in ((targets, ssh_targets), (addresses, private_addresses), (names, private_names)):
        text = step(text) if wanted else text
    return text


def home_paths(text: Column, home: str = "$HOME") -> Column:
    """Home folders of any user, as ``home``."""
    found = r"(^|[^A-Za-z0-9._~/\\-]|file://)(?:/Users/|/home/|[A-Za-z]:\\Users\\)[^/\\\s\"'`<>|:;,(){}\[\]]+"
    return F.regexp_replace(text, found, "$1" + home.replace("\\", "\\\\").replace("$", "\\$"))
