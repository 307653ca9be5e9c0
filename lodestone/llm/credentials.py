"""Credentials in source code and documentation: found as byte ranges under key paths, and masked in place.

A text is read line by line as what it may be (assignments of program text, JSON, YAML with its nesting,
properties, environment files, XML, tables, command lines, URLs, PEM blocks, comments and prose). Each
reader gives key paths with the byte range of the literal value. The names on the path and the shape of
the value decide whether it is a live credential, and redaction splices a mask into the original bytes.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = "[REDACTED]"

#: Fixed words. A name is sensitive if it has one of SECRET, or `key` with one of KEY_KINDS before it or on its path,
#: and neither ends in one of ABOUT (it is then about a secret, not the secret) nor has one of PUBLIC.
SECRET = {"password", "passwd", "passphrase", "passwort", "pwd", "pass", "pw", "secret", "token", "bearer", "apikey", "credential", "credentials", "contraseña"}
KEY_KINDS = {"api", "svc", "service", "signing", "sign", "access", "private", "secret", "auth", "encryption", "master", "admin", "account", "storage", "deploy", "client", "shared", "ssh", "license"}
ABOUT = set(
    "name field label header hint placeholder prompt title url uri path file dir len length min max count policy mode type kind format regex pattern "
    "ttl expiry expires enabled required hash digest checksum ref env var class column index limit size id ids prefix suffix message text rule rules".split()
)
PUBLIC = {"public", "pub", "fingerprint"}
#: Fixed shapes of tokens that carry their issuer's prefix.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{50,}|glpat-[\w-]{18,}|[spr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9-]{16,}"
    r"|A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])|AIza[\w-]{30,}|npm_[A-Za-z0-9]{30,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{10,}\.eyJ[\w-]{8,}\.[\w-]{8,})"
)
#: Fixed shapes of addresses whose last part is a secret.
_HOOK = re.compile(r"https?://(?:hooks\.slack\.com/(?:services|workflows|triggers)/[A-Z0-9]+/[A-Z0-9]+/|(?:\w+\.)?discord(?:app)?\.com/api/webhooks/\d+/|api\.telegram\.org/bot\d+:|[\w.-]+\.webhook\.office\.com/[\w@/-]+/)(?P<value>[\w-]{16,})")
_DEAD = re.compile(
    r"\*{3}|x{6}|X{6}|^\W*$|^<.*>$|[$#]\{|\{\{|^\$|^%\w+%$|^@\w+@$|^[a-z]+://[^:@]*$|^(?:vault|ssm|env|file|op|secretsmanager|keychain|kms|sops|awskms|ref|arn):|^ENC[\[(]|ANSIBLE_VAULT|^sha(?:1|256|384|512)[:-]"
    r"|(?i:^(?:change[_-]?me|change[_-]?it|your[_-].*|my[_-]?(?:password|secret|token)|example.*|.*example|placeholder.*|dummy.*|redacted.*|.*redacted.*|todo.*|none|null|nil|true|false|undefined|secret|password|token|string|test)$)"
)
_LABEL = re.compile(r"[a-z]+(?:[ _.-][a-z]+)*|[A-Z]+(?:_[A-Z]+)*|(?:[A-Z][a-z]*)(?:-[A-Z][a-z]*)*|[a-z]+(?:[A-Z][a-z]+)+")
_NAME_PARTS = re.compile(r"[A-ZÀ-Þ]+(?![a-zà-ÿ])|[A-ZÀ-Þ]?[a-zà-ÿ]+|\d+")

_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
_ASSIGN = re.compile(rf"""(?P<key>[A-Za-z_$][\w$.-]*)["'\]]?\s*(?::=|=>|=(?!=)|:(?!:))\s*\(?\s*(?P<value>{_QUOTED})""")
_PIECE = re.compile(rf"[ \t]*\+?[ \t]*\n?[ \t]*\+?[ \t]*({_QUOTED})")
_BARE = re.compile(r"^(?P<indent>[ \t]*(?:-[ \t]+)?)(?:export[ \t]+)?(?P<key>[A-Za-z_][\w.-]*)[ \t]*(?P<sep>[:=])[ \t]*(?P<value>[^\s\"'`#][^\s]*)[ \t]*(?:#.*)?\r?$")
_YAML_PARENT = re.compile(r"^(?P<quote>[\"']?)(?P<key>[\w.-]+)(?P=quote)[ \t]*:(?:[ \t]+[&!]\S+)*[ \t]*(?:[ \t]#.*)?\r?$")
_YAML_LINE = re.compile(r"(?P<indent>[ \t]*(?:-[ \t]+)*)(?P<rest>.*)", re.S)
_FALLBACK = re.compile(rf"""(?:env(?:iron)?[.\[][\w"'\]]+|[Gg]etenv\([^)\n]*\)|environ\.get\([^)\n]*\))\s*(?:\|\||\?\?|or)\s*(?P<value>{_QUOTED})|(?:getenv|environ\.get)\(\s*(?:{_QUOTED})\s*,\s*(?P<second>{_QUOTED})""")
_XML = re.compile(r"<(?P<key>[A-Za-z][\w.-]*)(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[\s*)?(?P<value>[^<>\s\]]+)\s*(?:\]\]>)?\s*</(?P=key)>")
#: A name and its value given apart: as attributes, members or lines, in either order, or as an attribute and the element's text.
_NAMED = r"\b(?:name|key|id|Name|Key|Id)[\"']?\s*[:=]\s*(?P<q>[\"']?)(?P<key>[A-Za-z][\w.:-]*)(?P=q)"
_VALUED = r"[\"']?\b(?:value|val|Value|Val)[\"']?\s*[:=]\s*"
_PAIRS = [
    re.compile(rf"""{_NAMED}\s*,?\s*{_VALUED}(?P<value>{_QUOTED}|[^\s"'`,;<>{{}}\[\]]+)"""),
    re.compile(rf"""{_VALUED}(?P<value>{_QUOTED})\s*,?\s*["']?{_NAMED}"""),
    re.compile(rf"""<\w[^<>]*{_NAMED}[^<>]*(?<!/)>\s*(?P<value>[^<>\s]+)\s*</"""),
]
_VAL = re.compile(r"\b[Vv]al(?:ue)?\b")
#: What may hold values under its name: a YAML key without a value of its own (or with a block), a list, a member with a `value`, a multi-line string, a here-document.
_HOLDER = re.compile(r"^(?P<indent>[ \t]*(?:-[ \t]+)*)[\"']?(?P<key>[\w.-]+)[\"']?[ \t]*:[ \t]*(?P<block>[|>][+-]?\d?)?[ \t]*(?:#.*)?\r?$")
_LIST = re.compile(r"(?P<key>[A-Za-z_][\w.-]*)[\"']?\s*(?::=|[:=])\s*(?:\[\](?:string|byte))?[\[{(](?P<inner>(?:\s*(?:\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)\s*,?)+)\s*[\])}]")
_LIST_HEAD = re.compile(r"(?P<key>[A-Za-z_][\w.-]*)[\"']?\s*(?::=|[:=])\s*(?:\[\](?:string|byte))?[\[{(]")
_MEMBER = re.compile(rf"""(?P<key>[A-Za-z_][\w.-]*)["']?\s*(?::=|[:=])\s*{{[^{{}}]*?{_VALUED}(?P<value>{_QUOTED})""")
_LONG = re.compile(r"(?P<key>[A-Za-z_][\w.-]*)[ \t]*=[ \t]*(?P<q>\"{3}|'{3})\s*(?P<value>[^\s\"']+)\s*(?P=q)|(?P<name>[A-Za-z_]\w*)=[\"']?\$\(cat <<-?[ \t]*[\"']?(?P<end>\w+)[\"']?[ \t]*\n[ \t]*(?P<held>\S+)[ \t]*\n[ \t]*(?P=end)\b")
_ITEM = re.compile(r"^[ \t]*-[ \t]+(?P<q>[\"']?)(?P<value>[^\s\"'#]+)(?P=q)[ \t]*(?:#.*)?\r?$")
_CHILD = re.compile(r"^[ \t]*[\"']?(?:value|val)[\"']?[ \t]*[:=][ \t]*(?P<q>[\"']?)(?P<value>[^\s\"'#]+)(?P=q)[ \t]*,?[ \t]*(?:[#;].*)?\r?$")
_FIELD = re.compile(r"(?:^|[;,\"'`\s])(?P<key>[A-Za-z][A-Za-z_]*(?: [A-Za-z]+)?)[ ]?=[ ]?(?P<value>[^;\"'`\s]+)(?=[;\"'`\s]|$)")
_FIELDS = re.compile(r"[A-Za-z][\w ]*=[^;\"'`\s]*(?:;[ ]?[A-Za-z][\w ]*=[^;\"'`\s]*)+")
_FLOW = re.compile(r"[{,]\s*(?P<key>[A-Za-z_][\w.-]*)\s*:\s+(?P<value>[^\s,{}\[\]\"'`]+)\s*(?=[,}])")
_ENV = re.compile(r"^[ \t]*(?:ENV|ARG|setx|SETENV|setenv)[ \t]+(?P<key>\w+)[ \t]+(?P<value>[^\s\"'=]+)[ \t]*\r?$")
_BEHIND = re.compile(r"(?<=\s)(?://|#|--)\s+(?P<text>\S.*?)\s*$")
_ROW = re.compile(r"^\s*\|\s*`?(?P<key>[A-Za-z_][\w.-]*)`?\s*\|\s*`?(?P<value>[^\s|`]+)`?\s*\|")
_URL = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]*://[^\s:/@\"'`]*:(?P<value>[^\s/@\"'`]+)@[\w.\[-]")
_AUTH = re.compile(r"(?i)authorization[\"']?\s*[:,=]\s*[\"'`]?\s*(?P<kind>bearer|token|basic)\s+(?P<value>[^\s\"'`]+)")
_USER = re.compile(r"\bcurl\b[^\n]*?\s(?:-u|--user)[ =]?[\"']?[^\s:\"']+:(?P<value>[^\s\"'`]+)")
_FLAG = re.compile(r"(?:^|\s)--(?P<key>[A-Za-z][\w-]*)[ =][\"']?(?P<value>[^\s\"'`]+)")
_SHORT = re.compile(r"\b(?:mysql|mysqldump|mariadb)\b[^\n]*?\s-p(?P<value>[^\s\"'`]+)")
_NETRC = re.compile(r"\blogin\s+\S+\s+password\s+(?P<value>\S+)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(?:(?:\\[nr]|[\s\"'+,>#*/|])*[A-Za-z0-9+/=]{16,})(?:(?:\\[nr]|[\s\"'+,])*(?<![A-Za-z0-9])[A-Za-z0-9+/=]{16,})*(?:(?:\\[nr]|[ \t\r\n])[A-Za-z0-9+/]{1,15}={0,2}(?=\s|\\[nr]|$))?")
_SECRET_DOC = re.compile(r"^kind:[ \t]*Secret[ \t]*\r?$", re.M)
_COMMENT = re.compile(r"^\s*(?://+|#+|--|\*|/\*|<!--)\s*(?P<text>.*?)\s*(?:\*/|-->)?\r?$")
_SPOKEN = re.compile(r"(?i)\b(?:passwor[dt]s?|passwd|passphrase|pwd|contrase[ñn]a|clave|credentials?|log ?in|logs? in|old key|api key|secret|token|zugangsdaten|kennwort|schlüssel)\b|密码|口令|密钥")
_DIGEST = re.compile(r"(?i)\b(?:sha-?\d*|md5|commit|digest|checksum|integrity|etag|revision|fingerprint|sourceMappingURL|pinned|hash|public|uuid|trace)\b")
_WORD = re.compile(r"[^\s\"'`,;:()<>\[\]{}|（），。；：、“”\u3400-\u9fff]+")
#: Words that a line needs, in small letters, for any reader to find something on it: name parts that make a name sensitive (each holds a word of
#: SECRET or `key`), words that _SPOKEN goes by, issuers' prefixes, and the marks of the other readers. Comments of code are read whatever they say.
_NAME_WORDS = sorted({w for w in SECRET if not any(o != w and o in w for o in SECRET)} | {"key"})
_TRIGGER = re.compile(
    "|".join(_NAME_WORDS)
    + "|contrasena|clave|logs? ?in|密码|口令|密钥|kennwort|zugangsdaten|schlüssel|authorization|gh[pousr]_|github_pat_|glpat-|k_(?:live|test)_|xox|a[ks]ia|aiza|npm_|sg\\.|eyj"
    + "|env(?:iron)?[.\\[]|getenv|://[^/\\s]*@|\\bcurl\\b|mysql|mariadb|hooks\\.slack|webhook|api\\.telegram"
)
#: A comment of code that ends in a word of letters and digits.
_TOLD = re.compile(r"(?m)^[ \t]*(?://+|#+|--|\*|/\*|<!--)[^\n]*?\s(?=[^\s\d]*\d)(?=[^\sA-Za-z]*[A-Za-z])[^\s/]{10,}[ \t]*(?:\*/|-->)?\r?$")
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)")
_SECTION = re.compile(r"^[ \t]*\[{1,2}[ \t]*(?P<name>[\w.\"' :-]+?)[ \t]*\]{1,2}[ \t]*(?:[#;].*)?\r?$")
_BRACES = re.compile(rf"""(?:"(?P<quoted>[\w.-]+)"|'(?P<single>[\w.-]+)'|(?<![\w$.-])(?P<word>[A-Za-z_$][\w$.-]*))\s*(?::=|=>|=|:)\s*(?P<open>[{{\[])|{_QUOTED}|(?P<bare>[{{\[])|(?P<close>[}}\]])|(?m:^[ \t]*(?P<fence>```|~~~))""")
_TAGS = re.compile(r"<(?P<end>/)?(?P<name>[A-Za-z][\w.-]*)(?:\s[^<>]*?)?(?P<alone>/)?>")


@dataclass(frozen=True)
class Finding:
    path: str
    begin: int  # in code points while reading, in bytes once given out
    end: int
    line: int


def sensitive(path: str) -> str:
    """"strong", "weak" (a bare `key`) or "" for a key path."""
    names = path.split(".")
    parts = [p.lower() for p in _NAME_PARTS.findall(names[-1])]
    if parts in (["value"], ["val"]) and names[:-1]:
        return "strong" if holds(names[-2]) else ""
    if not parts or parts[-1] in ABOUT or PUBLIC & set(parts):
        return ""
    if SECRET & set(parts) or "".join(parts[-2:]) in ("apikey", "authtoken"):
        return "strong"
    if "key" in parts:
        before = set(parts[: parts.index("key")]) | {p.lower() for n in names[:-1] for p in _NAME_PARTS.findall(n)}
        if before & (KEY_KINDS | SECRET):
            return "strong"
        return "weak" if parts == ["key"] else ""
    return ""


def holds(name: str) -> bool:
    """Whether what is listed under the name is sensitive: a strong name or the plural of one."""
    return sensitive(name) == "strong" or name.lower().endswith("s") and sensitive(name[:-1]) == "strong"


def told(value: str) -> bool:
    """Whether a word has the shape of a generated or chosen password by itself: letters and digits in turns, or with a sign among them."""
    if not live(value, "word") or len(value) < 10 or re.search(r"[/=:\\]|\.\w+$|^\W", value):
        return False
    runs = re.findall(r"[A-Za-z]+|\d+", value)
    return len(runs) >= 5 or len(runs) >= 2 and bool(re.search(r"[!#$%^&*+?@~]", value))


def phrase(value: str, name: str) -> bool:
    """Whether a value of several words is a passphrase: under a name that says so, of four words, or of three with a digit under any password's name."""
    words = value.split(" ")
    if len(words) < 3 or not all(re.fullmatch(r"[\w'!#$%&*+@-]{2,}", w) for w in words) or _DEAD.search(value):
        return False
    parts = {p.lower() for p in _NAME_PARTS.findall(name.split(".")[-1])}
    digit = any(c.isdigit() for c in value)
    return "passphrase" in parts and (digit or len(words) >= 4) or bool(parts & {"password", "passwd", "pwd"}) and digit


def live(value: str, strength: str = "strong") -> bool:
    """Whether the value's shape is that of a literal credential and of no placeholder, reference, label or ciphertext."""
    if ISSUED.match(value):
        return not _DEAD.search(value)
    if len(value) < 6 or _DEAD.search(value) or re.search(r"[\s(){}<>]", value):
        return False
    if _LABEL.fullmatch(value):
        return False
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    if strength == "strong":
        return letters >= 2 and (digits > 0 or len(value) >= 8)
    if re.fullmatch(r"[a-z]+(?:_[a-z0-9]+)*|[A-Za-z]+[-_]\d+[a-z]?|v?\d+(?:[.:/-]\d+)*[a-z]?|[0-9a-f]{40}|[\w./-]*\.(?:md|go|py|js|ts|json|ya?ml|map|tar|gz|html?|svg|png)", value):
        return False
    return len(value) >= 8 and letters >= 2 and digits >= 1 and "/" not in value[:2] and "://" not in value and (strength != "weak" or len(value) >= 16)


def _decoded(value: str) -> str | None:
    try:
        return base64.b64decode(value, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return None


def _unquote(literal: str) -> str:
    return literal[1:-1]


class _Nesting:
    """What the places of a text are nested in, read once from its start: braces (JSON and program text), indents (YAML), sections (TOML, INI) and elements (XML)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.lines = self._lines()
        self.braces = self._braces()
        self.tags: tuple[list[int], list[tuple]] | None = None

    def _lines(self) -> dict[int, tuple[str, list[tuple[int, str]]]]:
        """By a line's start its section and the YAML keys, with their indents, that are open before it."""
        out: dict[int, tuple[str, list[tuple[int, str]]]] = {}
        section, stack, at = "", [], 0
        for line in self.text.split("\n"):
            out[at] = (section, stack)
            at += len(line) + 1
            if not line.strip() or line.lstrip().startswith("#"):
                continue
            if _FENCE.match(line):
                section, stack = "", []
                continue
            m = _YAML_LINE.match(line)
            indent = len(m["indent"])
            if stack and stack[-1][0] >= indent:
                stack = [x for x in stack if x[0] < indent]
            if s := _SECTION.match(line):
                section = re.sub(r"[\"' :]+", ".", s["name"]).strip(".")
            elif k := _YAML_PARENT.match(m["rest"]):
                stack = [*stack, (indent, k["key"])]
        return out

    def _braces(self) -> tuple[list[int], list[tuple]]:
        """Ascending offsets, and the names whose braces are open from each on, as (names before, name)."""
        at, open_, now = [], [], ()
        for m in _BRACES.finditer(self.text):
            if m["open"] or m["bare"]:
                now = (now, m["quoted"] or m["single"] or m["word"] or "")
            elif m["close"]:
                now = now[0] if now else now
            elif m["fence"]:
                now = ()
            else:
                continue
            at.append(m.end())
            open_.append(now)
        return at, open_

    def _tags(self) -> tuple[list[int], list[tuple]]:
        at, open_, now, depth = [], [], (), Counter()
        for m in _TAGS.finditer(self.text):
            if m["alone"]:
                continue
            if not m["end"]:
                now = (now, m["name"])
                depth[m["name"]] += 1
            elif depth[m["name"]]:
                while now[1] != m["name"]:
                    depth[now[1]] -= 1
                    now = now[0]
                depth[now[1]] -= 1
                now = now[0]
            at.append(m.end())
            open_.append(now)
        return at, open_

    @staticmethod
    def _names(index: tuple[list[int], list[tuple]], place: int) -> str:
        i, names = bisect_right(index[0], place) - 1, []
        now = index[1][i] if i >= 0 else ()
        while now:
            if now[1]:
                names.append(now[1])
            now = now[0]
        return "".join(f"{n}." for n in reversed(names))

    def parents(self, begin: int, place: int, indent: int) -> str:
        """Key path, with a dot behind each name, of what is at `place` on the line that starts at `begin`."""
        section, stack = self.lines[begin]
        inner = self._names(self.braces, place) or "".join(f"{k}." for i, k in stack if i < indent)
        return (f"{section}." if section else "") + inner

    def elements(self, place: int) -> str:
        if self.tags is None:
            self.tags = self._tags()
        return self._names(self.tags, place)


class _Reader:
    def __init__(self, text: str, code: bool) -> None:
        self.text, self.code = text, code
        self.found: dict[int, tuple[int, str]] = {}
        self.nested: _Nesting | None = None
        self.wide: dict[re.Pattern, list[re.Match]] = {}
        self.values: bool | None = None

    def _may(self, pattern: re.Pattern) -> bool:
        """Whether the text holds what the pattern can't match without."""
        if pattern in (_XML, _PAIRS[2]):
            return "</" in self.text
        if pattern is _LONG:
            return '"""' in self.text or "'''" in self.text or "$(cat" in self.text
        if self.values is None:
            self.values = bool(_VAL.search(self.text))
        return self.values

    def _begun(self, pattern: re.Pattern, begin: int, line: str) -> list[re.Match]:
        """Matches, perhaps over several lines, of the pattern that begin on the line; a text is searched once."""
        if pattern not in self.wide:
            self.wide[pattern] = list(pattern.finditer(self.text)) if self._may(pattern) else []
        found = self.wide[pattern]
        if not found:
            return []
        low, high = bisect_left(found, begin, key=re.Match.start), bisect_right(found, begin + len(line), key=re.Match.start)
        return found[low:high]

    def add(self, path: str, begin: int, end: int) -> None:
        if begin not in self.found or self.found[begin][0] < end:
            self.found[begin] = (end, path)

    def read(self) -> dict[int, tuple[int, str]]:
        text = self.text
        for m in _PEM.finditer(text):
            end, other = text.find("-----END ", m.end()), text.find("-----BEGIN ", m.end())
            closed = end >= 0 and not 0 <= other < end
            stop = text.find("-----", end + 9) + 5 if closed else 0
            self.add("private key", m.start(), stop if stop > 5 else m.end())  # a block without an end goes as far as its code does
        pem = [(b, e) for b, (e, _) in self.found.items()]
        secrets = self._secret_documents() if "kind: Secret" in text else []
        for hit in self._lines():
            begin, line = hit
            if any(b < begin < e for b, e in pem) or any(b <= begin < e for b, e in secrets):
                continue
            self._line(begin, line)
        if self.code:
            for m in _TOLD.finditer(text):
                begin = m.start() + len(m[0]) - len(m[0].lstrip())
                inside = any(b < begin < e for b, e in pem)
                if not inside and not any(m.start() <= b < m.end() for b in self.found) and not _DIGEST.search(m[0]):
                    last = list(_WORD.finditer(m[0]))[-1]
                    value = last[0].rstrip(".,!?") if last[0][-1] in ".," else last[0]
                    if told(value):
                        self.add("prose", m.start() + last.start(), m.start() + last.start() + len(value))
        return self.found

    def _below(self, begin: int, line: str) -> Iterator[tuple[int, str]]:
        """The lines after this one, with their offsets."""
        at = begin + len(line) + 1
        while at < len(self.text):
            end = self.text.find("\n", at)
            end = len(self.text) if end < 0 else end
            yield at, self.text[at:end]
            at = end + 1

    def _held(self, begin: int, line: str) -> None:
        """What stands under a sensitive name on this line: items, blocks, members and multi-line strings."""
        strength = "word" if self.code else "strong"
        if (m := _HOLDER.match(line)) and holds(m["key"]):
            indent, name = len(m["indent"]), m["key"]
            for at, below in self._below(begin, line):
                bare = below.strip()
                if not bare:
                    continue
                deep = len(below) - len(below.lstrip())
                if deep < indent or deep == indent and (m["block"] or not bare.startswith("- ")) or _FENCE.match(below):
                    break
                if m["block"]:
                    if live(bare, "strong"):
                        self.add(name, at + deep, at + deep + len(bare))
                elif (x := _ITEM.match(below) or _CHILD.match(below)) and live(x["value"], "word"):
                    self.add(name, at + x.start("value"), at + x.end("value"))
        elif (m := _SECTION.match(line)) and holds(m["name"].split(".")[-1]):
            for at, below in self._below(begin, line):
                if _SECTION.match(below) or _FENCE.match(below):
                    break
                if (x := _CHILD.match(below)) and live(x["value"], "strong"):
                    self.add(f"{m['name']}.value", at + x.start("value"), at + x.end("value"))
        for head in _LIST_HEAD.finditer(line):
            m = _LIST.match(self.text, begin + head.start()) if holds(head["key"]) else None
            if m:
                for x in re.finditer(_QUOTED, m["inner"]):
                    if live(_unquote(x[0]), "word"):
                        self.add(m["key"], m.start("inner") + x.start() + 1, m.start("inner") + x.end() - 1)
        for m in self._begun(_MEMBER, begin, line):
            if holds(m["key"]) and live(_unquote(m["value"]), strength):
                self.add(f"{m['key']}.value", m.start("value") + 1, m.end("value") - 1)
        for m in self._begun(_LONG, begin, line):
            key, part = (m["key"], "value") if m["key"] else (m["name"], "held")
            if sensitive(key) == "strong" and live(m[part], "strong"):
                self.add(key, m.start(part), m.end(part))

    def _apart(self, begin: int, line: str) -> None:
        """Values whose sensitive name is given as another attribute, member or line next to them."""
        for pattern in _PAIRS:
            for m in self._begun(pattern, begin, line):
                quoted = m["value"][0] in "\"'`"
                value = _unquote(m["value"]) if quoted else m["value"]
                if sensitive(m["key"]) == "strong" and live(value, "word" if self.code else "strong"):
                    self.add(m["key"], m.start("value") + quoted, m.end("value") - quoted)

    def _fields(self, begin: int, line: str) -> None:
        """Values in connection strings: fields with semicolons between them, in a literal or in plain text."""
        for area in [*(re.finditer(_QUOTED, line) if self.code else ()), *_FIELDS.finditer(line)]:
            if ";" not in area[0]:
                continue
            quoted = area[0][0] in "\"'`"
            for m in _FIELD.finditer(area[0]):
                if self.code and not quoted and re.fullmatch(r"[A-Za-z_$][\w$.]*", m["value"]):
                    continue  # statements
                if sensitive(m["key"].replace(" ", "_")) == "strong" and live(m["value"]):
                    self.add(m["key"], begin + area.start() + m.start("value"), begin + area.start() + m.end("value"))

    def _lines(self) -> Iterator[tuple[int, str]]:
        """Lines with a trigger."""
        text, low, done = self.text, self.text.replace("\u0130", "i").lower(), -1  # the one capital whose small form is longer
        for m in _TRIGGER.finditer(low):
            if m.start() < done:
                continue
            begin = text.rfind("\n", 0, m.start()) + 1
            end = text.find("\n", m.start())
            done = len(text) if end < 0 else end
            yield begin, text[begin:done]

    def _secret_documents(self) -> list[tuple[int, int]]:
        """Values under data (base64) and stringData (plain) of Secret manifests."""
        areas = []
        for m in _SECRET_DOC.finditer(self.text):
            part, at, area = None, m.end() + 1, m.end()
            for line in self.text[at:].split("\n"):
                bare = line.rstrip()
                if not bare or bare == "---" or bare.startswith("```"):
                    break
                if not line.startswith((" ", "\t")):
                    part = bare.rstrip(":")
                elif part in ("data", "stringData") and (v := re.match(r"\s+([\w.-]+):\s*([\"']?)([^\s\"']+)", line)):
                    plain = _decoded(v[3]) if part == "data" else v[3]
                    if plain is not None and not plain.startswith("-----BEGIN CERT") and not _DEAD.search(plain) and v[1].lower() not in ("user", "username", "host", "ca.crt", "tls.crt", "name"):
                        self.add(f"{part}.{v[1]}", at + v.start(3), at + v.end(3))
                at += len(line) + 1
                area = at
            areas.append((m.start(), area))
        return areas

    def _nesting(self) -> _Nesting:
        self.nested = self.nested or _Nesting(self.text)
        return self.nested

    def _line(self, begin: int, line: str) -> None:
        text, hidden = self.text, False
        for m in ISSUED.finditer(line):
            if not _DEAD.search(line[m.start() : m.end() + 8].split('"')[0].split("'")[0]):
                self.add("token", begin + m.start(), begin + m.end())
        for m in _HOOK.finditer(line):
            self.add("webhook", begin + m.start("value"), begin + m.end("value"))
        for m in _URL.finditer(line):
            if live(m["value"], "url") or len(m["value"]) >= 6 and not _DEAD.search(m["value"]) and not re.search(r"[${}<>]", m["value"]):
                self.add("url", begin + m.start("value"), begin + m.end("value"))
        for m in _AUTH.finditer(line):
            value = m["value"]
            if m["kind"].lower() == "basic":
                plain = _decoded(value)
                good = plain is not None and ":" in plain and not _DEAD.search(plain.split(":", 1)[1])
            else:
                good = live(value)
            if good:
                self.add("authorization", begin + m.start("value"), begin + m.end("value"))
        for pattern in (_USER, _SHORT, _NETRC):
            for m in pattern.finditer(line):
                if live(m["value"]):
                    self.add("command", begin + m.start("value"), begin + m.end("value"))
        for m in _FLAG.finditer(line):
            if sensitive(m["key"].replace("-", "_")) == "strong" and live(m["value"]):
                self.add(m["key"], begin + m.start("value"), begin + m.end("value"))
        for m in _ASSIGN.finditer(text, begin, min(len(text), begin + len(line) + 1)):
            strength = sensitive(m["key"])
            if not strength:
                continue
            name = self._nesting().parents(begin, m.start(), len(line) - len(line.lstrip())) + m["key"]
            strength = sensitive(name)
            value, end = _unquote(m["value"]), m.end("value")
            hidden = hidden or bool(_DEAD.search(value))
            while piece := _PIECE.match(text, end):
                if not piece[0].strip().startswith("+") and "\n" not in piece[0]:
                    break
                value, end = value + _unquote(piece[1]), piece.end()
            if live(value, strength) or phrase(value, name):
                self.add(name, m.start("value") + 1, end - 1)
        for m in _FALLBACK.finditer(line):
            part = "value" if m["value"] else "second"
            if live(_unquote(m[part]), "word"):
                self.add("fallback", begin + m.start(part) + 1, begin + m.end(part) - 1)
        for m in self._begun(_XML, begin, line) if "<" in line else ():
            if not sensitive(m["key"]):
                continue
            name = self._nesting().elements(m.start()) + m["key"]
            if live(m["value"], sensitive(name)):
                self.add(name, m.start("value"), m.end("value"))
        self._held(begin, line)
        self._apart(begin, line)
        if ";" in line and "=" in line:
            self._fields(begin, line)
        if m := _ENV.match(line):
            if sensitive(m["key"]) == "strong" and live(m["value"]):
                self.add(m["key"], begin + m.start("value"), begin + m.end("value"))
        for m in _FLOW.finditer(line) if not self.code and "{" in line else ():
            if sensitive(m["key"]) == "strong" and live(m["value"]):
                self.add(m["key"], begin + m.start("value"), begin + m.end("value"))
        if m := _ROW.match(line):
            if sensitive(m["key"]) == "strong" and live(m["value"]):
                self.add(m["key"], begin + m.start("value"), begin + m.end("value"))
        if m := _BARE.match(line):
            name = (self._nesting().parents(begin, begin + m.start("key"), len(m["indent"])) if sensitive(m["key"]) else "") + m["key"]
            if (strength := sensitive(name)) and live(m["value"].rstrip(",;"), strength) and not re.search(r"[()\[\]]|^(?!.*\w{24})\w+(?:\.\w+)+$", m["value"]):
                self.add(name, begin + m.start("value"), begin + m.start("value") + len(m["value"].rstrip(",;")))
        self._spoken(begin, line, hidden)

    def _spoken(self, begin: int, line: str, hidden: bool) -> None:
        """Values told in prose or comments: after each word for a secret the first word of a value's shape. Behind a placeholder such a word needs no telling."""
        taken = [(b - begin, self.found[b][0] - begin) for b in self.found if begin <= b < begin + len(line)]
        at = max((e for _, e in taken), default=0)
        if self.code and not _COMMENT.match(line):
            behind = _BEHIND.search(line)
            if not behind or line.count('"', 0, behind.start()) % 2 or line.count("'", 0, behind.start()) % 2:
                return
            at = max(at, behind.start("text"))
            if hidden and not _DIGEST.search(behind["text"]):
                for w in _WORD.finditer(line, at):
                    if told(w[0].rstrip(".,!?")):
                        self.add("prose", begin + w.start(), begin + w.start() + len(w[0].rstrip(".,!?")))
        if _DIGEST.search(line):
            return
        while spoken := _SPOKEN.search(line, at):
            at = spoken.end()
            for w in _WORD.finditer(line, at):
                value = w[0].rstrip(".,!?") if w[0][-1:] in ".," else w[0]
                if live(value, "word") and not re.search(r"https?:|^\W|\.\w+\(|^[a-z]+-\d+$|^[A-Za-z_]\w*=[^=]", value):
                    self.add("prose", begin + w.start(), begin + w.start() + len(value))
                    at = w.end()
                    break
            else:
                return


def find_in_text(text: str | None, code: bool = False) -> list[Finding]:
    """Credentials of a text, ascending and not overlapping, with byte offsets (UTF-8) and lines from 1."""
    if not text:
        return []
    found = _Reader(text, code).read()
    out, at, line, done, size = [], 0, 1, 0, 0
    for begin in sorted(found):
        end, path = found[begin]
        if begin < done:
            continue
        size += len(text[at:begin].encode("utf-8", "surrogatepass"))
        line += text.count("\n", at, begin)
        width = len(text[begin:end].encode("utf-8", "surrogatepass"))
        out.append(Finding(path, size, size + width, line))
        line += text.count("\n", begin, end)
        size, at, done = size + width, end, end
    return out


def redact(text: str | None, findings: list[Finding]) -> str | None:
    """The text with each finding's bytes replaced by MASK; everything else is kept byte for byte. Null stays null."""
    if not findings or text is None:
        return text
    data, out, at = text.encode("utf-8", "surrogatepass"), [], 0
    for f in findings:
        out += [data[at : f.begin], MASK.encode()]
        at = f.end
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")


def texts(units: DataFrame, chunks: DataFrame) -> DataFrame:
    """rec_kind, rec_id, generation and text of both tables."""
    return units.select(F.lit("unit").alias("rec_kind"), F.col("id").alias("rec_id"), "generation", F.col("source").alias("text")).unionByName(
        chunks.select(F.lit("chunk").alias("rec_kind"), F.col("id").alias("rec_id"), "generation", F.col("content").alias("text"))
    )


def find_credentials(rows: DataFrame) -> DataFrame:
    """rec_kind, rec_id, generation, line_no, key_path, begin_byte, end_byte of every credential of every row.

    Null and empty texts have none; a null id or generation is kept; repeated rows give repeated findings.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (kind, key, generation, f.line, f.path, f.begin, f.end)
                for kind, key, generation, text in batch.itertuples(index=False, name=None)
                for f in find_in_text(text, kind == "unit")
            ]
            yield pd.DataFrame(out, columns=["rec_kind", "rec_id", "generation", "line_no", "key_path", "begin_byte", "end_byte"]).astype({"generation": "Int64"})

    schema = "rec_kind string, rec_id string, generation bigint, line_no bigint, key_path string, begin_byte bigint, end_byte bigint"
    return rows.where("text <> ''").select("rec_kind", "rec_id", "generation", "text").mapInPandas(run, schema)


def redact_credentials(rows: DataFrame) -> DataFrame:
    """rec_kind, rec_id, generation, text with every credential masked, and how many were. Every row gives one row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [find_in_text(t, k == "unit") for k, t in zip(batch["rec_kind"], batch["text"])]
            text = pd.Series([redact(t, f) for t, f in zip(batch["text"], found)], dtype=object)
            yield batch[["rec_kind", "rec_id"]].assign(generation=batch["generation"].astype("Int64"), text=text.to_numpy(), masked=[len(f) for f in found])

    return rows.select("rec_kind", "rec_id", "generation", "text").mapInPandas(run, "rec_kind string, rec_id string, generation bigint, text string, masked int")


def credential_lines(rows: DataFrame) -> DataFrame:
    """rec_kind, rec_id, generation, line_no: each line on which a credential begins, once."""
    return find_credentials(rows).select("rec_kind", "rec_id", "generation", "line_no").distinct()
