"""Credentials embedded in code, configuration and talk: where they stand, and the texts with only them replaced.

A keyword automaton finds the lines that may hold a credential; only these are searched, by issuer formats, by names that ask for a
credential with a literal beside them, and by the places that hold one (logins in addresses, headers, command lines, netrc,
registry logins, sentences). Structure is validated: tokens of issuers by alphabet and length, JSON Web Tokens by their decoded
header, key blocks by their body, base64 by what it decodes to. Placeholders, masks, references, hashes, ids and public keys are
none. Where an issuer's checksum is public it is compared and reported with the credential; it leaves none out, as a token that was
mistyped or cut is still to be hidden. Letters and digits of a credential are replaced by ones of their own alphabet and case, so
lengths, line ends and quoting stay, and what was replaced is no longer found.

Null and empty texts hold nothing; whole texts are searched and values of any length are found; repeated rows are searched one by one.
"""

from __future__ import annotations

import base64
import binascii
import re
import unicodedata
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a line must hold, in lower case, to be searched: whatever a pattern matches holds one of these (tested). Fixed values.
KEYWORDS = [
    "key", "token", "secret", "passw", "pass", "pwd", "pw", "credential", "bearer", "basic", "private key", "://", "akia", "asia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_",
    "glpat-", "glptt-", "gldt-", "glrt-", "shpat_", "shpca_", "shppa_", "shpss_", "dop_v1_", "doo_v1_", "dor_v1_", "ya29.", "gocspx-", "hvs.", "dapi", "dckr_", "rubygems_", "pmak-", "nrak-", "lin_api_", "whsec_", "xapp-", "sg.", "sk-", "sk_", "rk-", "rk_", "xox", "aiza", "eyj", "hf_", "npm_", "pypi-", "lgr", "auth", "contrase", "mot de passe", "kennwort", "login", "log in", "-p", "mysql", "here you go", "clave", "identified", "curl", "wget", "http",
]
_AUTOMATON = ahocorasick.Automaton()
for _word in KEYWORDS:
    _AUTOMATON.add_word(_word, _word)
_AUTOMATON.make_automaton()

#: Tokens whose form names their issuer: fixed values.
ISSUER_FORMS = {
    "github": r"gh[pousr]_[A-Za-z0-9]{30,}+|github_pat_\w{40,}+",
    "gitlab": r"gl(?:pat|ptt|dt|rt)-[\w-]{20,}+",
    "secret_key": r"(?:sk|rk)-(?:[a-z]{2,8}-)?[A-Za-z0-9]{32,}+|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{20,}+|whsec_[A-Za-z0-9+/]{32,}+",
    "slack": r"xox[abeoprs]-[A-Za-z0-9-]{20,}+|xapp-[0-9]-[A-Za-z0-9-]{20,}+",
    "hugging_face": r"hf_[A-Za-z0-9]{30,}+",
    "npm": r"npm_[A-Za-z0-9]{36,}+",
    "pypi": r"pypi-[\w-]{50,}+",
    "google": r"AIza[\w-]{35,}+|ya29\.[\w-]{20,}+|GOCSPX-[\w-]{28,}+",
    "aws": r"(?:AKIA|ASIA)[A-Z0-9]{16,}+",
    "ledger": r"lgr[._-][A-Za-z0-9]{28,}+",
    "sendgrid": r"SG\.[\w-]{20,}+\.[\w-]{40,}+",
    "shopify": r"shp(?:at|ca|pa|ss)_[A-Fa-f0-9]{32,}+",
    "digitalocean": r"do[opr]_v1_[a-f0-9]{64,}+",
    "age": r"AGE-SECRET-KEY-1[0-9A-Z]{58,}+",
    "vault": r"hvs\.[\w-]{24,}+",
    "databricks": r"dapi[a-f0-9]{32,}+",
    "docker": r"dckr_(?:pat|oat)_[\w-]{27,}+",
    "rubygems": r"rubygems_[a-f0-9]{48,}+",
    "postman": r"PMAK-[a-f0-9]{24}-[a-f0-9]{34,}+",
    "new_relic": r"NRAK-[A-Z0-9]{27,}+",
    "linear": r"lin_api_[A-Za-z0-9]{40,}+",
}
ISSUERS = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(f"(?P<{kind}>{form})" for kind, form in ISSUER_FORMS.items()) + ")")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{4,}+\.[A-Za-z0-9_-]{10,}+(?:\.[A-Za-z0-9_-]{10,}+){0,2}")
_JWT_PART = re.compile(r"[A-Za-z0-9_-]*+")
_KEY_BLOCK = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_GAP = re.compile(r"(?:\s|\\[nrt]|[\"'`,;>|#*()+/\\]|-(?!-))*+")
_KEY_HEAD = re.compile(r"[A-Z][\w-]*: [^\n\\\"']*")
_KEY_PART = re.compile(r"[A-Za-z0-9+/]++={0,2}|=[A-Za-z0-9+/]{4}")

_SENSITIVE = r"(?:(?:api|secret|encryption|private|access|signing|master|shared|account)[ _-]?key|secret|token|passw(?:or)?d|passphrase|(?<![a-z])pass|(?<=smtp)pass|pwd|(?<![a-z])pw|(?<=admin)pw|credentials?|_auth)"
_NAME = re.compile(rf"[A-Za-z0-9_.-]*?{_SENSITIVE}(?![A-Za-z0-9_-])", re.I)
_NAME_END = re.compile(rf"{_SENSITIVE}(?![A-Za-z0-9_-])", re.I)  # what stands before it in the name needs no search
_BETWEEN = re.compile(
    r"""\\?["'`]?\]?\s*(?:
        :\s*(?:&\s*)?(?:'static\s+)?(?:str|String|string|text|any|Secret\w*)\s*(?:\|\s*\w+\s*)?=(?![=>])\s*
        |(?::=|=>|===?|!==?|=|:|>|,|\|)\s*
        |\s+(?=["'])
        |\s+(?:is|was|are|ist|war|lautet|es|era|est|était|to|=)\s*[:=]?\s+
    )""",
    re.X | re.I,
)
_FALLBACK = re.compile(r"(?:(?:os\.environ\.get|(?:os\.)?getenv|env|ENV\.fetch)\([^,()\n]*,|[\w.]+(?:\([^()\n]*\)|\[[^\[\]\n]*\])?[ \t]*(?:\?\?|\|\||\bor\b|\?:))[ \t]*(?=[\"'`])")
_WRAP = re.compile(r"(?:(?:String::from|str|Secret(?:Str)?|SecretString::from|new\s+\w+|bytes|quote|trim|\w+)?\(\s*)?(?:[fFbBrRuU]{1,2}(?=[\"']))?")
_QUOTED = re.compile(r"""\\?(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\n\\]|\\(?!["'`]).)*)""")
_MORE = re.compile(r"""[ \t]*(?:[+\\.]?[ \t]*\r?\n[ \t]*\+?|[+.])[ \t]*[fbru]{0,2}(?P<q>["'])(?P<v>(?:(?!(?P=q))[^\n\\])*)(?P=q)(?!\s*(?::|=>?|,\s*["'][^"'\n]*["']\s*:))""")
_BESIDE = re.compile(r"""[ \t]++[fbru]{0,2}(?P<q>["'])(?P<v>(?:(?!(?P=q))[^\n\\])*)(?P=q)(?!\s*(?::|=>?))""")
_UNQUOTED = re.compile(r"[^\s\"'`,;<>(){}\[\]|&\\]++")
_FOLDED = re.compile(r":\s*[>|][+-]?[0-9]?[ \t]*\r?\n([ \t]+)(?P<v>[^\s]+)[ \t]*(?=\r?\n|\Z)")
_NEXT_LINE = re.compile(r"\\?[\"'`]?\]?\s*[:=]\s*\(?\s*\\?\r?\n[ \t]*(?=\\?[\"'`])")

_ADDRESS = re.compile(r"(?<=[A-Za-z0-9+.-])://[^/\s:@'\"<>]*+:")
_SCHEME = frozenset("0123456789+.-")
_ADDRESS_RUN = re.compile(r"[^\s@'\"<>]++")
_ADDRESS_MORE = re.compile(r"(?:@[^\s@'\"<>/?#]++)+(?=@[A-Za-z0-9\[])")
_HOST = re.compile(r"@(?=[A-Za-z0-9\[])")
_BASIC = re.compile(r"\bbasic\s+(?P<v>[A-Za-z0-9+/_-]{8,}={0,2})", re.I)
_BEARER = re.compile(r"\b(?:bearer|token)\s+(?P<v>[A-Za-z0-9._~+/-]{16,}={0,2})", re.I)
_LOGIN = re.compile(r"""["']?\bauths?["']?\s*[:=]\s*["'](?P<v>[A-Za-z0-9+/]{8,}={0,2})["']""")
_PLACES = [
    re.compile(r"\bidentified\s+(?:with\s+\S+\s+)?by\s+(?:password\s+)?(?P<q>['\"])(?P<v>[^'\"\n]+)(?P=q)", re.I),
    re.compile(r"https?://hooks\.[^\s/\"']+/(?P<v>(?:services|workflows|triggers)/[A-Za-z0-9]{6,}/[A-Za-z0-9/_-]{16,})"),
    re.compile(r"\blogin\s+\S+\s+password\s+(?P<v>[^\s'\"]+)", re.I),
    re.compile(r"\bauth\s*=\s*\(\s*([\"'])[^\"']*\1\s*,\s*(?P<q>[\"'])(?P<v>[^\"'\n]+)(?P=q)"),
    re.compile(r"\b[Uu]se\s+(?P<q>[`'\"]?)(?P<v>[^\s`'\"]+)(?P=q)\s+(?:as|for)\s+(?:the|my|our|your|a)\s[^\n.]{0,60}?" + _SENSITIVE, re.I),
    re.compile(r"\b(?:with|as)\s+\S+\s+and\s+(?P<q>[`'\"]?)(?P<v>[^\s`'\"]+)(?P=q)\s+as\s+(?:the|its|my)\s+[^\n.]{0,30}?" + _SENSITIVE, re.I),
    re.compile(r"\b(?:contraseña|clave|passwort|kennwort|mot de passe)\b[^\n.:]{0,30}?(?:\bes\b|\bist\b|\best\b|\blautet\b|:)\s+(?P<q>[`'\"]?)(?P<v>[^\s`'\"]+)(?P=q)", re.I),
]
#: Command words, what must follow them, and the option with the credential: each searched for behind the one before, at any distance.
_COMMANDS = [
    (re.compile(r"\b(?:docker|podman|helm|oc|az|npm)\b"), re.compile(r"\blogin\b"), re.compile(r"\s(?:-p|--password)[ =]\s*(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\b(?:mysql\w*|mariadb\w*|sshpass|mongo\w*)\b"), None, re.compile(r"\s-p\s*(?P<q>[\"']?)(?P<v>[^\s\"']+)(?P=q)")),
    (re.compile(r"\b(?:curl|wget|http)\b"), None, re.compile(r"\s(?:-u|--user)[ =]\s*(?P<q>[\"']?)[^\s:\"']+:(?P<v>[^\s\"']+)(?P=q)")),
]
_KEY_PAIR = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}[\"']?\s*[,:;]\s*[\"']?(?P<v>[A-Za-z0-9+/]{40})(?![A-Za-z0-9+/])")
_VARIABLE = re.compile(r"""\b(?:variable|param(?:eter)?|input)\s+["'](?P<name>[^"'\n]+)["']\s*\{""")
_DEFAULT = re.compile(r"""\bdefault\s*=\s*["'](?P<v>[^"'\n]+)["']""")
#: What stands before a value on a line of an environment file, such a value with the marks that end others, and what shows a list instead.
_ENV_NAME = re.compile(r"[ \t]*(?:(?:export|set|ENV)[ \t]+|-[ \t]+)?[A-Za-z_][\w.-]*=")
_ENV_REST = re.compile(r"[^\s\"'`$(){}\[\]]++(?=[ \t]*(?:\r?\n|\Z))")
_NEXT_NAME = re.compile(r"[,;&|][\w.%-]+=")
_ENV_ENTRY = re.compile(r"""\bname:\s*["']?(?P<name>[\w.-]+)["']?[ \t]*\r?\n[ \t]*value:[ \t]*(?P<q>["']?)(?P<v>[^\s"']+)(?P=q)[ \t]*(?=\r?\n|\Z)""")

#: What stands for a credential without being one: fixed values.
_PLACEHOLDER = re.compile(
    r"""(?:x{3,}|\*{3,}|\.{3,}|•{3,}|-{3,}|_{3,}|0{6,}|1234(?:5(?:6(?:7(?:89?)?)?)?)?0?|null|none|nil|true|false|undefined|todo|tbd|n/?a|unset|empty|dummy|example|sample|test|secret|password|passwd|changeme|change[_-]?(?:me|it|this)|
    redacted|removed|hidden|masked|replace[_-]?(?:me|this|with.*)|insert[_-].*|your[_-].*|my[_-](?:secret|token|password|api|key).*|(?:the|some|any)[_-].*|string|str|bytes|int|bool|number|boolean|text|required|optional|default|value|prompt)""",
    re.I | re.X,
)
_MARKED = re.compile(r"example|placeholder|redacted|changeme|replace[_-]?me", re.I)
_REFERENCE = re.compile(r"\$|\{\{|%\(|<[^>]*>?|[@:!&*%][A-Za-z_][A-Za-z_.]*\Z|vault[:/.]|(?:process|os|env|ENV|var|local|data|module|secrets?|config|settings|self|this|cfg|ctx|args|params|values|std|System|vault|kv|request|req|options|opts|input|props)(?:\.|::|\[|->)\w?")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_TURN = re.compile(r"[a-z](?=[A-Z])")
_LETTER = re.compile("[A-Za-z]")
_NO_WORD = re.compile(r"[^A-Za-z_.:]+")
_UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.I)


def _stand_in(c: str) -> str:
    """The letter or digit that stands for one of its alphabet and case; other characters stand for themselves. Lengths in bytes stay, too."""
    if c.isascii():
        return "x" if c.islower() else "X" if c.isupper() else "0" if c.isdigit() else c
    kind = unicodedata.category(c)
    if kind == "Nd":
        return chr(ord(c) - unicodedata.decimal(c))
    if kind[0] not in "LMN":
        return c
    return next(x for x in map(chr, range(ord(c) & ~0x7F, ord(c) + 1)) if unicodedata.category(x) == kind)


class _StandIns(dict):
    def __missing__(self, code: int) -> str:
        self[code] = found = _stand_in(chr(code))
        return found


_SAME_CLASS = _StandIns()


def _masked(value: str) -> bool:
    bare = value.strip("<>[](){}\"'`*#-_. ")
    if not bare or len(set(value[:64])) <= 2 and len(set(value)) <= 2 or _PLACEHOLDER.fullmatch(value) or _PLACEHOLDER.fullmatch(bare) or _MARKED.search(value):
        return True
    return value.translate(_SAME_CLASS) == value


def _decoded(value: str) -> str | None:
    """The printable text that a base64 value holds, if it does."""
    try:
        text = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return None
    return text if text and text.isprintable() else None


def plausible(value: str, quoted: bool = True) -> bool:
    """Whether a literal beside a name that asks for a credential is one. What its begin tells comes first."""
    if len(value) < 6 or value[0] in "<{[":
        return False
    if _REFERENCE.match(value) and not (quoted and value[0] == "$" and any(c.isdigit() for c in value)):
        return False
    if value.startswith(("sha256:", "sha256-", "sha512-", "sha384-", "sha1:", "md5:", "ssh-", "http://", "https://", "./", "../", "~/")):
        return False
    if " " in value or "\t" in value or "(" in value and value.endswith(")") or "${" in value or "{{" in value or _UUID.fullmatch(value) or _masked(value):
        return False
    if re.fullmatch(r"[+-]?[0-9][0-9_.,]*[A-Za-z%]{0,2}", value):  # a number, perhaps with its unit
        return len(value) >= 12 and value.isdigit()
    if re.fullmatch(r"[\w/-]+(?:/[\w.-]+)+\.[a-z]{1,5}|(?:/[a-z0-9_.-]+)+/?", value):  # a file
        return False
    inner = _decoded(value) if len(value) >= 12 and len(value) % 4 == 0 else None
    if inner and (_masked(inner) or inner[0] in "<${"):
        return False
    digits, letters = sum(map(str.isdigit, value)), re.sub(r"[^A-Za-z]+", "", value)
    words = re.split(r"[-_.]", value)
    if _NAME.fullmatch(value) and not digits:
        return False
    if re.fullmatch(r"[A-Za-z_][A-Za-z_.:-]*", value):  # letters only: words, or a phrase of four and more, or random letters
        if "-" in value and "_" not in value and len(words) >= 4 and value.islower():
            return True
        turns = turns_of(letters)
        return len(value) >= 12 and turns >= 3 and turns * 5 >= len(letters) or inner is not None and len(value) >= 12 and turns >= 2
    if not quoted and re.fullmatch(r"[A-Za-z_]\w*(?:(?:\.|::|->)[A-Za-z_]\w*)+", value) and (not digits or value.islower()) and not any(len(w) > 12 for w in words):
        return turns_of(letters) >= 3
    if not quoted and re.fullmatch(r"[a-z_]+[0-9]{1,3}", value):
        return False
    return bool(letters or digits >= 8)


def turns_of(letters: str) -> int:
    return len(_TURN.findall(letters)) if letters.isascii() else sum(a.islower() and b.isupper() for a, b in zip(letters, letters[1:]))


def _token(value: str) -> bool:
    body = value[4:]
    return len(set(body)) > 8 and not re.search(r"EXAMPLE|[xX]{4}|your|_here", value)


def _web_token(value: str) -> bool:
    try:
        head = value.split(".", 1)[0]
        return base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)).strip().startswith(b"{")
    except (binascii.Error, ValueError):
        return False


_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"


def _base62(number: int, width: int) -> str:
    digits = ""
    while number:
        number, k = divmod(number, 62)
        digits = _BASE62[k] + digits
    return digits.rjust(width, "0")


def _bech32(text: str) -> bool:
    """Whether a text of a name, a 1 and a body has the checksum of BIP 173."""
    name, _, body = text.lower().rpartition("1")
    if not name or any(c not in _BECH32 for c in body):
        return False
    check = 1
    for value in [*(ord(c) >> 5 for c in name), 0, *(ord(c) & 31 for c in name), *map(_BECH32.index, body)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ value
        for i, g in enumerate((0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)):
            check ^= g if top >> i & 1 else 0
    return check == 1


def checksum(kind: str, value: str) -> bool | None:
    """Whether a token has its issuer's public checksum; None where the form has none that is public."""
    if kind in ("github", "npm") and len(value) == 40 and not value.startswith("github_pat_"):
        return _base62(zlib.crc32(value[4:34].encode()), 6) == value[34:]
    if kind == "age":
        return _bech32(value)
    return None


def _lower(text: str) -> str:
    """As patterns that ignore case see it, without a change of length."""
    if not text.isascii():
        text = text.replace("\u0130", "i").replace("\u0131", "i").replace("\u017f", "s")
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class _Runs:
    """Where the run of a pattern's characters around a position ends; a run is scanned once, however many positions lie in it."""

    def __init__(self, pattern: re.Pattern):
        self.pattern, self.begin, self.end, self.found = pattern, 0, 0, 0

    def end_of(self, text: str, at: int, limit: int) -> int:
        if not self.begin <= at < self.end:
            found = self.pattern.match(text, at, limit)
            self.begin, self.end = at, found.end() if found else at
            self.words = self.found = self.end
            self.marked = -1
            if self.end - at > 1000:  # else it is looked at as often as there are names in it
                self.marked = max((m.start() for m in _MARKED.finditer(text, at, self.end)), default=-1)
                self.words = max((m.end() for m in _NO_WORD.finditer(text, at, self.end)), default=at)
                self.letters = [m.start() for m in _LETTER.finditer(text, self.words, self.end)]
                self.turns = [m.start() for m in _TURN.finditer("".join(text[k] for k in self.letters))]
                self.parted = max(text.rfind(c, self.words, self.end) for c in "_.:")
        return self.end

    def hopeless(self, text: str, at: int) -> bool:
        """Whether the rest of the run is known not to be plausible, without another look at all of it: marked, or letters without turns."""
        if at <= self.marked:
            return True
        if at < self.words or at >= self.end or text[at] in ".:":
            return False
        first = bisect_left(self.letters, at)
        turns, letters = len(self.turns) - bisect_left(self.turns, first), len(self.letters) - first
        return turns < 2 or self.parted >= at and (turns < 3 or turns * 5 < letters)


Span = tuple[int, int]


def _literal(text: str, at: int, runs: _Runs) -> list[Span]:
    """The spans of the plausible literal that begins at a position after a name and what stands between: several for adjacent ones."""
    for skip in (_FALLBACK, _WRAP):
        found = skip.match(text, at)
        begin = found.end() if found else at
        quoted = _QUOTED.match(text, begin)
        if quoted:
            value, spans = quoted["v"], [quoted.span("v")]
            more = quoted.end() + 1
            in_code = text[begin - 1 : begin] in (" ", "(") and "=" in text[max(0, begin - 4) : begin]
            while following := _MORE.match(text, more) or in_code and _BESIDE.match(text, more):  # adjacent literals are one
                value, more = value + following["v"], following.end()
                spans.append(following.span("v"))
            if _KEY_BLOCK.match(value):
                return []  # found as a key block
            return spans if plausible(value) else []
    end = runs.end_of(text, at, len(text))
    after = text[end : end + 1]
    if end > at and after not in ("(", "{", "["):
        if after and after in ",;&<>|\\" and _ENV_NAME.fullmatch(text, text.rfind("\n", 0, at) + 1, at) and (rest := _ENV_REST.match(text, at)):
            value = rest[0].rstrip(",;")
            if len(value) > end - at and not _NEXT_NAME.search(value) and plausible(value, quoted=False):
                return [(at, at + len(value))]
        stop = end
        while after in ("", " ", "\n", "\r") and stop > at and text[stop - 1] in ".:":
            stop -= 1
        if at >= runs.found or not runs.hopeless(text, at) and plausible(text[at:stop], quoted=False):
            runs.found = min(runs.found, at)  # what begins in a credential belongs to it
            return [(at, stop)]
    return []


def _key_end(text: str, at: int) -> int | None:
    """Where the body of a key block ends that begins at a position: before the END line where nothing but a body stands between, else after
    the lines of the first one's length and one shorter. None where there is no body, or one that has been replaced."""
    parts: list[Span] = []
    while True:
        here = _KEY_GAP.match(text, at).end()
        if not parts and (head := _KEY_HEAD.match(text, here)):
            at = head.end()
            continue
        part = _KEY_PART.match(text, here)
        if not part:
            break
        if not parts and len(part[0]) < 24:
            return None
        parts.append(part.span())
        at = part.end()
    if not parts or (first := text[slice(*parts[0])]).translate(_SAME_CLASS) == first:
        return None
    if _KEY_END.match(text, here):
        return here
    width, last = parts[0][1] - parts[0][0], parts[0][1]
    for a, b in parts[1:]:
        if b - a < width:
            body = text[a:b]
            mixed = any(c.isdigit() or c in "+/=" for c in body) or turns_of(re.sub("[^A-Za-z]+", "", body)) >= 2
            alone = text[b : b + 1] in ("", "\n", "\r", "\\", '"', "'", "`")
            return b if mixed and alone else last
        if b - a > width:
            return last
        last = b
    return last


def _addresses(text: str, begin: int, end: int) -> Iterator[Span]:
    """The spans of passwords in addresses."""
    runs, at = _Runs(_ADDRESS_RUN), begin
    while m := _ADDRESS.search(text, at, end):
        at, first = m.end(), m.start() - 1
        while first > begin and text[first] in _SCHEME:
            first -= 1
        if text[first] in _SCHEME or not (text[first].isascii() and text[first].isalpha()):
            continue
        stop = runs.end_of(text, m.end(), end)
        if stop > m.end() and _HOST.match(text, stop, end):
            more = _ADDRESS_MORE.match(text, stop, end)  # the last @ is the one before the host
            stop = more.end() if more else stop
            yield m.end(), stop
            at = stop + 1


def _web_tokens(text: str, begin: int, end: int) -> Iterator[Span]:
    """The spans of JSON Web Tokens. What follows a run of their characters is the same for all places in it, so a run is tried once."""
    at = begin
    while (at := text.find("eyJ", at, end)) >= 0:
        if at and text[at - 1].isalnum():
            at += 3
            continue
        found = _JWT.match(text, at, end)
        if found and _web_token(found[0]):
            yield found.span()
        at = found.end() if found else _JWT_PART.match(text, at, end).end()


def _options(text: str, begin: int, end: int) -> Iterator[re.Match]:
    """The options of commands that hold a credential: the first after each command word, from the option before it on."""
    for command, then, option in _COMMANDS:
        at = begin
        while (m := command.search(text, at, end)) and (m := then.search(text, m.end(), end) if then else m) and (m := option.search(text, m.end(), end)):
            yield m
            at = m.end()


def _in_line(text: str, begin: int, end: int) -> Iterator[tuple[str, list[Span]]]:
    """(kind, spans) of what begins in a line."""
    for m in ISSUERS.finditer(text, begin, end):
        if _token(m[0]):
            yield m.lastgroup, [m.span()]
    for span in _web_tokens(text, begin, end):
        yield "web_token", [span]
    for m in _KEY_BLOCK.finditer(text, begin, end):
        stop = _key_end(text, m.end())
        if stop:
            yield "private_key", [(m.start(), stop)]
    runs = _Runs(_UNQUOTED)
    for m in _NAME_END.finditer(text, begin, end):
        between = _BETWEEN.match(text, m.end(), end)
        spans = _literal(text, between.end(), runs) if between and between.end() < end else []
        if not spans:
            folded = _FOLDED.match(text, m.end())
            if folded and plausible(folded["v"]):
                spans = [folded.span("v")]
            elif following := _NEXT_LINE.match(text, m.end()):
                spans = _literal(text, following.end(), runs)
        if spans:
            yield "named", spans
    for a, b in _addresses(text, begin, end):
        if b - a >= 4 and text[a] not in "<{[$%*" and not _masked(text[a:b]):
            yield "address", [(a, b)]
    for pattern in (_BASIC, _LOGIN):
        for m in pattern.finditer(text, begin, end):
            inner = _decoded(m["v"])
            if inner and ":" in inner and len(inner.split(":", 1)[1]) >= 4 and not _masked(inner.split(":", 1)[1]) and inner.split(":", 1)[1][0] not in "<${":
                yield "login", [m.span("v")]
    for kind, pattern, found in [*(("place", p, p.finditer(text, begin, end)) for p in (_BEARER, *_PLACES)), ("command", None, _options(text, begin, end))]:
        for m in found:
            value = m["v"].rstrip(",;:") if pattern is not _BEARER else m["v"]
            if plausible(value, quoted=False) and (pattern is not _BEARER or any(c.isdigit() for c in value) or turns_of(value) >= 3):
                yield kind, [(m.start("v"), m.start("v") + len(value))]
    for m in _KEY_PAIR.finditer(text, begin, end):
        yield "key_pair", [m.span("v")]


def _variables(text: str) -> Iterator[Span]:
    """The literal defaults of variables that ask for a credential, up to the block's end or the next variable."""
    heads = list(_VARIABLE.finditer(text)) if "default" in text else []
    for k, m in enumerate(heads):
        if _NAME.fullmatch(m["name"]):
            stop = heads[k + 1].start() if k + 1 < len(heads) else len(text)
            close = text.find("}", m.end(), stop)
            found = _DEFAULT.search(text, m.end(), stop if close < 0 else close)
            if found and plausible(found["v"]):
                yield found.span("v")


def credentials(text: str | None) -> list[tuple[str, list[Span]]]:
    """(kind, spans) of all credentials of a text, in order and without overlaps; the first span is where a credential begins. One that begins
    inside another belongs to that."""
    if not text:
        return []
    found: list[tuple[str, list[Span]]] = []
    end = -1
    for at, word in _AUTOMATON.iter(_lower(text)):
        if at <= end or word == "sg." and text[at - 2 : at + 1] != "SG.":
            continue
        begin, end = text.rfind("\n", 0, at) + 1, text.find("\n", at)
        end = len(text) if end < 0 else end
        found.extend(_in_line(text, begin, end))
    if end < 0:
        return []
    found.extend(("named", [span]) for span in _variables(text))
    found.extend(("named", [m.span("v")]) for m in _ENV_ENTRY.finditer(text) if _NAME.fullmatch(m["name"]) and plausible(m["v"]))
    pieces = sorted((a, b, i > 0, k) for k, (_, spans) in enumerate(found) for i, (a, b) in enumerate(spans))
    kept: list[list[int]] = []
    for a, b, _, k in pieces:
        if kept and a < kept[-1][1]:
            kept[-1][1] = max(b, kept[-1][1])
        else:
            kept.append([a, b, k])
    spans_of: dict[int, list[Span]] = {}
    for a, b, k in kept:
        spans_of.setdefault(k, []).append((a, b))
    return [(found[k][0], spans) for k, spans in spans_of.items()]


def find(text: str | None) -> list[Span]:
    """The spans of all credentials of a text, in order and without overlaps."""
    return sorted(span for _, spans in credentials(text) for span in spans)


_HEX_CLASS = str.maketrans({c: "0" for c in "0123456789abcdefABCDEF"})
_ESCAPE = re.compile(r"(\\[nrt])")


def redact(text: str, spans: list[Span]) -> str:
    """The text with each credential replaced in its own length and alphabet; hexadecimal ones by zeros, so that they stay such.
    Marks, white space and the header of a key block stay."""
    parts, at = [], 0
    for a, b in spans:
        header = _KEY_BLOCK.match(text, a)
        start = header.end() if header else a
        value = text[start:b]
        if header:
            value = "".join(x if i % 2 else x.translate(_SAME_CLASS) for i, x in enumerate(_ESCAPE.split(value)))
        parts += [text[at:start], value.translate(_HEX_CLASS) if _HEX.fullmatch(value) else value if header else value.translate(_SAME_CLASS)]
        at = b
    return "".join([*parts, text[at:]])


def lines_of(text: str, begins: list[int]) -> list[int]:
    """The line of each place, counted from 1."""
    ends = [m.start() for m in re.finditer("\n", text)]
    return [bisect_left(ends, a) + 1 for a in begins]


def places(rows: DataFrame) -> DataFrame:
    """(origin, row_id, line_no) of rows (origin, row_id, text): the lines in which a credential begins, counted from 1."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for origin, row_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = credentials(text)
                if found:
                    for line in sorted(set(lines_of(text, [spans[0][0] for _, spans in found]))):
                        for column, x in zip(out, (origin, row_id, line)):
                            column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=["origin", "row_id", "line_no"])

    return rows.select("origin", "row_id", "text").mapInArrow(run, "origin string, row_id long, line_no long")


def kinds(rows: DataFrame) -> DataFrame:
    """(origin, row_id, line_no, kind, n_chars, checksum) of each credential: how it was found, and whether it has its issuer's public
    checksum, null where there is none that is public."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for origin, row_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = credentials(text)
                for line, (kind, spans) in zip(lines_of(text, [spans[0][0] for _, spans in found]) if found else (), found):
                    a, b = spans[0]
                    for column, x in zip(out, (origin, row_id, line, kind, sum(b - a for a, b in spans), checksum(kind, text[a:b]))):
                        column.append(x)
            types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["origin", "row_id", "line_no", "kind", "n_chars", "checksum"])

    return rows.select("origin", "row_id", "text").mapInArrow(run, "origin string, row_id long, line_no long, kind string, n_chars long, checksum boolean")


def redacted(rows: DataFrame) -> DataFrame:
    """(origin, row_id, credentials, text) of the rows that hold credentials, with these replaced."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for origin, row_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = credentials(text)
                if found:
                    spans = sorted(span for _, spans in found for span in spans)
                    for column, x in zip(out, (origin, row_id, len(found), redact(text, spans))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int32(), pa.string()))], names=["origin", "row_id", "credentials", "text"])

    return rows.select("origin", "row_id", "text").mapInArrow(run, "origin string, row_id long, credentials int, text string")
