"""Credentials in code, configuration and shell text (problem 4).

A field is read as text: in JSON every string value, with escapes undone, becomes a segment ``name: value``
(lexically, so that cut JSON is read as far as it goes); any other field is one segment. A private key
block is one lexeme, else lexemes are words between delimiters, the delimiters themselves and blanks. A
linear-chain conditional random field labels the lexemes of a line (outside, begin, inside) from their
shape and context; the spans of the best path (Viterbi) are the credentials, character by character.

The model is trained on the driver and kept in the shared folder, from labelled lines of a grammar (``training_lines``:
formats of credentials, look-alikes, and plain code, over random names and values), by full-batch gradient
ascent on the regularised likelihood. The number of lines is a parameter; nothing depends on the table.

Begin and inside are impossible in a line that shows no cue (``CUE``: a name, a scheme word, an issuer's
prefix, or a place where passwords stand); so only fields and lines with one are handed to the model. That is a hard zero of the model, not a sample: it
covers every character of every row, and the plan is map-only.

``redact`` masks the spans where they stand in the original field: a span is mapped back, through escapes and
key blocks, to the characters that were written. The same characters elsewhere - a key, an identifier, part of
a number - stay, and as only characters within JSON strings change, a field that parsed before parses after.

Defined cases: null and empty fields have no credentials; a value counts once a field; rows with null or
repeated ids are kept as they are; cut fields are read to their end; texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import json
import random
import re
import string
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shared_folder

MASK = "***REDACTED***"
LABELS = ("outside", "begin", "inside")
#: Words that announce a credential, or something that merely looks like one, by kind.
WORD_KINDS = {
    "PASS": "password sshpass passwords passwd passwort passphrase passcode pass pwd pw passe clave contrasena contraseña kennwort",
    "SECRET": "secret private signing hmac shared",
    "TOKEN": "token tok jwt",
    "KEY": "key apikey",
    "AUTH": "auth authorization bearer basic cred creds credential credentials",
    "LOGIN": "login user username",
    "NEAR": "cookie session access client llm webhook deploy old",
    "HASH": "sha1 sha256 sha512 md5 integrity commit checksum etag hash rev",
    "ID": "uuid id ref build version size",
    "PUBLIC": "public ssh rsa",
    "ENV": "environ env getenv process prompt config settings",
    "MEASURE": "length count limit ttl timeout attempts min max age uses used left total number",
    "MEDIA": "base64 image data src img",
}
KIND_OF_WORD = {word: kind for kind, words in WORD_KINDS.items() for word in words.split()}
CUES = frozenset(["PASS", "SECRET", "TOKEN", "KEY", "AUTH", "NEAR", "HASH", "ID", "PUBLIC", "ENV", "MEDIA"])
#: Published prefixes of keys and tokens.
ISSUER_PREFIXES = ("sk-", "pk-", "ark-", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "xoxa-", "AKIA", "ASIA", "eyJ", "npm_", "pypi-", "hf_", "AIza", "SG.", "rk_", "sk_")
_CUE_TEXT = r"pass(?!ed\b)|pwd|\bpw\b|secret(?!ar)|token(?!ize)|\btok\b|key\b|key[_=:\s'\"-]|keyid|auth|bearer|basic|cred|login|hmac|signing|cookie|clave|contrase|kennwort|private|sk-|ark-|gh[pos]_|glpat|xox[bpa]-|akia|asia|eyj|hf_|aiza|npm_|pypi-"
_FORM_TEXT = r"://[^\s/@]+@|:\d+:[^\s:]+:[^\s:]+:|\s-p[^\s-]|\s-u [^\s:]+:"
_ISSUER_TEXT = "(?<![a-z0-9])(?:" + "|".join(re.escape(p.lower()) for p in ISSUER_PREFIXES) + ")"
CUE = re.compile(f"(?i){_CUE_TEXT}|{_FORM_TEXT}|{_ISSUER_TEXT}")
#: Literal parts of which every text that ``CUE`` finds has one: a cheap first test, for the JVM.
CUE_PARTS = tuple("pass pwd pw secret tok key auth bearer basic cred login hmac signing cookie clave contrase kennwort private sk- ark- gho_ ghp_ ghs_ glpat xoxb- xoxp- xoxa- akia asia eyj hf_ aiza npm_ pypi-".split()) + tuple(sorted({p.lower() for p in ISSUER_PREFIXES}))
#: A name whose value is on the next line, and a line that is one value.
_NAME_ENDS = re.compile(r"[:=]\s*(?:[|>][-+]?|[\\\"'`(])?\s*\Z")
_LONE_VALUE = re.compile(r"\s*[^\s:=]\S*(?<![:={(\[])\s*\Z")
#: What JSON, also cut, has outside its strings.
_OUTSIDE_STRINGS = re.compile(r"(?:[\s{}\[\]:,+\-.\dEe]|true|false|null)*(?:t|tr|tru|f|fa|fal|fals|n|nu|nul)?\Z")
_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]+-----(?:(?!-----BEGIN )[\s\S])*?(?:-----END [A-Z0-9 ]+-----|\Z)")
_LEXEME = re.compile(r"(\x00[^\x00]*\x00)|(\s+)|((?<=\s)-p(?=[^\s-]))|((?<=:)//)|([^\s\"'`=:,;()<>\[\]{}&?@|\\\x00]{15,}={1,2}(?=[\"'`\s;,)<&]|$))|([^\s\"'`=:,;()<>\[\]{}&?@|\\\x00]+)|(.)", re.S)
_STRING = re.compile(r'"((?:[^"\\]|\\[\s\S])*)("|\\?\Z)(\s*:)?')
_PART = re.compile(r"[A-ZÀ-Þ]+(?![a-zß-ÿ])|[A-ZÀ-Þ]?[a-zß-ÿ]+|\d+")
_PLAIN_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*\Z")


def may_have_credentials(c: Column, low: Column | None = None) -> Column:
    """Whether a field can have a cue; plain searches first, patterns only for what they cannot say. ``low`` is the field in lower case, if it is at hand."""
    low, found = F.lower(c) if low is None else low, F.lit(False)
    for part in CUE_PARTS:
        found = found | low.contains(part)
    found = found | low.contains("\\u") | ((c.contains("://") | c.contains(":\\/\\/")) & c.contains("@")) | c.rlike(r":[0-9]+:[^\s:]+:[^\s:]+:") | c.rlike(r"[\snt]-[pPuU]")
    return F.coalesce(found, F.lit(False))


def _parts(field: str) -> list[tuple[str, str, int, int]]:
    """(name, text, start, end) of a field: where the text is written; ``end`` is -1 if the text is the field as it stands."""
    if field.lstrip()[:1] not in ('{', '[', '"') or not _OUTSIDE_STRINGS.match(_STRING.sub(":", field)):
        return [("", field, 0, -1)]
    out, name = [], ""
    for m in _STRING.finditer(field):
        raw = m.group(1)
        if "\\" in raw:
            try:
                raw = json.loads(f'"{raw}"', strict=False)
            except ValueError:
                raw = _undo_escapes(raw)
        if m.group(3):
            name = raw
        else:
            out.append((name, raw, m.start(1), m.end(1)))
            name = ""
    return out


def segments(field: str) -> list[tuple[str, str]]:
    """(name, text) of a field; names are "" outside JSON objects. A field with other text between its strings is no JSON."""
    return [(name, text) for name, text, _, _ in _parts(field)]


_WRITTEN = re.compile(r"\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|\\u[0-9a-fA-F]{4}|\\.|[^\\]", re.S)


def _written_at(raw: str) -> list[int]:
    """Where each character of a JSON string begins as it is written, and the end."""
    ends = [m.end() for m in _WRITTEN.finditer(raw)]
    return [0, *ends]


def _undo_escapes(raw: str) -> str:
    simple = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
    text = re.sub(r"\\(?:u([0-9a-fA-F]{4})|(.)|$)", lambda m: chr(int(m.group(1), 16)) if m.group(1) else simple.get(m.group(2) or "", m.group(2) or ""), raw, flags=re.S)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def lexemes(line: str) -> list[str]:
    return [m.group(0) for m in _LEXEME.finditer(line)]


@lru_cache(maxsize=200_000)
def _look(lexeme: str) -> tuple[str, str, tuple[str, ...], bool]:
    """(shape, coarse shape, cue or look-alike words in it, whether it is a name)."""
    first = lexeme[:1]
    if first == "\x00":
        shape = "PRIVATE-BLOCK" if "PRIVATE" in lexeme else "OTHER-BLOCK"
        return shape, shape, (), False
    if first.isspace():
        return "blank", "blank", (), False
    if len(lexeme) == 1 and not lexeme.isalnum():
        return lexeme, lexeme, (), False
    parts = [p.lower() for p in _PART.findall(lexeme)]
    kinds = {KIND_OF_WORD.get(w) or next((KIND_OF_WORD[e] for e in ("password", "secret", "token", "apikey") if w.endswith(e)), None) for w in parts} - {None}
    words = tuple(sorted(kinds))
    issuer = next((p for p in ISSUER_PREFIXES if lexeme.startswith(p)), None)
    core = lexeme.rstrip("=")
    size = len(core)
    if issuer and size >= len(issuer) + 12 and any(c.isdigit() or c.isupper() for c in core[len(issuer) :]):
        return f"issuer:{issuer}", "issuer", (), False
    if re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", core, re.I):
        return "uuid", "uuid", (), False
    if re.fullmatch(r"[0-9a-f]+", core) and size >= 16 and any(c.isdigit() for c in core):
        kind = {32: "hex32", 36: "hex36", 40: "hex40", 64: "hex64"}.get(size, "hex")
        return kind, "hex", (), False
    if re.fullmatch(r"\d[\d.]*", core):
        return "number", "number", (), False
    if re.fullmatch(r"(?i)x{4,}|\*+.*|\.{3,}|changeme.*|your[-_].*|.*placeholder.*", core):
        return "dummy", "dummy", (), False
    if re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+){2,}", core):
        return "host", "host", words, False
    turns = sum(a.isdigit() != b.isdigit() or (a.isalpha() and b.isalpha() and a.islower() and b.isupper()) for a, b in zip(core, core[1:], strict=False))
    symbols = "".join(sorted({c for c in core if not c.isalnum()}))
    has_digit, has_upper = any(c.isdigit() for c in core), any(c.isupper() for c in core)
    unlike_words = size >= 12 and sum(c.isupper() for c in core) >= 3 and any(c.islower() for c in core) and not re.search(r"[a-z]{4}", core)
    if turns >= 3 and turns * 5 >= size and size >= 8 and has_digit or unlike_words:
        length = "short" if size < 15 else "middle" if size < 64 else "long"
        return f"opaque:{length}", "opaque", (), False
    if not symbols:
        if core.isalpha():
            shape = "lower" if core.islower() else "UPPER" if core.isupper() else "Title" if core[1:].islower() else "camel"
        else:
            shape = "alnum"
    else:
        shape = ("/" if "/" in symbols else "") + ("." if "." in symbols else "") + ("-" if "-" in symbols else "") + ("_" if "_" in symbols else "") + ("!" if set(symbols) - set("/.-_$") else "") + ("$" if "$" in symbols else "") + ("9" if has_digit else "") + ("A" if has_upper else "")
    opaque_word = size >= 6 and (has_digit or bool(symbols) or (has_upper and not core.isupper() and not core[1:].islower()))
    return f"{shape}:{min(size // 8, 3)}", ("wordlike!" if opaque_word else "wordlike"), words, bool(_PLAIN_NAME.match(core)) or bool(words)


def features(line: list[str]) -> list[list[str]]:
    """The features of each lexeme of a line."""
    looks = [_look(x) for x in line]
    seen = [i for i, x in enumerate(looks) if x[0] != "blank"]
    out: list[list[str]] = [["blank"] for _ in line]
    cue, gap, colons, scheme = "none", "", 0, False
    place = {i: k for k, i in enumerate(seen)}

    def at(k: int) -> str:
        if not 0 <= k < len(seen):
            return "edge"
        shape, coarse, words, _ = looks[seen[k]]
        return "+".join(words) if words else coarse

    previous_blank = True
    for i, (shape, coarse, words, _) in enumerate(looks):
        if shape == "blank":
            colons, scheme, previous_blank = 0, False, True
            gap = gap + "_" if not gap.endswith("_") else gap
            continue
        k = place[i]
        left, right = at(k - 1), at(k + 1)
        glued_left = "" if previous_blank else "g"
        glued_right = "g" if i + 1 < len(line) and looks[i + 1][0] != "blank" else ""
        near = gap if len(gap) <= 8 else "far"
        own = "+".join(words)
        out[i] = ["bias", f"s={shape}", f"c={coarse}", f"w={own}", f"l={left}", f"r={right}", f"l2={at(k - 2)}", f"l3={at(k - 3)}", f"l2l={at(k - 2)}|{left}", f"cue={cue}", f"cue={cue}|{near}", f"cg={cue}|{near}|{coarse}", f"sc={shape}|{cue}", f"cl={coarse}|{left}|{glued_left}", f"cr={coarse}|{right}|{glued_right}", f"col={min(colons, 4)}|{coarse}|{right}", f"url={scheme}|{min(colons, 3)}|{right}|{coarse}", f"lr={left}|{right}|{coarse}"]
        if CUES.intersection(words) and coarse.startswith("wordlike"):
            cue, gap = own, ""
        elif len(coarse) == 1:
            gap += coarse
        else:
            gap += "w"
        if coarse == ":":
            colons += 1
            scheme = scheme or (k + 1 < len(seen) and line[seen[k + 1]].startswith("//"))
        previous_blank = False
    return out


class Tagger:
    """A linear-chain CRF over lexemes."""

    def __init__(self, vocabulary: dict[str, int], emit: np.ndarray, move: np.ndarray, begin: np.ndarray):
        self.vocabulary, self.emit, self.move, self.begin = vocabulary, emit, move, begin

    def _scores(self, lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        know = self.vocabulary.get
        sizes = np.array([len(x) for x in lines])
        width = int(sizes.max())
        owner, index = [], []
        for n, line in enumerate(lines):
            for i, names in enumerate(features(line)):
                for name in names:
                    f = know(name)
                    if f is not None:
                        owner.append(n * width + i)
                        index.append(f)
        scores = np.zeros((len(lines) * width, 3))
        owner, index = np.array(owner, np.int64), np.array(index, np.int64)
        for label in range(3):
            scores[:, label] = np.bincount(owner, self.emit[index, label], minlength=len(scores))
        return scores.reshape(len(lines), width, 3), sizes

    def spans(self, lines: list[list[str]]) -> list[list[tuple[int, int]]]:
        """[first, last + 1) lexemes of the credentials of each line, by the best path."""
        if not lines:
            return []
        scores, sizes = self._scores(lines)
        n, width, _ = scores.shape
        best, back = scores[:, 0] + self.begin, np.zeros((n, width, 3), np.int8)
        rows = np.arange(n)
        last = np.where((sizes == 1)[:, None], best, 0)
        for t in range(1, width):
            step = best[:, :, None] + self.move[None]
            back[:, t] = step.argmax(1)
            best = step.max(1) + scores[:, t]
            last = np.where((sizes == t + 1)[:, None], best, last)
        label = last.argmax(1)
        path = np.zeros((n, width), np.int8)
        for t in range(width - 1, -1, -1):
            live = sizes > t
            path[live, t] = label[live]
            moved = back[rows, t, label] if t else label
            label = np.where(live & (sizes > t), moved, label)
        found = []
        for n_, size in enumerate(sizes.tolist()):
            labels, i, spans = path[n_, :size].tolist(), 0, []
            while i < size:
                if labels[i]:
                    j = i + 1
                    while j < size and labels[j] == 2:
                        j += 1
                    spans.append((i, j))
                    i = j
                else:
                    i += 1
            found.append(spans)
        return found

    @classmethod
    def train(cls, data: list[tuple[list[str], list[int]]], rounds: int = 45, rate: float = 0.4, decay: float = 2e-5) -> Tagger:
        """Full-batch Adam on the mean log-likelihood of labelled lines."""
        vocabulary: dict[str, int] = {}
        lines = [features(x) for x, _ in data]
        n, width = len(data), max(len(x) for x, _ in data)
        owner, index = [], []
        gold = np.zeros((n, width), np.int64)
        sizes = np.array([len(x) for x, _ in data])
        for k, (line, (_, labels)) in enumerate(zip(lines, data, strict=True)):
            gold[k, : len(labels)] = labels
            for i, names in enumerate(line):
                for name in names:
                    owner.append(k * width + i)
                    index.append(vocabulary.setdefault(name, len(vocabulary)))
        owner, index = np.array(owner), np.array(index)
        live = np.arange(width)[None] < sizes[:, None]
        emit, move, begin = np.zeros((len(vocabulary), 3)), np.zeros((3, 3)), np.zeros(3)
        move[0, 2], begin[2] = -30, -30  # inside only follows begin or inside
        parameters = [emit, move, begin]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        one_hot = np.eye(3)[gold] * live[:, :, None]
        observed_move = np.zeros((3, 3))
        np.add.at(observed_move, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        observed_begin = one_hot[:, 0].sum(0)
        for step in range(1, rounds + 1):
            scores = np.stack([np.bincount(owner, emit[index, y], minlength=n * width) for y in range(3)], 1).reshape(n, width, 3)
            forward, backward = np.zeros((n, width, 3)), np.zeros((n, width, 3))
            forward[:, 0] = begin + scores[:, 0]
            for t in range(1, width):
                x = forward[:, t - 1, :, None] + move
                top = x.max(1)
                forward[:, t] = np.log(np.exp(x - top[:, None]).sum(1)) + top + scores[:, t]
            for t in range(width - 2, -1, -1):
                x = move + (backward[:, t + 1] + scores[:, t + 1])[:, None, :]
                top = x.max(2)
                inner = np.log(np.exp(x - top[:, :, None]).sum(2)) + top
                backward[:, t] = np.where((sizes > t + 1)[:, None], inner, 0)
            end = forward[np.arange(n), sizes - 1]
            top = end.max(1)
            total = np.log(np.exp(end - top[:, None]).sum(1)) + top
            marginal = np.exp(np.minimum(forward + backward - total[:, None, None], 0)) * live[:, :, None]
            pair = np.exp(np.minimum(forward[:, :-1, :, None] + move + (scores + backward)[:, 1:, None, :] - total[:, None, None, None], 0)) * live[:, 1:, None, None]
            excess = (one_hot - marginal).reshape(-1, 3)
            gradients = [np.stack([np.bincount(index, excess[owner, y], minlength=len(emit)) for y in range(3)], 1) / n - decay * emit, (observed_move - pair.sum((0, 1))) / n, (observed_begin - marginal[:, 0].sum(0)) / n]
            gradients[1][0, 2] = gradients[2][2] = 0
            for p, g, m, v in zip(parameters, gradients, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(vocabulary, emit, move, begin)


# ---- the grammar of the training lines -------------------------------------------------------------

_SYLLABLES = "ba co di fu ga he ji ka lo mi no pe qui ra so ta ul va wen xo ya zel bri cran dro fli gron".split()
_TERMS = "cache queue worker index parser router bridge schema stream batch codec wrapper proxy replica digest module vector region branch".split()


def _name(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(2, 4)))


def _opaque(r: random.Random, low: int, high: int, alphabet: str = string.ascii_letters + string.digits) -> str:
    if alphabet.startswith(string.ascii_letters) and r.random() < 0.15:
        alphabet = alphabet.replace(string.digits, "")
    base = "".join(r.choice(alphabet) for _ in range(r.randint(5, 14)))
    size = r.randint(low, high)
    return (base * (size // len(base) + 1))[:size] if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(size))


def _password(r: random.Random) -> str:
    mark = r.choice("!%#+._-*~^$")
    words = [_name(r), r.choice(_TERMS)]
    return r.choice([
        lambda: words[0].capitalize() + str(r.randint(10, 9999)) + mark,
        lambda: words[1].capitalize() + mark + _opaque(r, 5, 9),
        lambda: words[0] + r.choice("-._!") + words[1] + str(r.randint(1, 99)),
        lambda: f"{words[0]}-{words[1]}-{_name(r)}",
        lambda: _opaque(r, 10, 18),
        lambda: _opaque(r, 4, 6) + mark + _opaque(r, 3, 6),
        lambda: words[0] + r.choice("-._") + words[1],
        lambda: str(r.randint(10**5, 10**9)),
    ])()


def _issued(r: random.Random) -> str:
    url_safe = string.ascii_letters + string.digits
    return r.choice([
        lambda: "sk-" + _opaque(r, 20, 48), lambda: "ark-" + _opaque(r, 8, 8) + "-" + _opaque(r, 18, 24), lambda: "ghp_" + _opaque(r, 36, 36), lambda: "glpat-" + _opaque(r, 20, 20, url_safe + "_-"),
        lambda: f"xoxb-{r.randint(10**11, 10**12 - 1)}-{_opaque(r, 20, 24)}", lambda: "AKIA" + _opaque(r, 16, 16, string.ascii_uppercase + string.digits), lambda: "eyJ" + ".".join([_opaque(r, 15, 20), "eyJ" + _opaque(r, 25, 40), _opaque(r, 25, 43, url_safe + "_-")]),
    ])()


def _credential_line(r: random.Random) -> str:
    """A line with one credential between U+0001 and U+0002."""
    q, n, t, user, host = r.choice("\"'"), _name(r), r.choice(_TERMS), _name(r), f"{r.choice(['db', 'api', 'git', 'cache', 'mq'])}.{_name(r)}.example"
    hexa = lambda *size: _opaque(r, *size, "0123456789abcdef")
    opaque = lambda: _opaque(r, 20, 42, string.ascii_letters + string.digits + "_-")
    pair = lambda: _opaque(r, 24, 56) + r.choice(["", "", "=", "=="])
    p = lambda: f"\x01{_password(r)}\x02"
    k = lambda: f"\x01{r.choice([opaque, opaque, lambda: _opaque(r, 20, 42), lambda: _issued(r)])()}\x02"
    i = lambda: f"\x01{_issued(r)}\x02"
    h = lambda: f"\x01{hexa(32, 40)}\x02"
    scheme = r.choice(["postgresql", "mysql", "amqp", "mongodb+srv", "redis", "https"])
    secret_name = r.choice(["{U}_PASSWORD", "{U}_SECRET", "{U}_TOKEN", "{U}_API_KEY", "{U}_KEY", "{U}_CRED", "DB_PASSWORD", "PGPASSWORD", "ACCESS_TOKEN", "API_TOKEN"]).replace("{U}", n.upper())
    value = lambda: r.choice([p, k, i])()
    forms = [
        lambda: f"password{r.choice(['=', ' = ', ': ', ' := '])}{q}{p()}{q}", lambda: f"{r.choice(['db_pass', 'pwd', 'passwd', 'mot_de_passe', 'contraseña', 'passphrase', 'clave', 'kennwort', 'user_password', 'dbPassword'])}{r.choice(['=', ' = ', ': ', ' := '])}{q}{p()}{q}",
        *[lambda: f"{r.choice(['password', 'pwd', 'passwd', 'DB_PASSWORD', 'PGPASSWORD', 'pin_pass'])}{r.choice(['=', ' = ', ': '])}{r.choice(['', q])}\x01{r.randint(10**4, 10**9)}\x02"] * 2, lambda: f"password: {p()}", lambda: f"{r.choice(['export ', '', ''])}{secret_name}={value()}", lambda: f"{secret_name}{r.choice([': ', '=', ' = '])}{q}{value()}{q}", lambda: f"{secret_name}: {value()}", *[lambda: f"{secret_name}: {h()}"] * 2, lambda: f"{n.upper()}_PASSWORD={p()}",
        lambda: f"<password>{p()}</password>", lambda: f"<add key={q}DbPassword{q} value={q}{p()}{q} />", lambda: f"<{r.choice(['clientSecret', 'apiKey', 'token'])}>{r.choice([h, k])()}</clientSecret>",
        lambda: f"machine {host} login {user} password {p()}", lambda: f"login --user {user} --password {p()} --quiet", lambda: f"login as {user} with pass {p()}", lambda: f"mysqldump -u {user} -p{p()} shop", lambda: f"mysql -h {host} -u {user} -p{p()}", *[lambda: f"{host}:5432:{n}:app:{p()}"] * 2,
        *[lambda: f"sshpass -p {q}{p()}{q} ssh {user}@{host}"] * 2, lambda: f"sshpass -p {p()} ssh {user}@{host}", lambda: f"PGPASSWORD={p()} psql -h {host} -U {user}", lambda: f"REDISCLI_AUTH={p()} redis-cli -h {host}", lambda: f"{n}.apiKey={k()}", lambda: f"{r.choice(['passwort', 'contrasena', 'contraseña', 'PASSWORD', 'Password', 'pass', 'pw'])}: {p()}", lambda: f"const jwt = {q}{i()}{q}", lambda: f"curl -u {user}:{p()} https://{host}/{n}",
        lambda: f"DATABASE_URL={scheme}://{user}:{p()}@{host}:5432/{n}", lambda: f"dsn = {q}{scheme}://svc_{user}:{p()}@{host}/main{q}", lambda: f"  {t}: {scheme}://{user}:{p()}@{host}",
        lambda: f"git clone https://bot:{i()}@{host}/{n}.git", lambda: f"remote = https://{i()}@{host}/{n}",
        lambda: f"Authorization: {r.choice(['Bearer', 'bearer'])} {k()}", lambda: f"curl -H {q}Authorization: Bearer {k()}{q} https://{host}/v1/{n}", lambda: f"headers[{q}Authorization{q}] = {q}bearer {k()}{q}", lambda: f"Authorization: {r.choice(['Basic', 'basic'])} \x01{pair()}\x02", lambda: f"curl -H {q}authorization: basic \x01{pair()}\x02{q} https://{host}", lambda: f"headers = {{{q}Authorization{q}: {q}Basic \x01{pair()}\x02{q}}}",
        lambda: f"X-Api-Key: {k()}", lambda: f"?api-key={k()}&page={r.randint(1, 9)}", lambda: f"GET /v1/{n}?{r.choice(['token', 'access_token', 'key'])}={k()}&page=2", lambda: f"apikey:{k()}", lambda: f"api_key = {q}{k()}{q}", lambda: f"client = Client(api_key={q}{k()}{q}, timeout={r.randint(1, 60)})", lambda: f"{r.choice(['token', 'access_token', 'refreshToken', 'authToken'])}{r.choice(['=', ' = ', ': '])}{q}{k()}{q}{r.choice(['', ';', ','])}", lambda: f"auth({q}{user}{q}, tok={q}{k()}{q})",
        lambda: f"client_secret: {h()}", lambda: f"SECRET_KEY = {q}{h()}{q}", lambda: f"signing.hmac({q}{h()}{q}, body)  # shared secret", lambda: f"{r.choice(['signing_key', 'signing_secret', 'webhook_secret'])} = {q}{r.choice([h, k])()}{q}", lambda: f"//{host}/:_authToken={r.choice([h, k])()}",
        lambda: f"aws_secret_access_key = {k()}", lambda: f"AWS_SECRET_ACCESS_KEY=\x01{_opaque(r, 40, 40, string.ascii_letters + string.digits + '/+')}\x02", lambda: f"secretAccessKey: {q}\x01{_opaque(r, 40, 40, string.ascii_letters + string.digits + '/+')}\x02{q},", lambda: f"aws_access_key_id = {i()}", lambda: f"new S3({{ accessKeyId: {q}{i()}{q} }})",
        lambda: f"# old: {i()}", lambda: f"  - {i()}", lambda: f"const k = {q}{i()}{q};", lambda: f"key {i()} loaded for {n}", lambda: f"model.use({q}{i()}{q})", lambda: f"notify({q}{i()}{q}, channel={q}#{n}{q})", lambda: f"{n}_llm: {i()}  # rotated weekly", lambda: f"{n.upper()}={i()}", lambda: f"GH_AUTH={i()} make publish", lambda: f"deploy --with {i()}", lambda: f"ci_token {i()}", lambda: f"session_cookie={i()}; Path=/", lambda: f"set-header X-{n} {i()}", lambda: f"{n}({q}{i()}{q})", lambda: f"echo {i()} | login",
        lambda: "\x01\x00PRIVATE\x00\x02", lambda: f"key = {q * 3}\x01\x00PRIVATE\x00\x02{q * 3}", lambda: f"cat > {n}.pem <<EOT", lambda: f"{n}_key: |",
    ]
    return r.choice(forms)()


def _alike_line(r: random.Random) -> str:
    """A line that looks like a credential and has none."""
    q, n, t, user, host = r.choice("\"'"), _name(r), r.choice(_TERMS), _name(r), f"{r.choice(['db', 'api', 'git', 'cache', 'mq'])}.{_name(r)}.example"
    hexa = lambda size: _opaque(r, size, size, "0123456789abcdef")
    uuid = lambda: "-".join(hexa(s) for s in (8, 4, 4, 4, 12))
    dummy = r.choice(["<your-api-key>", "xxxxxxxx", "***REDACTED***", "${" + n.upper() + "}", "$" + n.upper(), "changeme", "<token>", "***", "...", "${" + n + "}", "{{ " + n + " }}", "%(" + n + ")s"])
    secret_name = r.choice(["password", "token", "api_key", "secret", "DB_PASSWORD", "client_secret", "ACCESS_TOKEN"])
    forms = [
        lambda: f"{secret_name}{r.choice(['=', ' = ', ': '])}{q}{dummy}{q}", lambda: f"{secret_name}{r.choice(['=', ': '])}{dummy}", lambda: f"Authorization: Bearer {dummy}", lambda: f"Authorization: Basic {dummy}", lambda: f"dsn = {q}postgresql://{user}:{dummy}@{host}/main{q}", lambda: f"curl -H {q}Authorization: Bearer ${n.upper()}{q} https://{host}",
        lambda: f"{secret_name} = os.environ[{q}{n.upper()}_PASSWORD{q}]", lambda: f"{secret_name} = os.getenv({q}{n.upper()}_TOKEN{q})", lambda: f"{secret_name}: process.env.{n.upper()}_TOKEN", lambda: f"const pw = await prompt({q}password: {q})", lambda: f"def reset_password(self, token):", lambda: f"def {n}_token(user, secret):", lambda: f"{secret_name} = get_{secret_name}({n}, {t})", lambda: f"{secret_name} = config.{n}.{secret_name}", lambda: f"self.{secret_name} = {secret_name}", lambda: f"if not {secret_name}:", lambda: f"return {n}.{secret_name}",
        lambda: f"max_tokens: {r.randint(100, 9999)}", lambda: f"{r.choice(['password', 'token', 'secret', 'key', 'auth'])}_{r.choice(['length', 'count', 'size', 'limit', 'ttl', 'timeout', 'attempts', 'version', 'min_length'])}{r.choice([' = ', ': ', '='])}{r.randint(1, 10**r.randint(1, 9))}", lambda: f"max_{r.choice(['password', 'token', 'key', 'auth'])}_{r.choice(['length', 'attempts', 'age', 'uses'])}: {r.randint(1, 10**r.randint(1, 7))}", *[lambda: f"{n}_{r.choice(['cookie', 'session', 'client', 'access', 'deploy', 'auth', 'key', 'token'])}{r.choice([': ', ' = ', '='])}{r.randint(0, 10**r.randint(1, 6))}"] * 3, lambda: f"ssh -p {r.randint(22, 65000)} {user}@{host}", lambda: f"docker run -p {r.randint(80, 9999)}:{r.randint(80, 9999)} {n}", lambda: f"{r.randint(100, 10**6)} {r.choice(['tokens', 'keys', 'passwords'])} {r.choice(['used', 'left', 'read'])}", lambda: f"{r.choice(['tokens', 'keys', 'token_total', 'key_id', 'author_id'])}: {r.randint(100, 10**8)}", lambda: f"tokenizer = load({q}{n}{q})", lambda: f"secretName: {n}-tls", lambda: f"SECRETARY: {n}", lambda: f"secretary = {n}.{t}({q}{n}{q})", lambda: f"key: {n}", lambda: f"keys = [{q}{n}{q}, {q}{t}{q}]", lambda: f"primary_key={q}{n}_id{q}", lambda: f"{n}.get({q}key{q}, {r.randint(1, 99)})", lambda: f"{r.randint(1, 99)} passed in {r.randint(0, 9)}.{r.randint(10, 99)}s", *[lambda: f"branch = {q}{r.choice(['task', 'disk', 'risk', 'desk'])}-{n}-{t}-{r.choice([_name(r), r.choice(_TERMS)])}{q}"] * 4,
        lambda: f"sha256:{hexa(64)}  {n}.tar", lambda: f"commit {hexa(40)}", lambda: f"integrity sha512-{_opaque(r, 80, 88)}{r.choice(['', '=='])}", lambda: f"id = {q}{uuid()}{q}", lambda: f"{r.choice(['uuid', 'request_id', 'trace_id', 'session_id'])}: {uuid()}", lambda: f"checksum: {hexa(r.choice([32, 40, 64]))}", lambda: f"etag = {q}{hexa(32)}{q}", lambda: f"image: {host}/{n}@sha256:{hexa(64)}", lambda: f"img src={q}data:image/png;base64,{_opaque(r, 60, 80)}{q}", lambda: f"md5 {hexa(32)}", lambda: f"{n}.{hexa(8)}.js",
        lambda: "\x00OTHER\x00", lambda: f"ssh-rsa {_opaque(r, 60, 90)} {user}@{host}", lambda: f"pub = {q * 3}\x00OTHER\x00{q * 3}", lambda: f"https://docs.{n}.example/{t}/auth", lambda: f"git push https://{host}/{n}.git", lambda: f"login --user {user} --quiet", lambda: f"mkdir -p{r.choice([' ', ' '])}/srv/{n}/{t}", lambda: f"cat /home/dev/{n}/{t}.key", lambda: f"file_path: /srv/{n}/secrets.{r.choice(['py', 'env', 'json'])}", lambda: f"{host}:5432", lambda: f"ssh {user}@{host}", lambda: f"call_{hexa(16)}", lambda: f"id: {t}_{hexa(16)}",
    ]
    return r.choice(forms)()


def _plain_line(r: random.Random) -> str:
    q, n, t, m = r.choice("\"'"), _name(r), r.choice(_TERMS), _name(r)
    forms = [
        lambda: f"logger.info({q}{n} {t} %s{q}, {m})", lambda: f"export {n.upper()}_{t.upper()}={m}", lambda: f"SELECT {t} FROM {n} WHERE {m} = {r.randint(1, 400)};", lambda: f"assert {n}({r.randint(1, 9)}) == {r.randint(1, 9)}", lambda: f"return {n}.{t}({r.randint(1, 99)})", lambda: f"{t} = {n}.load({q}{m}{q})", lambda: f"FROM {n}:{r.randint(1, 9)}.{r.randint(1, 20)}", lambda: f"if {n} > {r.randint(1, 60)}: {t}({m})",
        lambda: f"def {n}_{t}(self, {m}):", lambda: f"{n}_{t}: {r.randint(1, 9999)}", lambda: f"const {n} = require({q}{t}/{m}{q});", lambda: f"<{t} name={q}{n}{q} size={q}{r.randint(1, 60)}{q}/>", lambda: f"# our {n} {t} keeps {m} shallow", lambda: f"pytest tests/{n}", lambda: f"cat /srv/{n}/{t}.{r.choice(['py', 'env', 'json', 'sql'])}", lambda: f"git commit -m {q}{n} {t} of {m}{q}", lambda: f"grep -rn {n} src", lambda: f"set {n} {t} to {r.randint(1, 9999)} once {m}", lambda: f"python {n}.py --{t} {r.randint(1, 9)}",
    ]
    return r.choice(forms)()


def training_lines(count: int = 5000, seed: int = 11) -> list[tuple[list[str], list[int]]]:
    """Labelled lines of the grammar."""
    r, out = random.Random(seed), []
    for _ in range(count):
        line = r.choices([_credential_line, _alike_line, _plain_line], [5, 4, 2])[0](r)
        x = r.random()
        if r.random() < 0.12:
            line = f"{line}{r.choice([' && ', '; '])}{_plain_line(r)}"
        if x < 0.3:
            line = " " * r.choice([2, 4]) + line
        elif x < 0.4:
            line = f"{_plain_line(r)}{r.choice([' && ', '; '])}{line}"
        elif x < 0.45:
            line = f"command: {_plain_line(r)}{r.choice([' && ', '; '])}{line}"
        elif x < 0.5:
            line = f"{r.choice(['content', 'command', 'new_string', 'prompt', 'source'])}: {line}"
        tokens, labels, mark = [], [], 0
        for piece in re.split("([\x01\x02])", line):
            if piece == "\x01":
                mark = 1
            elif piece == "\x02":
                mark = 0
            else:
                for lexeme in lexemes(piece) if not (mark == 0 and piece.endswith(" -p")) else [*lexemes(piece[:-2]), "-p"]:
                    tokens.append(lexeme)
                    labels.append(mark)
                    mark = 2 if mark else 0
        if "".join(lexemes(line.replace("\x01", "").replace("\x02", ""))) and lexemes(line.replace("\x01", "").replace("\x02", "")) == tokens:
            out.append((tokens, labels))
    return out


_TRAINED: dict[tuple[int, int], Tagger] = {}


def tagger(count: int = 5000, seed: int = 11) -> Tagger:
    """The trained model; trained once a process."""
    if (count, seed) not in _TRAINED:
        _TRAINED[count, seed] = Tagger.train(training_lines(count, seed))
    return _TRAINED[count, seed]


def shared_tagger(spark: SparkSession, count: int = 5000, seed: int = 11) -> Tagger:
    """The trained model, kept as a table in the shared folder under a hash of this module and the parameters, so that later sessions only read it."""
    if (count, seed) in _TRAINED:
        return _TRAINED[count, seed]
    with open(__file__, "rb") as f:
        mark = hashlib.md5(f.read() + repr((count, seed)).encode()).hexdigest()
    path = f"{shared_folder(spark)}/tracewell/models/crf-{mark}"
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: (r["part"], r["n"]))
        weights = {part: np.array([r["w"] for r in rows if r["part"] == part]) for part in ("begin", "emit", "move")}
        vocabulary = {r["name"]: r["n"] for r in rows if r["part"] == "emit"}
        _TRAINED[count, seed] = Tagger(vocabulary, weights["emit"], weights["move"], weights["begin"][0])
        return _TRAINED[count, seed]
    model = tagger(count, seed)
    names = {i: name for name, i in model.vocabulary.items()}
    rows = [("emit", i, names[i], w) for i, w in enumerate(model.emit.tolist())] + [("move", i, "", w) for i, w in enumerate(model.move.tolist())] + [("begin", 0, "", model.begin.tolist())]
    spark.createDataFrame(rows, "part string, n int, name string, w array<double>").coalesce(1).write.mode("ignore").parquet(path)
    return model


class _Line:
    """A line as the model sees it and where it comes from: ``prefix`` characters of context, then text from ``offset`` on."""

    __slots__ = ("lexemes", "owner", "part", "blocks", "prefix", "offset")

    def __init__(self, text: str, owner: int, part: int, blocks: list[tuple[int, str, int]], prefix: int, offset: int):
        self.lexemes, self.owner, self.part, self.blocks, self.prefix, self.offset = lexemes(text), owner, part, blocks, prefix, offset

    def in_text(self, at: int) -> int:
        """The place in the segment of a place in the line; private key blocks are one short lexeme in the line."""
        at += self.offset - self.prefix
        shift = 0
        for end_of_mark, _, end in self.blocks:
            if end_of_mark <= at:
                shift = end - end_of_mark
        return at + shift


def _lines(fields: list[str | None], everything: bool = False) -> tuple[list[_Line], list[list[tuple[str, str, int, int]]]]:
    """The lines of all fields that have a cue (or all, with ``everything``), and the parts of each field."""
    lines, parts = [], []
    for n, field in enumerate(fields):
        parts.append(_parts(field) if field else [])
        for k, (name, text, _, _) in enumerate(parts[n]):
            kept: list[tuple[int, str, int]] = []
            if "-----BEGIN " in text:
                shift = 0

                def keep(m: re.Match, kept: list[tuple[int, str, int]] = kept) -> str:
                    nonlocal shift
                    mark = f"\x00{'PRIVATE' if 'PRIVATE KEY' in m.group(0)[:60] else 'OTHER'}{len(kept)}\x00"
                    kept.append((m.start() + shift + len(mark), m.group(0), m.end()))
                    shift += len(mark) - len(m.group(0))
                    return mark

                text = _BLOCK.sub(keep, text.replace("\x00", " "))
            before, at = "", 0
            for number, line in enumerate(text.split("\n")):
                prefix, offset = 0, at
                at += len(line) + 1
                if number == 0 and name:
                    line, prefix = f"{name}: {line}", len(name) + 2
                if _NAME_ENDS.search(before) and _LONE_VALUE.match(line) and CUE.search(before):
                    prefix, offset = len(before.strip()) + 1, offset + len(line) - len(line.lstrip())
                    line = f"{before.strip()} {line.strip()}"
                if line.strip():
                    before = line
                if everything or "\x00" in line or CUE.search(line):
                    lines.append(_Line(line, n, k, kept, prefix, offset))
    return lines, parts


def _tagged(model: Tagger, lines: list[_Line]) -> Iterator[tuple[_Line, int, int]]:
    """(line, first, last + 1 lexeme) of each credential."""
    order = sorted(range(len(lines)), key=lambda i: len(lines[i].lexemes))
    for at in range(0, len(order), 512):  # lines of like length, so that padding stays small
        part = [lines[i] for i in order[at : at + 512]]
        for line, spans in zip(part, model.spans([x.lexemes for x in part]), strict=True):
            for a, b in spans:
                yield line, a, b


def find_in_fields(model: Tagger, fields: list[str | None], everything: bool = False) -> list[list[str]]:
    """The distinct credentials of each field. With ``everything`` lines without a cue are tagged as well."""
    found: list[list[str]] = [[] for _ in fields]
    for line, a, b in _tagged(model, _lines(fields, everything)[0]):
        value = re.sub(r"\x00[A-Z]+(\d+)\x00", lambda m: line.blocks[int(m.group(1))][1], "".join(line.lexemes[a:b]))  # noqa: B023
        if value not in found[line.owner]:
            found[line.owner].append(value)
    return found


def find_places(model: Tagger, fields: list[str | None]) -> list[list[tuple[int, int]]]:
    """[start, end) in the field of every credential, as written there, in order and without overlap."""
    lines, parts = _lines(fields)
    found: list[list[tuple[int, int]]] = [[] for _ in fields]
    written: dict[tuple[int, int], list[int]] = {}
    for line, a, b in _tagged(model, lines):
        start = sum(map(len, line.lexemes[:a]))
        end = start + sum(map(len, line.lexemes[a:b]))
        if end <= line.prefix:  # a name, or the line before, which is a line of its own
            continue
        x, y = line.in_text(max(start, line.prefix)), line.in_text(end)
        _, _, at, until = parts[line.owner][line.part]
        if until >= 0:
            key = (line.owner, line.part)
            if key not in written:
                written[key] = _written_at(fields[line.owner][at:until])
            x, y = at + written[key][x], at + written[key][y]
        found[line.owner].append((x, y))
    return [_apart(x) for x in found]


def _apart(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted(places):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(y, out[-1][1]))
        else:
            out.append((x, y))
    return out


def find_credentials(df: DataFrame, id_column: str = "id", columns: tuple[str, ...] = ("tool_input_json", "tool_response_summary"), training: int = 5000) -> DataFrame:
    """(id_column, field, secret) of every credential in the named columns."""
    model = df.sparkSession.sparkContext.broadcast(shared_tagger(df.sparkSession, training))
    schema = T.StructType([T.StructField(id_column, df.schema[id_column].dataType), T.StructField("field", T.StringType()), T.StructField("secret", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                owner, field, secret = [], [], []
                for k, name in enumerate(columns):
                    for i, values in enumerate(find_in_fields(model.value, part.column(k + 1).to_pylist())):
                        owner += [i] * len(values)
                        field += [name] * len(values)
                        secret += values
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), pa.array(field, pa.string()), pa.array(secret, pa.string())], names=schema.fieldNames())

    lowered = df.select(id_column, *columns, *[F.lower(c).alias(f"low_{c}") for c in columns])
    shown = [F.when(may_have_credentials(F.col(c), F.col(f"low_{c}")), F.col(c)).alias(c) for c in columns]
    # no filter on top: it would be pushed below and lower every field once for each search
    rows = lowered.select(id_column, *shown)
    return rows.mapInArrow(run, schema)


def mask_places(field: str, places: list[tuple[int, int]], mask: str = MASK) -> str:
    """The field with the given places masked; every other character stays."""
    for x, y in reversed(places):
        field = field[:x] + mask + field[y:]
    return field


def redact(df: DataFrame, columns: tuple[str, ...] = ("tool_input_json", "tool_response_summary"), training: int = 5000) -> DataFrame:
    """``df`` with the credentials in the named columns masked; all other characters stay."""
    model = df.sparkSession.sparkContext.broadcast(shared_tagger(df.sparkSession, training))

    @F.pandas_udf("string")
    def masked(values):  # noqa: ANN001, ANN202
        import pandas as pd

        texts = [v if isinstance(v, str) else None for v in values]
        return pd.Series([t if not places else mask_places(t, places) for t, places in zip(texts, find_places(model.value, texts), strict=True)])

    # a Python function runs on every row, whatever condition stands around it: fields without a cue go in as null
    shown = df.withColumns({f"_cue_{c}": may_have_credentials(F.col(c)) for c in columns})
    done = shown.withColumns({c: F.when(F.col(f"_cue_{c}"), masked(F.when(F.col(f"_cue_{c}"), F.col(c)))).otherwise(F.col(c)) for c in columns})
    return done.drop(*[f"_cue_{c}" for c in columns])


