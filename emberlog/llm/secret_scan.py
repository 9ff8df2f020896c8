"""Operator 8: secret scans with a random forest against false positives.

Candidates are runs of key-like characters, values that are assigned to a name,
the parts of both between separators (an address's, say), keys of known prefixes
and blocks between BEGIN and END lines.  They may overlap; a forest grown here from labelled
findings scores each, and what it accepts is joined where it overlaps.  Its
inputs are, over the whole candidate, the length, the transitions between kinds
of characters and their entropy, how much of it the dictionary covers, whether
it looks like a path, an address or a placeholder, and the words around it.

``labelled_findings`` makes the findings from a rule (a seed and a number are its
parameters): keys in assignments and in addresses, against checksums, identifiers, paths,
addresses (those around a key, too) and their parts, long words, numbers and
placeholders, and blocks of private keys against certificates, public keys and
mentions.

Null and empty texts have no candidates; very long ones are scanned whole, and
very long candidates described whole.  Positions count code points.  Equal
candidates in one text are findings each; a score equal to the threshold is a secret.  Repeated rows each return a row, an
empty table none; other columns stay in :func:`redact` and are ignored elsewhere.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .word_table import worker_table

FINDINGS = 4000
SEED = 7
TREES, DEPTH, LEAF = 31, 9, 4
THRESHOLD = 0.5
CONTEXT = 40
MASK = "[SECRET]"
#: Names that announce secrets, names that announce other codes, and common words.
SECRET_NAMES = "secret token password passwd pwd apikey api_key api-key access_key auth authorization bearer credential credentials private_key client_secret signing_key passphrase".split()
OTHER_NAMES = "sha sha1 sha256 md5 checksum digest commit revision etag uuid guid hash id ref version build image path file url href src integrity".split()
PRIVATE_BLOCKS = ["RSA PRIVATE KEY", "EC PRIVATE KEY", "DSA PRIVATE KEY", "PRIVATE KEY", "ENCRYPTED PRIVATE KEY", "OPENSSH PRIVATE KEY", "PGP PRIVATE KEY BLOCK"]
PUBLIC_BLOCKS = ["CERTIFICATE", "PUBLIC KEY", "RSA PUBLIC KEY", "CERTIFICATE REQUEST", "PGP PUBLIC KEY BLOCK", "PGP SIGNATURE"]
WORDS = (
    "about account action after also application back because been before build call change check class client code config content data date default delete "
    "device document domain download each email error event example file first folder form from function get group have header home host image index "
    "info input item just key language last like line link list local login main make manager message method model more most name network new next note "
    "number object only open option order other output over page param part password path people place print process product project public query read "
    "report request response result return right root route sample save script search secret section server service session set settings show site size "
    "some source start state status step store string style system table tag template test text than that their then there these they this time title token "
    "tool type update upload user value version view was web what when which will with word work world would write year your ment tion ing the and for"
).split()

_RUN = re.compile(r"[A-Za-z0-9+/_=.\-]{16,}")
_ASSIGNED = re.compile(r"""[:=]\s{0,3}["']?([^\s"',;<>]{8,})""")
_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,60})-----")
_END = re.compile(r"-----END [A-Z0-9 ]{1,60}-----")
#: A block's header lines and, one at a time, its lines of base64; line ends may be written as escapes.
_BREAK = r"[ \t>]*(?:\r?\n|(?:\\r)?\\n)"
_HEADERS = re.compile(rf"(?:{_BREAK}[ \t>]*[A-Za-z\-]+: [^\n\\]*)*")
_BODY = re.compile(rf"(?:{_BREAK})*[ \t>]*([A-Za-z0-9+/=]{{40,}}|[A-Za-z0-9+/=]+(?=[ \t\r]*(?:\n|\\[nr]|\Z|[\"'<,;])))")
#: Separators, coarse to fine: parameters, names and values, all others.
_PARTS = [re.compile(rf"[^{c}]{{8,}}") for c in ("?&#", "?&#=", r"?&#=/:@()\[\]{}|\\`")]
_PREFIX = r"(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk[-_]|pk[-_]|eyJ|glpat-|npm_)"
_KNOWN = re.compile(rf"(?<![A-Za-z0-9]){_PREFIX}[A-Za-z0-9_.\-]{{12,}}")
_STARTS = re.compile(_PREFIX)
_DICTIONARY = re.compile("|".join(sorted(map(re.escape, (w for w in WORDS if len(w) > 2)), key=len, reverse=True)), re.IGNORECASE)
_NO_LETTER = re.compile("[^A-Za-z]")
_NEAR = re.compile(r"[a-z0-9_\-]+")
_UUID = re.compile(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", re.IGNORECASE)
_PLACEHOLDER = re.compile(r"example|your[_-]|placeholder|changeme|dummy|x{4,}|\.\.\.|<|\$\{|0{6,}|12345678", re.IGNORECASE)


def blocks(text: str) -> list[tuple[int, int, float]]:
    """(start, end, kind) of BEGIN blocks, ascending and apart; one without END ends with its lines of base64.

    The kind is 1 for a private key in lines of base64, 0.5 for what else is between a private key's lines, -1 for other blocks.
    """
    begins = list(_BEGIN.finditer(text)) if "-----BEGIN" in text else []
    out = []
    for k, m in enumerate(begins):
        close = _END.search(text, m.end(), begins[k + 1].start() if k + 1 < len(begins) else len(text))
        end, width = _HEADERS.match(text, m.end()).end(), 0
        while line := _BODY.match(text, end, close.start() if close else len(text)):
            end = line.end()
            if not close and len(line[1]) < width:
                break
            width = max(width, len(line[1]))
        whole = width > 0 and not (close and text[end : close.start()].replace("\\r", "").replace("\\n", "").strip(" \t\r\n>"))
        out.append((m.start(), close.end() if close else end, -1.0 if "PRIVATE KEY" not in m[1] else 1.0 if whole else 0.5))
    return out


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of candidates, ascending; they may overlap."""
    found = {(start, end) for start, end, _ in blocks(text)}
    for m in _RUN.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] in ".-_":
            end -= 1
        run = text[start:end]
        if end - start >= 16 and (any(c.isdigit() for c in run) or any(c in "+/_=" for c in run)):
            found.update(_parts(text, start, end))
            name, sign, value = run.partition("=")
            if sign and value.strip("=") and name.replace("_", "").replace("-", "").isalpha():
                start += len(name) + 1
            found.add((start, end))
    for m in _ASSIGNED.finditer(text):
        start, end = m.span(1)
        while end > start and text[end - 1] in ".)]}":
            end -= 1
        if _NO_LETTER.search(text, start, end):
            found.add((start, end))
            found.update(_parts(text, start, end))
    found.update(m.span() for m in _KNOWN.finditer(text))
    return sorted((start, end) for start, end in found if end - start >= 8)


def _parts(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """What lies between separators of each grade, with a character that is no letter."""
    for part in _PARTS:
        for m in part.finditer(text, start, end):
            if m.span() != (start, end) and _NO_LETTER.search(m.group()):
                yield m.span()


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


NAMES = ("length", "changes", "entropy", "digits", "upper", "marks", "hex", "dictionary", "longest_letters", "vowels", "slashes", "dots", "uuid", "placeholder", "block", "secret_name", "other_name", "assigned", "quoted", "url", "padding", "prefix")


def describe(text: str, start: int, end: int, around: list[tuple[int, int, float]] | None = None) -> list[float]:
    """The forest's inputs for one candidate, in the order of ``NAMES``; ``around`` are the text's blocks.

    ``block`` is the kind of the block that the candidate is or lies in, else 0.  All but length and neighbourhood
    of a block are those of what its BEGIN and END lines enclose.
    """
    around = blocks(text) if around is None else around
    at = bisect.bisect_right(around, start, key=lambda b: b[0]) - 1
    block = around[at][2] if at >= 0 and end <= around[at][1] else 0.0
    value = text[start:end]
    if block and (start, end) == around[at][:2]:
        value = _END.sub("", value[_BEGIN.match(value).end() :]).strip().removeprefix("\\n").removesuffix("\\n")
    n = max(len(value), 1)
    kinds = list(map(_kind, value))
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    letters = re.findall("[A-Za-z]+", value)
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    near = _NEAR.findall(before.lower())[-4:]
    covered = sum(len(m.group()) for m in _DICTIONARY.finditer(value))
    named = lambda names: float(any(x in w.replace("-", "_").split("_") or x == w for w in near for x in names))
    return [
        float(end - start),
        sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n,
        entropy,
        kinds.count(2) / n,
        kinds.count(1) / n,
        kinds.count(3) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)),
        covered / n,
        max(map(len, letters), default=0) / n,
        sum(c in "aeiouAEIOU" for c in value) / n,
        float(value.count("/")),
        float(value.count(".")),
        float(bool(_UUID.match(value))),
        float(bool(_PLACEHOLDER.search(value))),
        block,
        named(SECRET_NAMES),
        named(OTHER_NAMES),
        float(bool(re.search(r"[:=]\s*[\"']?$", before))),
        float(before[-1:] in ("'", '"') and after[:1] in ("'", '"')),
        float("://" in before[-30:] + value or "www." in value or "@" in value),
        float(value.endswith("=")),
        float(bool(_STARTS.match(value))),
    ]


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, 1 for a secret) of findings made by rule."""
    r = np.random.default_rng(seed)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    chars = lambda alphabet, k: "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    hexes, mixed = digits + "abcdef", low + low.upper() + digits
    syllables = "the er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    words = lambda k: " ".join("".join(pick(syllables) for _ in range(int(r.integers(1, 5)))) for _ in range(k))

    def secret_value() -> str:
        return pick([lambda: chars(hexes, pick([32, 40, 48, 64])), lambda: chars(mixed, int(r.integers(20, 64))), lambda: chars(mixed + "+/", pick([43, 86])) + "=", lambda: "AKIA" + chars(low.upper() + digits, 16), lambda: pick(["ghp_", "gho_", "npm_", "sk-", "sk_live_", "glpat-"]) + chars(mixed, 36), lambda: "eyJ" + chars(mixed, 30) + "." + chars(mixed, 50) + "." + chars(mixed, 43), lambda: chars(low + digits, int(r.integers(5, 10))) + pick("!$%&#@") + chars(mixed, 4)])()

    def block(kind: str) -> str:
        shortest, most = pick([(3, 12), (3, 60), (100, 1000), (1000, 2400)])
        body = chars(mixed + "+/" if most > 60 else pick([low, low.upper(), mixed, hexes]), int(r.integers(shortest, most)))
        lines = [body[i : i + 64] for i in range(0, len(body), 64)]
        if r.random() < 0.15 and "PRIVATE" in kind:
            lines = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + chars(hexes.upper(), 32), "", *lines]
        return pick(["\n", "\n", "\\n", '\\n" +\n  "']).join([f"-----BEGIN {kind}-----", *lines, *([f"-----END {kind}-----"] if r.random() < 0.8 else [])])

    def line_of(whole: str) -> tuple[str, str, str]:
        lines = [m.span() for m in re.finditer(r"(?<![^\n])[A-Za-z0-9+/=]{16,}(?![^\n])", whole)]
        start, end = pick(lines) if lines else (0, len(whole))
        return whole[:start], whole[start:end], whole[end:]

    def framed(whole: str) -> tuple[str, str, str]:
        """A block or a line of it, in a text."""
        before, value, after = line_of(whole) if r.random() < 0.3 else ("", whole, "")
        return words(3) + pick(["\n", " ", ": "]) + before, value, after + "\n" + words(3)

    def secret() -> tuple[str, str, str]:
        if r.random() < 0.2:
            return framed(block(pick(PRIVATE_BLOCKS)))
        value = secret_value()
        if r.random() < 0.2:
            before, after = address()
            return before, value, after
        known = re.match(r"AKIA|gh[po]_|npm_|sk|glpat|eyJ", value)
        name = pick(SECRET_NAMES) if not known or r.random() < 0.6 else ""
        if not name:
            return words(3) + " ", value, " " + words(3)
        if r.random() < 0.4:
            name = pick(["", "my_", "app_", "AWS_", "db-"]) + (name.upper() if r.random() < 0.5 else name)
        sign = pick([" = ", "=", ": ", " := ", ' : '])
        quote = pick(['"', "'", ""])
        return f"{words(3)} {name}{sign}{quote}", value, f"{quote} {words(3)}"

    def address() -> tuple[str, str]:
        """What stands before and after a key inside an address."""
        host = pick(["www.", "api.", "db.", ""]) + pick(WORDS) + pick([".com", ".org", ".example.com", ":5432", ""])
        if r.random() < 0.4:
            return f"{words(3)} {pick(['', 'url=', 'dsn: '])}{pick(['postgres', 'mysql', 'https', 'redis', 'amqp'])}://{pick(WORDS)}:", f"@{host}/{pick(WORDS)} {words(3)}"
        name = pick(SECRET_NAMES) if r.random() < 0.8 else "access_token"
        path = "/".join(pick([pick(WORDS), "v1", chars(digits, 4)]) for _ in range(int(r.integers(1, 4))))
        return f"{words(3)} {pick(['', 'url: ', 'GET='])}{pick(['http', 'https'])}://{host}/{path}?{pick(['', pick(WORDS) + '=' + chars(digits, 3) + '&'])}{name}=", f"{pick(['', '&' + pick(WORDS) + '=' + words(1)])} {words(3)}"

    def other() -> tuple[str, str, str]:
        shape = int(r.integers(17))
        before, after = words(3) + " ", " " + words(3)
        if shape == 0:
            return f"{before}{pick(OTHER_NAMES)}{pick([': ', '=', ' '])}", chars(hexes, pick([32, 40, 64])), after
        if shape == 1:
            return before + pick(["", "id: ", "uuid="]), "-".join(chars(hexes, k) for k in (8, 4, 4, 4, 12)), after
        if shape == 2:
            return before, "/".join(pick([pick(WORDS), words(1)]) for _ in range(int(r.integers(3, 7)))) + pick([".py", ".html", "", ".txt", str(int(r.integers(99)))]), after
        if shape == 3:
            return before + pick(["http://", "https://"]), "www." + pick(WORDS) + ".com/" + "/".join(pick([pick(WORDS), chars(digits, 4), chars(mixed, 11)]) for _ in range(3)), after
        if shape == 4:
            return before, "-".join(pick([pick(WORDS), chars(digits, 2), words(1)]) for _ in range(int(r.integers(4, 8)))), after
        if shape == 5:
            return f"{before}{pick(SECRET_NAMES)}{pick(['=', ': ', ' = '])}", pick(["your_api_key_here", "EXAMPLE_TOKEN_1234", "changeme_12345678", "xxxxxxxxxxxxxxxx1", "<insert-token-1>", "${SECRET_TOKEN_1}", "placeholder_0001", "0000000000000000"]), after
        if shape == 6:
            return before, chars(digits, int(r.integers(16, 24))), after
        if shape == 7:
            return before, "_".join(pick(WORDS) for _ in range(int(r.integers(3, 6)))) + pick(["", "_1", "_v2", "()"]), after
        if shape == 8:
            return before, chars(digits, 2) + "@mail" + chars(digits, 1) + ".example.com", after
        if shape == 10:  # an address around a key is not the key
            left, right = address()
            left, right = left.rpartition(" "), right.partition(" ")
            start = pick([0, left[2].find("://") + 1, max(left[2].rfind("?"), left[2].rfind("&")) + 1])
            return left[0] + " " + left[2][:start], left[2][start:] + secret_value() + right[0], " " + right[2]
        if shape == 13:
            return framed(block(pick(PUBLIC_BLOCKS)))
        if shape == 14:  # blocks that are only spoken of
            kind = pick(PRIVATE_BLOCKS)
            return before, pick([f"-----BEGIN {kind}-----", f"-----BEGIN {kind}----- {words(int(r.integers(2, 40)))} -----END {kind}-----", f"-----BEGIN {kind}-----\n...\n-----END {kind}-----"]), after
        if shape in (11, 12, 15, 16):  # parts of addresses
            part = pick([chars(mixed, 11), chars(digits, int(r.integers(8, 14))), pick(WORDS) + "-" + pick(WORDS) + "-" + chars(digits, 2), "_".join(pick(WORDS) for _ in range(3)), pick(WORDS) + ".example.com", "www." + pick(WORDS) + ".com", chars(hexes, pick([32, 40])), "2024-01-02"])
            lead = f"{pick(['http', 'https'])}://www.{pick(WORDS)}.com/{pick(WORDS)}" if "." not in part else pick(["http", "https"]) + ":/"
            lead += pick(["/", f"/{chars(digits, 3)}/", f"?{pick(OTHER_NAMES)}=", f"?{pick(['v', 'q', 'page', 'utm_source'])}="]) if "." not in part else "/"
            if r.random() < 0.4:
                lead, mark, name = lead.rpartition("?")
                lead, part = (lead + mark, name + part) if mark else (name, part)
            return before + lead, part, pick(["", "/" + pick(WORDS), "&" + pick(WORDS) + "=1"]) + after
        return before + pick(["value = ", "result: ", "name=", "time: ", "size = "]), pick([words(1) + chars(digits, 2), chars(digits, 9), "2024-01-02T03:04:05", pick(WORDS) + "-" + pick(WORDS) + "-" + chars(digits, 1)]), after

    x, y = [], []
    for k in range(n):
        before, value, after = secret() if k % 2 else other()
        text = before + value + after
        x.append(describe(text, len(before), len(before) + len(value)))
        y.append(k % 2)
    return np.array(x), np.array(y)


class Forest:
    """Classification trees on bootstrap samples, a random third of the inputs at each split, by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED):
        self.r, self.depth, self.leaf = np.random.default_rng(seed), depth, leaf
        self.trees = []
        for _ in range(trees):
            own = self.r.integers(0, len(x), len(x))
            nodes: list[tuple[int, float, int, int, float]] = []
            self._grow(x[own], y[own], 0, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))

    def _grow(self, x: np.ndarray, y: np.ndarray, level: int, nodes: list) -> int:
        at, share = len(nodes), float(y.mean())
        nodes.append((-1, 0.0, at, at, share))
        if level == self.depth or len(y) < 2 * self.leaf or share in (0.0, 1.0):
            return at
        best, split = share * (1 - share) * len(y) - 1e-9, None
        for f in self.r.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            k = np.arange(1, len(y))
            ok = (v[1:] > v[:-1]) & (k >= self.leaf) & (len(y) - k >= self.leaf)
            if not ok.any():
                continue
            left = ones[:-1]
            right = ones[-1] - left
            cost = np.where(ok, left * (1 - left / k) + right * (1 - right / (len(y) - k)), np.inf)
            if cost.min() < best:
                i = int(cost.argmin())
                best, split = cost[i], (int(f), float((v[i] + v[i + 1]) / 2))
        if split is None:
            return at
        f, cut = split
        below = x[:, f] <= cut
        left = self._grow(x[below], y[below], level + 1, nodes)
        right = self._grow(x[~below], y[~below], level + 1, nodes)
        nodes[at] = (f, cut, left, right, share)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets in the leaves."""
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                at = np.where(inner, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def fit(n: int = FINDINGS, seed: int = SEED) -> Forest:
    return Forest(*labelled_findings(n, seed), seed=seed)


def scan_texts(texts: list[str], forest: Forest, threshold: float = THRESHOLD) -> list[list[tuple[int, int, float, bool]]]:
    """Per text, (start, end, score, whether it is a secret) of each candidate."""
    spans = [candidates(t) for t in texts]
    inputs = [describe(t, *s, around) for t, own in zip(texts, spans, strict=True) for around in [blocks(t)] for s in own]
    scores = iter(forest.score(np.array(inputs)).tolist() if inputs else [])
    return [[(*s, p := next(scores), p >= threshold) for s in own] for own in spans]


def joined(own: list[tuple[int, int, float, bool]]) -> list[tuple[int, int]]:
    """(start, end) of one text's secrets, ascending and apart; those that overlap are one."""
    out: list[tuple[int, int]] = []
    for start, end, _, secret in own:
        if not secret:
            continue
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _scanned(docs: DataFrame, forest: Forest, columns: list[str], schema: str, names: list[str], rows) -> DataFrame:
    shared, version = docs.sparkSession.sparkContext.broadcast(forest), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = worker_table(("secrets",), lambda: shared.value, version)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(0).to_pylist()
                found = scan_texts([t or "" for t in texts], forest)
                own = rows(texts, found)
                yield pa.RecordBatch.from_arrays([*own, *part.columns[1:]], names=[*names, *columns])

    return docs.mapInArrow(run, schema)


def findings(docs: DataFrame, forest: Forest) -> DataFrame:
    """Per row of ``docs``: doc_id, n_candidates, n_secrets, has_secret, secrets (list of start and end), spans_sha256."""

    def rows(texts: list, found: list) -> list[pa.Array]:
        kept = [joined(own) for own in found]
        digest = [hashlib.sha256(" ".join(f"{s}-{e}" for s, e in k).encode()).hexdigest() for k in kept]
        spans = pa.array([[{"start": s, "end": e} for s, e in k] for k in kept], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        return [pa.array([len(o) for o in found], pa.int64()), pa.array([len(k) for k in kept], pa.int64()), spans, pa.array(digest, pa.string())]

    schema = "n_candidates long, n_secrets long, secrets array<struct<start: long, end: long>>, spans_sha256 string, doc_id long"
    out = _scanned(docs.select("text", "doc_id"), forest, ["doc_id"], schema, ["n_candidates", "n_secrets", "secrets", "spans_sha256"], rows)
    return out.select("doc_id", "n_candidates", "n_secrets", (F.col("n_secrets") > 0).alias("has_secret"), "secrets", "spans_sha256")


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by a mask, and ``n_chars``, if there, counted anew; all columns stay."""

    def rows(texts: list, found: list) -> list[pa.Array]:
        out = []
        for text, own in zip(texts, found, strict=True):
            for start, end in reversed(joined(own)):
                text = text[:start] + MASK + text[end:]
            out.append(text)
        return [pa.array(out, pa.string())]

    rest = [c for c in docs.columns if c != "text"]
    ordered = docs.select("text", *rest)
    clean = _scanned(ordered, forest, rest, ordered.schema, ["text"], rows)
    if "n_chars" in rest:
        kind = docs.schema["n_chars"].dataType
        changed = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
        clean = clean.withColumn("n_chars", F.when(changed, F.char_length("text")).otherwise(F.col("n_chars")).cast(kind))
    return clean.select(*docs.columns)
