"""Secret scan: wide candidate patterns, and a random forest that removes false positives.

Candidates are values of known public formats, values assigned to a name, and long runs
of letters and digits. The forest judges each by its length, the transitions between its
characters, how much of it a dictionary covers, the path of the document, and the words
around it. It is trained from labelled findings.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forest import Forest

#: Labelled findings that a forest is trained on, at most; of more, so many are taken by hash.
TRAIN_ROWS = 6000
#: Findings with a lower score are removed.
THRESHOLD = 0.5
#: A value of more characters that is no secret itself is searched for secrets inside.
LONG = 200
#: Characters on either side that count as neighbourhood.
AROUND = 60

#: Public formats of credentials.
FORMATS = {
    "aws_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "github_token": r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])",
    "slack_token": r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}(?![A-Za-z0-9-])",
    "google_key": r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])",
    "stripe_key": r"(?<![A-Za-z0-9])[rs]k_live_[A-Za-z0-9]{24,}(?![A-Za-z0-9])",
    "json_web_token": r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]{40,}-----END (?:[A-Z]+ )?PRIVATE KEY-----",
}
_HINTS = ("AKIA", "ASIA", "gh", "xox", "AIza", "k_live_", "eyJ", "-----BEGIN")
_ASSIGNED = re.compile(r"""[\w-]["']?[ \t]*(?::=|=>|[:=])[ \t]*["']?([^\s"'`,;<>]{6,})""")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")
#: Parameters and fields within a long value, which end where the next one begins.
_FIELD = re.compile(r"""[\w-][:=|]([^\s"'`,;<>&?#|:=]{8,}={0,2})""")
_FORMATS = {k: re.compile(p) for k, p in FORMATS.items()}
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Z]+(?![a-z])")
_SECRET_WORDS = frozenset("access api auth authorization bearer client credential credentials key login passphrase passwd password private pwd secret signing token".split())
_PLAIN_WORDS = frozenset("base blob build cache checksum chunk color commit digest etag example fingerprint guid hash id image integrity md5 object page parent placeholder resolved revision sample sha sha1 sha256 sha512 test trace tree uuid version".split())
_PATH_WORDS = ("test", "example", "sample", "fixture", "doc", "lock", "min", "vendor", "config", "env", "deploy", "src")
#: Words for coverage, besides those of the labelled findings' contexts.
_DICTIONARY = frozenset(
    """about above after again against application archive array author available balance banner before begin between
    branch button cache change channel class client column comment common company component config connect content
    context control copy count country create current custom data date default delete design detail device direct
    document domain download email empty enable error event example export feature field file filter first folder
    format forward frame function general global group handler header height history home image import index info
    input install interface item label language large last layout length level library license limit line link list
    load local logger login long main manager master member memory menu message method model module month name
    network node normal note number object option order output package page param parent password path pattern
    payment picture place platform player point policy position post power previous price primary print private
    process product profile project property public query question random range record region release remote report
    request resource response result return right role root route sample schema screen script search section select
    server service session setting shape share short simple single site size source space stack standard start state
    status string style submit subject success support switch system table target task template test text theme time
    title token total track transfer tree type under union unique update upload user valid value vector version view
    visit visible watch week width window word work world write year your""".split()
)


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str


def candidates(text: str) -> list[Candidate]:
    """Candidate spans of a text in order; where they overlap, a known format goes before an assigned value before a run."""
    found: list[Candidate] = []
    if any(h in text for h in _HINTS):
        found += [Candidate(m.start(), m.end(), kind) for kind, p in _FORMATS.items() for m in p.finditer(text)]
    if "=" in text or ":" in text:
        found += [Candidate(m.start(1), m.end(1), "assigned") for m in _ASSIGNED.finditer(text)]
    found += [Candidate(m.start(), m.end(), "run") for m in _RUN.finditer(text)]
    return _settled(found)


def inside(text: str, c: Candidate) -> list[Candidate]:
    """Candidate spans within a long one, in order: the values of its parameters, and runs; they don't overlap."""
    found = [Candidate(m.start(1), m.end(1), "assigned") for m in _FIELD.finditer(text, c.start, c.end)]
    found += [Candidate(m.start(), m.end(), "run") for m in _RUN.finditer(text, c.start, c.end)]
    return _settled([f for f in found if (f.start, f.end) != (c.start, c.end)])


def _settled(found: list[Candidate]) -> list[Candidate]:
    rank = {"assigned": 1, "run": 2}
    out: list[Candidate] = []
    for c in sorted(found, key=lambda c: (c.start, rank.get(c.kind, 0), -c.end)):
        if out and c.start < out[-1].end:
            if rank.get(c.kind, 0) < rank.get(out[-1].kind, 0):
                out[-1] = c
            continue
        out.append(c)
    return out


def _class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


_CLASSES = np.array([_class(chr(i)) for i in range(128)], np.uint8)
_LETTERS = np.array([i - 96 if 97 <= i <= 122 else 0 for i in range(128)], np.uint8)


def _looked_up(table: np.ndarray, value: str) -> np.ndarray:
    return table[np.minimum(np.frombuffer(value.encode("utf-32-le"), "<u4"), 127)]


class Features:
    """What the forest sees of a candidate; its bigram table and dictionary come from the training contexts."""

    def __init__(self, contexts: list[str]):
        words = [w.lower() for t in contexts for w in _WORD.findall(t)]
        self.dictionary = _DICTIONARY | {w for w in words if len(w) >= 4}
        pairs = np.ones((27, 27))
        for w in [*words, *sorted(_DICTIONARY)]:
            codes = [0, *(ord(c) - 96 for c in w if "a" <= c <= "z"), 0]
            for a, b in zip(codes, codes[1:]):
                pairs[a, b] += 1
        self.log = np.log(pairs / pairs.sum(axis=1, keepdims=True))

    def coverage(self, value: str) -> float:
        low, covered, at = value.lower(), 0, 0
        while at < len(low):
            hit = next((n for n in range(min(12, len(low) - at), 3, -1) if low[at : at + n] in self.dictionary), 0)
            covered += hit
            at += hit or 1
        return covered / max(1, len(low))

    def row(self, text: str, path: str | None, c: Candidate) -> list[float]:
        value = text[c.start : c.end]
        n = len(value)
        kinds = _looked_up(_CLASSES, value)
        counts = (np.bincount(kinds, minlength=4) / n).tolist()
        changes = np.count_nonzero(kinds[1:] != kinds[:-1]) / max(1, n - 1)
        codes = _looked_up(_LETTERS, value.lower())
        chain = float(np.mean(self.log[codes[:-1], codes[1:]])) if n > 1 else 0.0
        freq = np.array(list(Counter(value).values())) / n
        entropy = float(-(freq * np.log2(freq)).sum())
        left, right = text[max(0, c.start - AROUND) : c.start].lower(), text[c.end : c.end + AROUND].lower()
        before, after = re.findall(r"[a-z]+[0-9]*", left)[-5:], re.findall(r"[a-z]+[0-9]*", right)[:5]
        near = [w for b in before for w in ([b, *b.split("_")] if "_" in b else [b])]
        where = (path or "").lower()
        return [
            n,
            *counts,
            changes,
            chain,
            entropy,
            self.coverage(value),
            len(freq) / n,
            float(re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) is not None),
            float(re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value) is not None),
            float("://" in value or value.count("/") > 2),
            float(value.isdigit()),
            float(c.kind not in ("assigned", "run")),
            float(c.kind == "assigned"),
            float(any(s in w for w in near for s in _SECRET_WORDS)),
            float(bool(before) and any(s in before[-1] for s in _SECRET_WORDS)),
            float(any(w in _PLAIN_WORDS for w in near)),
            float(bool(before) and before[-1] in _PLAIN_WORDS),
            float(any(w in _SECRET_WORDS for w in after)),
            float(any(w in _PLAIN_WORDS for w in after)),
            *(float(p in where) for p in _PATH_WORDS),
        ]


def labelled_findings(n: int = 3000, seed: int = 11) -> list[tuple[str, str, int]]:
    """(text, path, label) of made-up findings: half are secrets in their contexts, half look like some and aren't.

    Each text holds one finding to learn from, the first candidate in it.
    """
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    words = sorted(_DICTIONARY)
    words += [w.capitalize() for w in words]
    syllables = ["an", "er", "in", "on", "th", "ed", "en", "ent", "ha", "re", "st", "ou", "ing", "ti", "le", "be", "sch", "que"]
    filler = lambda k: " ".join(r.choice(words) if r.random() < 0.5 else "".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))
    quote = lambda v: r.choice(['"{}"', "'{}'", "{}"]).format(v)
    sign = lambda: r.choice([" = ", "=", ": ", " := ", '": '])
    paths = ["src/app/config.py", "deploy/prod.env", "service/settings.yaml", "src/main/client.go", "notes.txt", "forum", "mirror", ""]
    plain_paths = ["tests/fixtures/data.json", "package-lock.json", "docs/example.md", "vendor/lib.min.js", "src/index.ts", "forum", "mirror", ""]
    out = []
    for _ in range(n // 2):
        value = r.choice(
            [
                lambda: some("0123456789abcdef", r.choice([32, 40, 48, 64])),
                lambda: some(low + up + dig, r.randint(16, 64)),
                lambda: some(low + up + dig + "+/", r.choice([40, 44, 64])) + r.choice(["", "="]),
                lambda: "AKIA" + some(up + dig, 16),
                lambda: "ghp_" + some(low + up + dig, 36),
                lambda: "AIza" + some(low + up + dig + "_-", 35),
                lambda: "sk_live_" + some(low + up + dig, 24),
                lambda: "xoxb-" + some(dig, 12) + "-" + some(low + up + dig, 24),
                lambda: some(low + up + dig + "!%^*_", r.randint(10, 20)),
                lambda: "".join(r.choices(syllables, k=r.randint(2, 3)))[:8] + some(dig + "!#", r.randint(1, 4)),
            ]
        )()
        name = r.choice(["token", "api_key", "apiKey", "secret", "password", "auth_token", "client_secret", "access_key", "SECRET_KEY", "db_password", "bearer", "private_key"])
        known = value[:4] in ("AKIA", "ghp_", "AIza", "sk_l", "xoxb")
        body = quote(value) if known and r.random() < 0.3 else name + sign() + quote(value)
        out.append((f"{filler(r.randint(0, 12))} {body} {filler(r.randint(0, 12))}", r.choice(paths), 1))
    for _ in range(n - n // 2):
        hexes = some("0123456789abcdef", r.choice([32, 40, 64]))
        text = r.choice(
            [
                lambda: f"{r.choice(['commit', 'sha1', 'md5', 'checksum', 'revision', 'tree', 'parent', 'etag', 'digest', 'blob'])}{r.choice([' ', ': ', ' = ', '='])}{quote(hexes)}",
                lambda: "integrity: sha512-" + some(low + up + dig + "+/", 86) + "==",
                lambda: r.choice(["uuid", "id", "guid", "trace"]) + sign() + quote("-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
                lambda: r.choice(["password", "token", "secret", "api_key"]) + sign() + quote(r.choice(["changeme", "your-token-here", "example_password", "xxxxxxxxxxxxxxxx", "placeholder1", "os.environ['TOKEN']", "${API_TOKEN}", "<password>", "process.env.SECRET", "get_password()", "1234567890123456"])),
                lambda: "".join(r.choices(words, k=r.randint(3, 6))) + str(r.randint(0, 99)),
                lambda: "_".join(r.choices(words, k=r.randint(3, 5))) + "_" + str(r.randint(0, 9)),
                lambda: r.choice(["name", "title", "path", "url", "color", "version", "page"]) + sign() + quote("/".join(r.choices(words, k=4)) + str(r.randint(0, 9))),
                lambda: "".join(r.choices(syllables, k=r.randint(8, 14))) + some(dig, 2),
                lambda: some(dig, r.randint(20, 30)),
                lambda: r.choice(words) + sign() + quote("".join(r.choices(syllables, k=r.randint(4, 8)))),
                lambda: r.choice(["", "mailto:", "contact: "]) + "".join(r.choices(syllables, k=r.randint(2, 4))) + r.choice(["", ".", "_"]) + some(dig, r.randint(0, 3)) + "@" + r.choice(words) + r.choice([".com", ".org", ".de", ".co.uk"]),
                lambda: r.choice(words) + sign() + quote(r.choice([r.choice(words), "".join(r.choices(syllables, k=3)), some(dig, r.randint(6, 8)), r.choice(words) + some(dig, 1)])),
                lambda: r.choice(["login", "key", "password", "access", "token"]) + r.choice([": ", " : "]) + r.choice([*words, "Bearer", "Basic", "Digest"]),
            ]
        )()
        out.append((f"{filler(r.randint(0, 12))} {text} {filler(r.randint(0, 12))}", r.choice(plain_paths), 0))
    r.shuffle(out)
    return out


def long_findings(n: int = 600, seed: int = 12) -> list[tuple[str, str, int]]:
    """Made-up findings like the others with values of over 100 characters, assigned and bare."""
    r = random.Random(seed)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    some = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    words = sorted(_DICTIONARY)
    filler = lambda k: " ".join(r.choices(words, k=k))
    quote = lambda v: r.choice(['"{}"', "'{}'", "{}"]).format(v)
    sign = lambda: r.choice([" = ", "=", ": ", " := ", '": '])
    size = lambda: round(100 * 20 ** r.random())
    names = ["aws_session_token", "session_token", "refresh_token", "access_token", "secret", "api_key", "client_secret", "private_key", "auth_token", "credentials"]
    paths = ["config/prod.env", "app/settings.py", "deploy/values.yaml", "main.go", "notes.txt", "index.html", "web/app.js", ""]
    out = []
    for k in range(n):
        value = some(r.choice([letters, letters + "+/", letters + "-_", "0123456789abcdef"]), size()) + r.choice(["", "", "=", "=="])
        phrase = "/".join(r.choices(words, k=size() // 7))
        text = (
            r.choice([lambda: r.choice(names) + sign() + quote(value), lambda: r.choice(names) + sign() + quote(value), lambda: r.choice(["bearer ", "token ", "key ", ""]) + value])
            if k % 2
            else r.choice(
                [
                    lambda: f"src{sign()}" + quote("data:image/png;base64," + value),
                    lambda: r.choice(["image", "integrity", "checksum", "digest", "blob", "fingerprint"]) + sign() + quote(value),
                    lambda: r.choice(["url", "path", "link"]) + sign() + quote(f"https://{r.choice(words)}.org/{phrase}?page={r.randint(1, 99)}"),
                    lambda: phrase + str(r.randint(0, 99)),
                    lambda: r.choice(words) + sign() + quote(phrase.replace("/", r.choice("-_.&"))),
                    lambda: r.choice("=-_") * size() + str(r.randint(0, 9)),
                    lambda: some("0123456789", size()),
                    lambda: r.choice(["path", "url", "link", "next"]) + sign() + quote("https://" + ".".join(r.choices(words, k=2)) + "/" + "&".join(f"{w}={r.choice(words)}{r.randint(0, 9)}" for w in r.choices(words, k=12))),
                ]
            )
        )()
        out.append((f"{filler(r.randint(0, 12))} {text} {filler(r.randint(0, 12))}", r.choice(paths), k % 2))
    return out


class Judge:
    """Features and forest, trained from (text, path, label) rows; texts without a candidate teach nothing."""

    def __init__(self, rows: list[tuple[str, str, int]], **how):
        self.features = Features([t for t, _, y in rows if not y])
        known = [(t, p, c[0], y) for t, p, y in rows if (c := candidates(t))]
        x = np.array([self.features.row(t, p, c) for t, p, c, _ in known])
        self.forest = Forest(x, np.array([y for *_, y in known]), **how)

    def scores(self, text: str, path: str | None, found: list[Candidate]) -> np.ndarray:
        return self.forest.score(np.array([self.features.row(text, path, c) for c in found]))

    def secrets(self, text: str, path: str | None, threshold: float) -> list[tuple[Candidate, float]]:
        """The candidates of a text that score as secrets, with their scores; those inside a long candidate only where it is none."""
        out = []
        if found := candidates(text):
            for c, score in zip(found, self.scores(text, path, found)):
                if score >= threshold:
                    out.append((c, float(score)))
                elif c.end - c.start > LONG and (parts := inside(text, c)):
                    out += [(p, float(s)) for p, s in zip(parts, self.scores(text, path, parts)) if s >= threshold]
        return out


def train(findings: DataFrame | None = None, rows: int = TRAIN_ROWS, **how) -> Judge:
    """A judge from labelled ``findings`` (text, path, label), of which at most ``rows`` by hash order; without any, from made-up ones."""
    if findings is None:
        return Judge(labelled_findings() + long_findings(), **how)
    picked = findings.filter("text is not null and label is not null").select("text", "path", F.col("label").cast("int")).orderBy(F.xxhash64("text", "label")).limit(rows)
    return Judge([(r[0], r[1] or "", r[2]) for r in picked.collect()], **how)


def scan(docs: DataFrame, judge: Judge | None = None, path: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, end, kind, score and secret_sha256 of each secret in each row of ``docs`` (doc_id, text).

    ``start`` and ``end`` count characters, whatever a value's length; ``path`` names a
    column whose value helps to judge. Null and empty texts have no findings, null paths
    no say; repeated rows give repeated findings; texts of any length are read whole. An
    empty table gives no rows, and other columns are ignored. The secret itself is not
    returned, only its SHA-256.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(judge or train())  # a fixed number of trees of bounded depth
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.col(f"`{path}`").cast("string") if path else F.lit(None).cast("string")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            out = []
            for doc_id, text, where in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "path"))):
                for c, s in judge.secrets(text or "", where, threshold):
                    out.append((doc_id, c.start, c.end, c.kind, round(s, 6), hashlib.sha256(text[c.start : c.end].encode()).hexdigest()))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "end", "kind", "score", "secret_sha256"])

    return source.mapInArrow(run, "doc_id long, start int, end int, kind string, score double, secret_sha256 string")
