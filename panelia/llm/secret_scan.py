"""Operator 8, secret scans: fixed patterns, and random strings shown by their token efficiency."""

import base64
import hashlib
import re

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelia.llm.common import table, text_or_empty

# Kinds in the order in which spans at one place are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same spans as runs of any length, then a filter

#: A candidate for the token test is a run of 16 characters or more, without the marks at its ends,
#: or a part of such a run (see Scanner.within).
CANDIDATE = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_=.-]{14,}[A-Za-z0-9]")
LEAST = 16
#: Random strings need more tokens than words do: fewer characters a token than this are suspect.
#: Runs that look like identifiers, and runs of under 20 characters, must be more suspect still:
#: the ratio of short words spreads more. Under 20 letters of one case nothing tells them apart.
CHARS_PER_TOKEN, OF_IDENTIFIERS, OF_SHORT_RUNS, SHORT = 2.1, 2.0, 1.9, 20
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
# Lengths of known digests in hexadecimal (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(r"(?:(?:md5|sha(?:1|224|256|384|512))[-=_])?(?:[0-9a-f]+|[0-9A-F]+)", re.A)
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Identifiers: words joined by _ - / or capitals, a number at most at the end of each. All repeats
#: are possessive: giving letters back never helps a match, and trying it takes exponential time.
IDENTIFIER = re.compile(r"[/_.-]*+(?:(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+)[0-9]{0,4}+[/_.-]*+)++=*+")
NUMBER = re.compile(r"[0-9/_=+.-]+")
#: Marks between the parts of a path, name or assignment; + belongs to Base64.
MARKS = re.compile(r"[/_.=-]+")
#: Shapes made of words and numbers: versions, dates, file names, book numbers.
PARTS = re.compile(r"(?:[A-Z]?[a-z]{1,19}+|[A-Z]{1,19}+|[0-9]++)(?:[/_.=+-]+(?:[A-Z]?[a-z]{1,19}+|[A-Z]{1,19}+|[0-9]++))*+")
TIME_MARK = re.compile(r"(?<=[0-9])T(?=[0-9])|(?<=[0-9])Z$|(?<![A-Za-z0-9])v(?=[0-9])")
#: Names that Kubernetes makes up: a name, a template hash and five characters.
POD = re.compile(r"(?:[a-z][a-z0-9]*-)+[a-z0-9]{8,10}-[bcdfghjklmnpqrstvwxz0-9]{5}")
#: A run in which this share of the neighbours differ by one step or none is an alphabet or a rule.
STEPS = 0.75


def excluded(run: str) -> bool:
    """Known digests, UUIDs and plain numbers are no secrets by their looks."""
    digest = DIGEST.fullmatch(run)
    if digest and len(re.split("[-=_]", run)[-1]) in DIGEST_LENGTHS:
        return True
    return bool(UUID.fullmatch(run) or NUMBER.fullmatch(run))


def shaped(run: str) -> bool:
    """Versions, dates, file names, pods and alphabets look like nothing but what they are."""
    if POD.fullmatch(run):
        return True
    steps = sum([abs(ord(x) - ord(y)) < 2 for x, y in zip(run, run[1:])])
    if steps >= STEPS * (len(run) - 1):
        return True
    return bool(MARKS.search(run) and PARTS.fullmatch(TIME_MARK.sub("-", run).strip("-")))


def least_ratio(run: str, chars_per_token: float) -> float:
    """Characters a token that a run must have to pass as no secret."""
    if len(run) < SHORT:
        return 0.0 if WORD.fullmatch(run) else min(chars_per_token, OF_SHORT_RUNS)
    return min(chars_per_token, OF_IDENTIFIERS) if IDENTIFIER.fullmatch(run) else chars_per_token


class Scanner:
    def __init__(self, ranks_path: str, pattern: str, chars_per_token: float):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = chars_per_token

    def base(self, text: str) -> list[tuple[int, int, str]]:
        found = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 16]
        found += [(*m.span(), "hex") for m in HEX.finditer(text)]
        return found

    def suspect(self, run: str) -> bool:
        if len(run) < LEAST or excluded(run) or shaped(run):
            return False
        return len(run) < least_ratio(run, self.limit) * len(self.encoding.encode_ordinary(run))

    def plain(self, part: str) -> bool:
        """A part of a path or name that is a word or a number."""
        if NUMBER.fullmatch(part):
            return True
        return 2 < len(part) < SHORT and bool(WORD.fullmatch(part)) or bool(IDENTIFIER.fullmatch(part)) and not self.suspect(part)

    def within(self, run: str) -> list[tuple[int, int]]:
        """Suspect places of a run: its parts between words and numbers, together where several
        stand side by side, else each by itself; if there are none, the whole run."""
        if shaped(run):
            return []
        known = UUID.search(run) is not None
        if known:
            run = UUID.sub(lambda m: "/" * len(m[0]), run)
        parts, at = [], 0
        for mark in MARKS.finditer(run):
            parts.append((at, mark.start()))
            at = mark.end()
        parts.append((at, len(run)))
        found, group = [], []
        for part in [*parts, None] if len(parts) > 1 else []:
            if part and not self.plain(run[part[0] : part[1]]):
                group.append(part)
                continue
            if group and self.suspect(run[group[0][0] : group[-1][1]]):
                found.append((group[0][0], group[-1][1]))
            else:
                found += [(a, b) for a, b in group if self.suspect(run[a:b])]
            group = []
        if found or known:
            return found
        return [(0, len(run))] if self.suspect(run) else []

    def random(self, text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Places outside the base spans, which come in order, of few characters a token."""
        found, at, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            while at < len(base) and base[at][0] < b:  # reach: how far those before b go
                reach = max(reach, base[at][1])
                at += 1
            if reach <= a:
                found += [(a + x, a + y, "random") for x, y in self.within(m[0])]
        return found

    def scan(self, text: str) -> tuple[list, list]:
        place = lambda s: (s[0], KINDS.index(s[2]), s[1])
        base = sorted(self.base(text), key=place)
        return base, sorted(base + self.random(text, base), key=place)


def listed(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


_LOADED: dict[tuple, Scanner] = {}


def loaded(*key) -> Scanner:
    if key not in _LOADED:
        _LOADED[key] = Scanner(*key)
    return _LOADED[key]


def secret_scan(docs: DataFrame, ranks_path: str, pattern: str, chars_per_token: float = CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row of ``docs``.

    Spans are kind:start:end in code points, by start and then by kind. Null and empty texts have
    no spans (the digest is that of the empty string). Repeated rows give repeated results; an
    empty table gives an empty one; other columns are not read. One pass, no shuffle. Runs are
    measured whole and by their parts, however long they are.
    """

    def run(batches):
        scanner = loaded(ranks_path, pattern, chars_per_token)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, spans = scanner.scan(value.as_py())
                kinds = [k for *_, k in spans]
                rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)))
            columns = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"],
            )

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return secret_scan(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
