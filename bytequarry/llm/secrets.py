"""Secret scan with a trigram inverted index.

Every rule's regular expression is turned into a Boolean query over trigrams that each match must contain. The
trigrams of a block of documents are indexed, the queries are answered by intersecting and uniting postings, and the
candidates are verified with the rule itself. A rule without mandatory trigrams scans every document.

Defined cases: a null text counts as empty; an empty text has no spans and the digest of the empty string; repeated rows
each get their own result; an empty table has no rows; further columns are left out, whatever their names. A very long text
is scanned whole, its trigrams in slices.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import common

try:
    from re import _parser as sre
except ImportError:  # Python < 3.11
    import sre_parse as sre


@dataclass(frozen=True)
class Rule:
    """A kind of secret. Matches whose measured group is shorter than `shortest` are dropped after matching."""

    kind: str
    pattern: str
    shortest: int = 0
    group: int = 0
    any_case: bool = False

    def compiled(self) -> re.Pattern[str]:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]+", 16),
)
EXTRA = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"authorization: bearer [A-Za-z0-9._~+/-]{16,}", any_case=True),
)
RULES = BASE + EXTRA

#: Alternatives tracked at once while literals are enumerated; beyond that a rule's query is merely weaker.
MOST_ALTERNATIVES = 64
#: Bytes whose trigrams are looked up at once.
SLICE = 4_000_000


def trigram_query(pattern: str) -> list[list[frozenset[bytes]]]:
    """Clauses that all must hold; a clause is a list of alternatives, each a set of trigrams (lower case) that occur together."""
    clauses: list[list[frozenset[bytes]]] = []

    def flush(run: set[str]) -> set[str]:
        grams = [frozenset(b[i : i + 3] for i in range(len(b) - 2)) for x in run if (b := x.encode().lower()) is not None]
        if grams and all(grams):
            clauses.append(grams)
        return {""}

    def literal(node) -> set[str] | None:
        """The strings that a node can match, if they are few."""
        op, arg = node
        name = str(op)
        if name == "LITERAL":
            return {chr(arg)}
        if name == "IN":
            out = {chr(a) for o, a in arg if str(o) == "LITERAL"}
            return out if len(out) == len(arg) and len(out) <= 6 else None
        if name == "SUBPATTERN":
            return strings(arg[3])
        if name == "BRANCH":
            parts = [strings(x) for x in arg[1]]
            return None if None in parts else set().union(*parts)
        if name == "MAX_REPEAT" and arg[1] <= 2 and (inner := strings(arg[2])) is not None:
            return {"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(inner, n)}
        return None

    def product(inner: set[str], n: int):
        if not n:
            return [()]
        return [(a, *rest) for a in inner for rest in product(inner, n - 1)]

    def strings(nodes) -> set[str] | None:
        out = {""}
        for x in nodes:
            if (got := literal(x)) is None or len(out) * len(got) > MOST_ALTERNATIVES:
                return None
            out = {a + b for a in out for b in got}
        return out

    run = {""}
    for node in sre.parse(pattern):
        got = literal(node)
        if got is not None and len(run) * len(got) <= MOST_ALTERNATIVES:
            run = {a + b for a in run for b in got}
            continue
        run = flush(run)
        if got is not None:
            run = got
    flush(run)
    return clauses


class Scanner:
    """Rules, their queries, and the table that marks the trigrams any query asks for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.compiled = [r.compiled() for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        wanted = sorted({g for q in self.queries for clause in q for alt in clause for g in alt})
        self.number = {g: k + 1 for k, g in enumerate(wanted)}
        self.mark = np.zeros(1 << 24, np.uint16)
        for g, k in self.number.items():
            self.mark[g[0] << 16 | g[1] << 8 | g[2]] = k

    def postings(self, texts: list[str]) -> dict[int, np.ndarray]:
        """Trigram number to the sorted documents that hold it. Bytes are looked up in slices of SLICE."""
        raw = [x.encode(errors="surrogatepass").lower() for x in texts]
        ends = np.cumsum([len(x) + 2 for x in raw])
        body = np.frombuffer(b"\0\0".join(raw), np.uint8)
        if len(body) < 3 or not self.number:
            return {}
        found = []
        for start in range(0, len(body) - 2, SLICE):
            b = body[start : start + SLICE + 2].astype(np.int32)
            code = self.mark[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
            at = np.flatnonzero(code)
            found.append(np.unique(code[at].astype(np.int64) << 32 | np.searchsorted(ends, at + start, side="right")))
        pairs = np.unique(np.concatenate(found))
        gram, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cut = np.flatnonzero(np.diff(gram)) + 1
        return {int(g[0]): d for g, d in zip(np.split(gram, cut), np.split(doc, cut), strict=True) if len(g)}

    def candidates(self, k: int, postings: dict[int, np.ndarray], n: int) -> np.ndarray:
        """Documents that satisfy the query of rule k; all of them if it has none."""
        none = np.empty(0, np.int64)
        found = None
        for clause in self.queries[k]:
            some = none
            for alt in clause:
                both = None
                for g in sorted(alt, key=lambda g: len(postings.get(self.number[g], none))):
                    p = postings.get(self.number[g], none)
                    both = p if both is None else np.intersect1d(both, p, assume_unique=True)
                    if not len(both):
                        break
                some = np.union1d(some, both)
            found = some if found is None else np.intersect1d(found, some, assume_unique=True)
        return np.arange(n) if found is None else found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each document's secrets, ordered."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        postings = self.postings(texts)
        for k, (rule, pattern) in enumerate(zip(self.rules, self.compiled, strict=True)):
            least, g = rule.shortest, rule.group
            for i in self.candidates(k, postings, len(texts)).tolist():
                for m in pattern.finditer(texts[i]):
                    if m.end(g) - m.start(g) >= least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


class HexFirst(Scanner):
    """A run of a repeated class with a least length is found at once by asking for that length in the pattern.

    `X+` kept if long enough and `X{n,}` have the same leftmost matches when X is one class: both are maximal runs.
    """

    def __init__(self, rules: tuple[Rule, ...]):
        super().__init__(rules)
        for k, r in enumerate(rules):
            if re.fullmatch(r"\[[^\]]+\]\+", r.pattern) and not r.group:
                self.compiled[k] = re.compile(f"{r.pattern[:-1]}{{{max(1, r.shortest)},}}", self.compiled[k].flags & ~re.UNICODE)


@lru_cache(4)
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return HexFirst(rules)


def find_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and `secrets`, an array of (kind, start, end, value), by start and then the rules' order. Offsets count code points."""

    def work(texts: list[str]) -> dict[str, object]:
        found = scanner(rules).scan(texts)
        return {"secrets": [[{"kind": rules[k].kind, "start": s, "end": e, "value": x[s:e]} for s, k, e in spans] for x, spans in zip(texts, found, strict=True)]}

    import pyarrow as pa

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))
    return common.map_blocks(df, "secrets array<struct<kind: string, start: bigint, end: bigint, value: string>>", lambda x: {"secrets": pa.array(work(x)["secrets"], kind)}, doc_id, text)


def secret_digests(df: DataFrame, rules: tuple[Rule, ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""

    def work(texts: list[str]) -> dict[str, object]:
        rows = [[f"{rules[k].kind}:{s}:{e}" for s, k, e in spans] for spans in scanner(rules).scan(texts)]
        base = tuple(f"{r.kind}:" for r in BASE)
        mine = [[x for x in row if x.startswith(base)] for row in rows]
        return {f"n_{b.kind}": [sum(x.startswith(b.kind + ":") for x in row) for row in mine] for b in BASE} | {"base_sha256": [hashlib.sha256(",".join(x).encode()).hexdigest() for x in mine], "spans": [",".join(x) for x in rows]}

    return common.map_blocks(df, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work, doc_id, text)


def op10_secrets(spark, sf_dir):
    return secret_digests(common.table(spark, sf_dir, "documents"))
