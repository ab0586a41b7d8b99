"""Personal data: detected entities receive keyed surrogates of their own type and format.

Surrogates are functions of a key and the entity's canonical form, so equal entities get equal surrogates in every document
(coreference). There are two kinds:

* Numbers (phones, cards, social security numbers, IBANs, IP addresses) and the parts of names go through a keyed permutation
  of their format's domain without fixed points. Distinct ones stay distinct by construction, however full the domain is.
* E-mail addresses are drawn, and collision checks run over the distinct ones of all documents: of those with the same
  surrogate all but the first draw again, and so does one whose surrogate is itself an address in the corpus, until there is
  none. Later draws are longer. If that doesn't end, it is an error. Only the exceptions are kept; all other surrogates
  are computed where they are needed.

Format: letters stay letters of their script and case, digits digits, separators stay. Cards keep their first digit, and
cards and IBANs whether their check digits are right. Addresses stay in their range (10/8, 192.168/16, public ...).

Names are replaced part by part, given and family names apart, so 'Dr Anna Smith', 'MRS ANNA SMITH' and 'Mrs Smith' agree in
every document. Listed given names are permuted within their gender and script. Others are spelled anew, a vowel for a vowel
and a consonant for a consonant; their last letter, which mostly tells the gender, stays, as do the endings of family names
that have a feminine form (Иванов and Иванова stay a pair). Chinese names keep their length. A name is found by a title, by a
listed given name before a capitalised word, and in Chinese by a title after it, or alone with a listed family name.

The key comes from the argument, the setting spark.bytequarry.pii.key or the environment variable BYTEQUARRY_PII_KEY; without
any, each run draws its own, so its surrogates can't be compared with those of another run.

Defined cases: a null text stays null with no entities, an empty one empty; repeated rows get the same text; rows without id are
handled like others; an empty table has no rows; further columns are kept by `pseudonymize`, whatever their names, but for
_found, which the result replaces. A very long text is handled whole, with some 200 bytes of memory per entity.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import secrets
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Exceptions that go to every executor; more are joined to the texts that hold them.
MOST_BROADCAST = 500_000
#: Draws after which it is an error that collisions are left; a draw gets longer each time from the fifth on.
MOST_ROUNDS = 64
#: The key of this run where none is given.
DEFAULT_KEY = os.environ.get("BYTEQUARRY_PII_KEY") or secrets.token_hex(32)

#: Given names by gender and script, Chinese family names, and titles by gender.
GIVEN = {
    ("f", "latin"): "Alice Anna Maria Emma Julia Laura Sarah Sofia Clara Elena Marie Camille Chloe Lea Lucia Carmen Ines Paula Hannah Mia Lena Greta Emily Grace Olivia Nora Ruth Diana Helen Irene".split(),
    ("m", "latin"): "John James Robert Michael David Thomas Daniel Peter Paul Mark Lucas Hugo Louis Pierre Jean Carlos Juan Diego Pablo Luis Hans Karl Felix Jonas Leon Oscar Henry George Simon Victor".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Татьяна Наталья Ирина Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Дмитрий Сергей Андрей Николай Михаил Павел Олег".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Γεωργία Δήμητρα Ιωάννα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος".split(),
}
HAN_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董潘袁蔡蒋余于杜叶程魏苏吕丁任卢姚沈钟姜崔谭陆范汪廖石金韦贾夏付方邹熊白孟秦邱侯江尹薛闫段雷龙史陶贺毛郝顾龚邵万覃武钱戴严莫孔向常"
HAN_GIVEN = "伟芳娜敏静丽强磊军洋勇艳杰娟涛明超秀霞平刚桂英华玉兰建文辉力鹏飞红梅海燕波宁春亮健云峰雪琳佳欣宇浩然子涵思雨晨阳梓轩"
TITLES = {"f": "Mrs Ms Miss Frau Señora Sra Madame Mme Госпожа Κυρία".split(), "m": "Mr Herr Señor Sr Monsieur Господин Κύριος".split(), "": "Dr Prof".split()}
HAN_TITLES = {"f": ("女士", "小姐", "太太"), "m": ("先生",), "": ("博士", "教授", "老师")}
VOWELS = {"latin": "aeiou", "cyrillic": "аеиоуяюэ", "greek": "αεηιοω"}
CONSONANTS = {"latin": "bcdfghjklmnprstvwz", "cyrillic": "бвгджзклмнпрстфхш", "greek": "βγδζθκλμνπρσφχ"}
#: Feminine and masculine endings of family names that go in pairs.
PAIRED = {"cyrillic": (("ова", "ов"), ("ева", "ев"), ("ёва", "ёв"), ("ина", "ин"), ("ская", "ский")), "greek": (("οπούλου", "όπουλος"), ("ίδου", "ίδης"), ("άκη", "άκης"), ("ου", "ος"))}

GENDER = {x: g for g, ts in TITLES.items() for t in ts for x in (t, t.upper())}
GIVEN_OF = {n: k for k, ns in GIVEN.items() for n in ns}
LISTED_OF = {n.lower(): (k, i) for k, ns in GIVEN.items() for i, n in enumerate(ns)}

PATTERNS = {
    "email": re.compile(r"(?<![\w.+@-])[\w+-]+(?:\.[\w+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w@-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "ip": re.compile(r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9]|\.[0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]|[.-][0-9])"),
    "ssn": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)[\x20.-]?)?|\([0-9]{2,4}\)[\x20.-]?)[0-9]{2,5}(?:[\x20.-]?[0-9]{2,5}){1,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+.-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4}(?![0-9A-Za-z-])"),
}
WORD = r"(?:[OD]['’])?[^\W\d_][^\W\d_]+(?:-[^\W\d_]+)?"
TITLE = "|".join(map(re.escape, sorted(GENDER, key=len, reverse=True)))
NAMED = re.compile(rf"\b(?P<title>{TITLE})\b\.?\x20(?P<name>{WORD}(?:\x20{WORD})?)")
LISTED = re.compile(rf"\b(?P<name>(?:{'|'.join(sorted({x for n in GIVEN_OF for x in (n, n.upper())}, key=len, reverse=True))})\x20{WORD})")
HAN = "\u4e00-\u9fff"
HAN_NAMED = re.compile(rf"(?P<name>[{HAN_FAMILY}][{HAN}]{{0,2}}?)(?P<title>{'|'.join(t for ts in HAN_TITLES.values() for t in ts)})|(?<![{HAN}])(?P<alone>[{HAN_FAMILY}][{HAN}]{{1,2}})(?![{HAN}])")
TITLE_WORDS = frozenset(x for t in GENDER for x in (t, t + "."))
GIVEN_WORDS = frozenset(x for n in GIVEN_OF for x in (n, n.upper()))
KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "name")
HINT = re.compile(r"[0-9@]")


@dataclass(frozen=True)
class Entity:
    start: int
    end: int
    kind: str
    canon: str


def luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10


def _capital(word: str) -> bool:
    return word[:1].isupper()


def _names(text: str) -> list[Entity]:
    words = set(text.split())
    out = []
    if not TITLE_WORDS.isdisjoint(words):
        for m in NAMED.finditer(text):
            parts = m["name"].split(" ")
            shouted = len(m["title"]) > 1 and m["title"].isupper()
            if not _capital(parts[0]) or len(parts[0]) > 1 and parts[0].isupper() and not shouted:
                continue
            two = len(parts) == 2 and _capital(parts[1]) and (not parts[1].isupper() or shouted)
            end = m.end("name") if two or len(parts) == 1 else m.start("name") + len(parts[0])
            out.append(Entity(m.start("name"), end, "name", f"{GENDER[m['title']]}|{text[m.start('name'):end].lower()}"))
    if not GIVEN_WORDS.isdisjoint(words):
        for m in LISTED.finditer(text):
            given, family = m["name"].split(" ")
            if _capital(family) and family.isupper() == given.isupper():
                out.append(Entity(m.start(), m.end(), "name", f"{LISTED_OF[given.lower()][0][0]}|{m['name'].lower()}"))
    if not text.isascii() and (hits := HAN_NAMED.finditer(text)):
        for m in hits:
            which = "alone" if m["alone"] else "name"
            gender = next((g for g, ts in HAN_TITLES.items() if m["title"] in ts), "")
            out.append(Entity(m.start(which), m.end(which), "name", f"{gender}|{m[which]}"))
    return out


def canonical(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "iban":
        return value.replace(" ", "")
    return "".join(c for c in value if c.isdigit() or c == "+") if kind in ("card", "ssn", "phone") else value


def detect(text: str) -> list[Entity]:
    """Entities in order, none overlapping; at the same place the longer one, then the earlier kind."""
    found = _names(text)
    if HINT.search(text):
        for kind, pattern in PATTERNS.items():
            if kind == "email" and "@" not in text:
                continue
            found += [Entity(m.start(), m.end(), kind, canonical(kind, m[0])) for m in pattern.finditer(text)]
    if not found:
        return found
    order = {k: i for i, k in enumerate(KINDS)}
    found.sort(key=lambda e: (e.start, -e.end, order[e.kind]))
    out: list[Entity] = []
    for e in found:
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _round(key: bytes, tweak: bytes, step: int, value: int, bits: int) -> int:
    """`bits` keyed bits."""
    size = (bits + 7) // 8
    out, block = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(b"%d|%d|%d|" % (step, block, value) + tweak, key=key, digest_size=32).digest()
        block += 1
    return int.from_bytes(out[:size], "little") & ((1 << bits) - 1)


def _feistel(key: bytes, tweak: bytes, value: int, half: int, back: bool = False) -> int:
    """A keyed permutation of [0, 4**half), or its inverse."""
    mask = (1 << half) - 1
    left, right = value >> half, value & mask
    for step in reversed(range(6)) if back else range(6):
        if back:
            left, right = right ^ _round(key, tweak, step, left, half), left
        else:
            left, right = right, left ^ _round(key, tweak, step, right, half)
    return left << half | right


def permuted(key: str, tweak: str, value: int, size: int, ok=None) -> int:
    """A keyed permutation without fixed points of the values below `size` that are ok: the next one on a secret cycle
    through all of them. The only value of its domain stays."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    k, t = hashlib.blake2b(key.encode()).digest()[:64], tweak.encode()
    got = value
    while True:
        got = _feistel(k, t, (_feistel(k, t, got, half) + 1) & ((1 << 2 * half) - 1), half, back=True)
        if got == value or got < size and (ok is None or ok(got)):
            return got


DIGITS, LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"


def respelled(key: str, tweak: str, text: str, sets: list[str], ok=None) -> str:
    """The text with each character that is in its set replaced by one of that set; sets: one for each character, "" to keep it."""
    sizes = [len(a) if c in a else 1 for c, a in zip(text, sets, strict=True)]

    def spell(value: int) -> str:
        out = []
        for c, a, n in zip(text, sets, sizes, strict=True):
            value, k = divmod(value, n)
            out.append(a[k] if n > 1 else c)
        return "".join(out)

    value, base = 0, 1
    for c, a, n in zip(text, sets, sizes, strict=True):
        value += base * (a.index(c) if n > 1 else 0)
        base *= n
    shape = "".join(str(n) if n > 1 else c for c, n in zip(text, sizes, strict=True))
    return spell(permuted(key, f"{tweak}|{shape}", value, base, None if ok is None else lambda v: ok(spell(v))))


def script_of(text: str) -> str:
    for c in text:
        if c.isalpha():
            name = unicodedata.name(c, "")
            for script in ("CYRILLIC", "GREEK", "CJK"):
                if name.startswith(script):
                    return script.lower()
    return "latin"


@lru_cache(64)
def _listed(key: str, group: tuple[str, str]) -> dict[str, str]:
    """The listed names of a group, each with the next one on a secret cycle."""
    names = sorted((n.lower() for n in GIVEN[group]), key=lambda n: hmac.new(key.encode(), n.encode(), hashlib.sha256).digest())
    return dict(zip(names, names[1:] + names[:1], strict=True))


def _spelled_name(key: str, kind: str, word: str, kept: int, ok=None) -> str:
    """A name in lower case, a vowel for a vowel and a consonant for a consonant, but for its last `kept` letters. Accents
    stay where they are; letters that are in no alphabet here stay too."""
    script = script_of(word)
    if script == "cjk":
        sets = [HAN_GIVEN if c in HAN_GIVEN else "".join(map(chr, range(0x4E00, 0x9FA6))) for c in word]
        return respelled(key, kind, word, sets, ok)
    sets = []
    for i, c in enumerate(word):
        base = unicodedata.normalize("NFD", c)[0]
        own = VOWELS[script] if base in VOWELS[script] else CONSONANTS[script] if base in CONSONANTS[script] else ""
        sets.append(own if c == base and i < len(word) - kept else "")
    if sum(map(len, sets)) < 2:
        sets = [LOWER if "a" <= c <= "z" else "" for c in word]
    return respelled(key, kind, word, sets, ok)


@lru_cache(100_000)
def given_name(key: str, word: str) -> str:
    """Of a given name in lower case: a listed name of its gender and script, or a new spelling."""
    known = LISTED_OF.get(word)
    if known:
        return _listed(key, known[0])[word]
    return _spelled_name(key, "given", word, 1, lambda x: x not in LISTED_OF)


def _ending(word: str) -> tuple[str, tuple[str, str]] | None:
    """The ending of a family name that has a feminine and a masculine form, and the pair."""
    for pair in PAIRED.get(script_of(word), ()):
        for ending in pair:
            if word.endswith(ending) and len(word) > len(ending) + 1:
                return ending, pair
    return None


@lru_cache(100_000)
def family_name(key: str, word: str) -> str:
    """Of a family name in lower case; a feminine form gets the feminine form of what the masculine one gets."""
    if script_of(word) == "cjk":
        return respelled(key, "family", word, [HAN_FAMILY if c in HAN_FAMILY else "" for c in word])
    if found := _ending(word):
        ending, pair = found
        # the same stems for both forms: those that have this pair's endings and no longer ones
        same = lambda x: all(_ending(x + e) in (None, (e, pair)) for e in pair)
        stem = word[: -len(ending)]
        return (_spelled_name(key, f"family|{pair}", stem, 0, same) if same(stem) else stem) + ending
    return _spelled_name(key, "family", word, 0, lambda x: _ending(x) is None)


class Draw:
    """A stream of keyed choices."""

    def __init__(self, key: str, *what: object):
        self.key, self.what, self.n, self.pool = key.encode(), "|".join(map(str, what)).encode(), 0, 0
        self.size = 1

    def below(self, n: int) -> int:
        if self.size < n * (1 << 40):
            block = hmac.new(self.key, self.what + b"#%d" % self.n, hashlib.sha256).digest()
            self.n += 1
            self.pool = int.from_bytes(block, "big")
            self.size = 1 << 256
        self.pool, got = divmod(self.pool, n)
        self.size //= n
        return got

    def like(self, text: str) -> str:
        """A letter for a letter of its script, a digit for a digit; text in lower case."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                script = script_of(c)
                letters = LOWER if script in ("latin", "cjk") else VOWELS[script] + CONSONANTS[script]
                out.append(letters[self.below(len(letters))])
            else:
                out.append(c)
        return "".join(out)


def _ip_range(n: int) -> str:
    a, b = n >> 24, n >> 16
    return "10" if a == 10 else "192.168" if b == 0xC0A8 else "172.16" if b >> 4 == 0xAC1 else "127" if a == 127 else "169.254" if b == 0xA9FE else "0" if a == 0 else "224" if a >= 224 else "public"


def _iban_check(country: str, account: str) -> int:
    """The right check digits."""
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def surrogate(key: str, kind: str, canon: str, attempt: int = 0) -> str:
    """The canonical form of the surrogate."""
    if kind == "email":
        draw = Draw(key, kind, canon, attempt)
        local, domain = canon.rsplit("@", 1)
        host, _, top = domain.rpartition(".")
        spread = "" if attempt < 4 else draw.like("a" * (attempt - 3))
        return f"{draw.like(local)}{spread}@{Draw(key, 'domain', domain, attempt // 8).like(host)}.{top}"
    if kind == "ip":
        value = int.from_bytes(bytes(map(int, canon.split("."))), "big")
        part = _ip_range(value)
        low, size = {"10": (10 << 24, 1 << 24), "192.168": (0xC0A8 << 16, 1 << 16), "172.16": (0xAC1 << 20, 1 << 20), "127": (127 << 24, 1 << 24), "169.254": (0xA9FE << 16, 1 << 16), "0": (0, 1 << 24)}.get(part, (0, 1 << 32))
        made = low + permuted(key, f"ip|{part}", value - low, size, lambda n: _ip_range(n + low) == part)
        return ".".join(map(str, made.to_bytes(4, "big")))
    if kind == "card":
        body = respelled(key, f"card|{canon[0]}", canon[1:-1], [DIGITS] * (len(canon) - 2))
        right = lambda x: (10 - luhn(x + "0")) % 10
        return canon[0] + body + str((right(canon[0] + body) + int(canon[-1]) - right(canon[:-1])) % 10)
    if kind == "phone":
        head = re.match(r"\+[0-9]?", canon)
        head = head[0] if head else ""
        return head + respelled(key, f"phone|{head}", canon[len(head) :], [DIGITS] * (len(canon) - len(head)))
    if kind == "iban":
        country, told, account = canon[:2], canon[2:4], canon[4:]
        made = respelled(key, f"iban|{country}", account, [DIGITS if c.isdigit() else LOWER.upper() for c in account])
        if told in ("00", "01", "99"):  # never right, and no surrogate of another has them
            return country + told + made
        off = int(told) - _iban_check(country, account)
        return f"{country}{(_iban_check(country, made) - 2 + off) % 97 + 2:02d}{made}"
    if kind == "name":
        parts = canon.split("|", 1)[1].split(" ")
        if script_of(parts[0]) == "cjk":
            return family_name(key, parts[0][0]) + (_spelled_name(key, "given", parts[0][1:], 0) if len(parts[0]) > 1 else "")
        return " ".join([*(given_name(key, p) for p in parts[:-1]), family_name(key, parts[-1])])
    return respelled(key, kind, canon, [DIGITS if c.isdigit() else "" for c in canon])


def _cased(original: str, made: str) -> str:
    """made, its letters in the case of the original's letters at the same places, or as the original as a whole has them."""
    if original.isupper():
        return made.upper()
    if len(original) == len(made):
        return "".join(m.upper() if o.isupper() else m for o, m in zip(original, made, strict=True))
    return "-".join(p[:1].upper() + p[1:] for p in made.split("-")) if original[:1].isupper() else made


def shaped(kind: str, original: str, canon: str) -> str:
    """The surrogate's canonical form in the original's layout and case."""
    if kind == "name":
        return " ".join(_cased(o, m) for o, m in zip(original.split(" "), canon.split(" "), strict=True))
    if kind == "email":
        o, m = original.rsplit("@", 1), canon.rsplit("@", 1)
        return f"{_cased(o[0], m[0])}@{_cased(o[1], m[1])}"
    if kind == "ip":
        return canon
    source = iter(canon.lstrip("+") if kind == "phone" else canon)
    return "".join(next(source, "") if c.isalnum() else c for c in original)


def _entities(df: DataFrame, text: str, columns: dict[str, object]) -> DataFrame:
    """kind and canon of every entity found, and further columns."""
    names = list(columns)
    rows = df.select(*(c.alias(n) for n, c in columns.items()), F.col(f"`{text}`").alias("text"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name in columns)

    def run(batches):
        for batch, texts in common.blocks(batches):
            found = [(k, e.kind, e.canon) for k, x in enumerate(texts) for e in detect(x)]
            at = pa.array([r[0] for r in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)).take(at) for n in names), pa.array([r[1] for r in found], pa.string()), pa.array([r[2] for r in found], pa.string())], names=[*names, "kind", "canon"])

    return rows.mapInArrow(run, f"{kinds}{', ' if kinds else ''}kind string, canon string")


def entities(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, kind and canon of every entity found."""
    return _entities(df, text, {"doc_id": F.col(doc_id).cast("long")})


def exceptions(found: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """kind, canon and attempt of the entities whose first surrogate can't be used. found: distinct kind and canon."""

    @F.pandas_udf("string")
    def draw(kind, canon, attempt):
        import pandas as pd

        return pd.Series([surrogate(key, *x) for x in zip(kind, canon, attempt, strict=True)], dtype=object)

    def drawn(df: DataFrame) -> DataFrame:
        return df.withColumn("made", draw("kind", "canon", "attempt"))

    with common.Scratch(found.sparkSession) as scratch:
        current = scratch.table(drawn(found.where("kind = 'email'").select("kind", "canon", F.lit(0).alias("attempt"))), "surrogates")
        for _ in range(MOST_ROUNDS):
            first = current.groupBy("kind", "made").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("kind", "made", F.col("first.canon").alias("keeper"))
            shared = current.join(first, ["kind", "made"]).where("canon <> keeper").select("kind", "canon")
            taken = current.join(current.select("kind", F.col("canon").alias("made")), ["kind", "made"], "left_semi").select("kind", "canon")
            again = scratch.table(shared.unionByName(taken).distinct().withColumn("again", F.lit(1)), "collisions")
            if again.isEmpty():
                return common.materialize(current.where("attempt > 0").select("kind", "canon", "attempt"), "exceptions")
            marked = current.join(again, ["kind", "canon"], "left")
            redrawn = drawn(marked.where("again = 1").select("kind", "canon", (F.col("attempt") + 1).alias("attempt")))
            current = scratch.table(marked.where("again IS NULL").select("kind", "canon", "attempt", "made").unionByName(redrawn), "surrogates")
    raise RuntimeError(f"surrogates still collide after {MOST_ROUNDS} draws")


def key_of(spark) -> str:
    return spark.conf.get("spark.bytequarry.pii.key", None) or DEFAULT_KEY


def pseudonymize(df: DataFrame, key: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its text's entities replaced, and `_found`: a map of kinds to their numbers."""
    from pyspark.sql.types import IntegerType, MapType, StringType, StructType

    spark = df.sparkSession
    key = key or key_of(spark)
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c != "_found"))
    other = exceptions(_entities(df, text, {}).distinct(), key)
    extra = common.fresh(df, "exceptions")
    if other.count() <= MOST_BROADCAST:
        shared = spark.sparkContext.broadcast({(r["kind"], r["canon"]): r["attempt"] for r in other.toLocalIterator()})  # at most MOST_BROADCAST rows
        rows = df.withColumn(extra, F.lit(None).cast("map<string,int>"))
    else:  # joined by the text, which every row has, and not by an id
        shared = spark.sparkContext.broadcast({})
        mark, by = F.sha2(F.col(f"`{text}`"), 256), common.fresh(df, "text_mark")
        own = _entities(df, text, {by: mark}).distinct().join(other, ["kind", "canon"]).groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias(extra))
        rows = df.join(own, mark == own[by], "left")
    schema = StructType([*df.schema.fields]).add("_found", MapType(StringType(), IntegerType()))
    place, names = df.columns.index(text), df.columns
    rows = rows.select(*(F.col(f"`{c}`") for c in names), extra)

    def run(batches):
        known: dict[tuple[str, str], str] = {}
        table = shared.value
        for batch, texts in common.blocks(batches, text):
            others = batch.column(len(names)).to_pylist()
            new, counts = [], []
            if len(known) > 200_000:
                known.clear()
            for x, o in zip(texts, others, strict=True):
                mine = dict(o) if o else {}
                out, at, n = [], 0, {}
                for e in detect(x):
                    k = (e.kind, e.canon)
                    made = known.get(k)
                    if made is None:
                        made = known[k] = surrogate(key, *k, mine.get(f"{e.kind}|{e.canon}", table.get(k, 0)))
                    out += (x[at : e.start], shaped(e.kind, x[e.start : e.end], made))
                    at = e.end
                    n[e.kind] = n.get(e.kind, 0) + 1
                new.append("".join(out) + x[at:] if out else x)
                counts.append(list(n.items()))
            old = batch.column(place)
            made_text = pa.array([None if not ok else y for y, ok in zip(new, old.is_valid().to_pylist(), strict=True)], pa.string())
            columns = [made_text if i == place else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.map_(pa.string(), pa.int32()))], names=[*names, "_found"])

    return rows.mapInArrow(run, schema)


def op3_pii(spark, sf_dir):
    out = pseudonymize(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.coalesce(F.try_element_at("_found", F.lit(k)), F.lit(0)).cast("long")
    return out.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), "text")
