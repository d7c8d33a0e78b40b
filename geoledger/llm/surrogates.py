"""Personal data replaced by surrogates.

Entities are found by pattern; each distinct one gets a replacement drawn from
a secret key, of the same type, format, script and gender. The same entity has
the same replacement everywhere, in whatever notation it stands, and different
entities have different ones: all are checked against each other and against
the real ones, and those that collide are drawn again until none does.
"""

from __future__ import annotations

import hashlib
import ipaddress
import math
import re
import unicodedata
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

# Titles by gender, and the letters of each script in order.
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Sra": "f", "Господин": "m", "Госпожа": "f"}
SCRIPTS = (
    "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "áàâäçéèêëíìîïñóòôöúùûü", "ÁÀÂÄÇÉÈÊËÍÌÎÏÑÓÒÔÖÚÙÛÜ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
RANGES = ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x0621, 0x064A), (0x05D0, 0x05EA), (0xAC00, 0xD7A3), (0x4E00, 0x9FFF))
SYLLABLES = {"latin": ("ba", "den", "el", "fi", "gor", "ha", "jo", "kel", "li", "mar", "no", "or", "pe", "ral", "san", "ti"), "greek": ("βα", "δεν", "ελ", "φι", "γορ", "χα", "ιο", "κελ", "λι", "μαρ", "νο", "ορ", "πε", "ραλ", "σαν", "τι"), "cyrillic": ("ба", "ден", "ел", "фи", "гор", "ха", "ко", "кел", "ли", "мар", "но", "ор", "пе", "рал", "сан", "ти")}
ENDINGS = {("greek", "f"): "α", ("greek", "m"): "ος", ("greek", "s"): "ιδης", ("latin", "f"): "a", ("latin", "m"): "o", ("latin", "s"): "son", ("cyrillic", "f"): "а", ("cyrillic", "m"): "он", ("cyrillic", "s"): "енко"}

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
NAME = r"[^\W\d_a-zà-öø-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")),
    ("secret", re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])")),
    ("secret", re.compile(r"(?i:(?:token|secret|api[_-]?key|password|passwd)[\"']?\s*[:=]\s*[\"']?)([0-9A-Za-z_+/-]{12,})")),
    ("iban", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])")),
    ("ipv4", re.compile(rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9])(?!\.[0-9])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])")),
)
TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(TITLES, key=len, reverse=True))})\.? ({NAME}(?: {NAME}){{0,2}})")
HINT = re.compile("[0-9@]|::")


def _groups(found: str) -> list[int]:
    """The eight numbers of an IPv6 address; none if the text is no address."""
    try:
        packed = ipaddress.IPv6Address(found).packed
    except ValueError:
        return []
    return [packed[i] << 8 | packed[i + 1] for i in range(0, 16, 2)]


def canonical(kind: str, found: str) -> str:
    """One spelling for all notations of an entity."""
    if kind in ("phone", "card", "ssn"):
        digits = re.sub("[^0-9]", "", found)
        return digits if kind != "phone" or len(digits) != 10 else "1" + digits
    if kind == "iban":
        return found.replace(" ", "")
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(found))
    return found if kind == "secret" and not re.fullmatch("[0-9a-fA-F]+", found) else found.lower()


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """Entities (start, end, kind, canonical spelling), in order, none inside another.

    Persons are found by a title; their given names and surnames are entities
    of their own, so "Mrs Anna Smith", "Anna Smith" and "Anna" further on agree.
    A word that is both in one text counts as what it stood for after a title,
    else as a surname. An IPv6 address has three groups or more that are not
    zero: fewer name a kind of address, or are no address ("a[1::2]").
    """
    spans: list[tuple[int, int, str, str]] = []
    if HINT.search(text):
        for kind, pattern in PATTERNS:
            for m in pattern.finditer(text):
                a, b = m.span(m.lastindex or 0)
                if kind == "ipv6" and sum(g > 0 for g in _groups(text[a:b])) < 3:
                    continue
                if not any(x < b and a < y for x, y, _, _ in spans):
                    spans.append((a, b, kind, canonical(kind, text[a:b])))
    if any(t in text for t in TITLES):
        people: dict[str, list[str]] = {}  # name: kind of each of its words
        titled = [(m[2].split(" "), f"given_{TITLES[m[1]]}") for m in TITLED.finditer(text)]
        for parts, given in titled:
            people[" ".join(parts)] = [given] * (len(parts) - 1) + ["surname"]
        for parts, _ in titled:
            people.setdefault(parts[-1], ["surname"])
        for parts, given in titled:
            for part in parts[:-1]:
                people.setdefault(part, [given])
        for name in sorted(people, key=len, reverse=True):
            for m in re.finditer(rf"(?<!\w){re.escape(name)}(?!\w)", text):
                at = m.start()
                for part, kind in zip(name.split(" "), people[name]):
                    if not any(x < at + len(part) and at < y for x, y, _, _ in spans):
                        spans.append((at, at + len(part), kind, part.lower()))
                    at += len(part) + 1
    return sorted(spans)


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64], digest_size=32).digest(), "big")


def _shuffled(n: int, size: int, key: bytes, *tweak: object) -> int:
    """Keyed permutation of range(size): a Feistel network over two halves, walked until it falls inside."""
    half = math.isqrt(max(size - 1, 0)) + 1
    while True:
        a, b = divmod(n, half)
        for r in range(6):
            a, b = b, (a + _number(key, *tweak, r, b)) % half
        n = a * half + b
        if n < size:
            return n


def _luhn(digits: str) -> int:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


@lru_cache(1 << 12)
def _relatives(letter: str) -> str:
    """Letters of the same script and case that lie near in the code."""
    script, base = unicodedata.name(letter, "").split(" ")[0], ord(letter) & ~127
    near = map(chr, range(base, base + 128))
    return "".join(c for c in near if unicodedata.category(c) == unicodedata.category(letter) and unicodedata.name(c, "").split(" ")[0] == script) or letter


def _script(name: str) -> str:
    """The script that syllables are known for, or that of the first letter."""
    return unicodedata.name(name[0], "").split(" ")[0].lower()


def _letters(text: str, key: bytes, *tweak: object) -> str:
    """Every letter and digit replaced by one of its script and case."""
    n, out = _number(key, *tweak, text), []
    for i, c in enumerate(text):
        if i % 24 == 23:
            n = _number(key, *tweak, text, i)
        letters = next((s for s in SCRIPTS if c in s), None)
        low, high = next(((a, b) for a, b in RANGES if a <= ord(c) <= b), (0, 0))
        if letters:
            n, k = divmod(n, len(letters))
            out.append(letters[k])
        elif high:
            n, k = divmod(n, high - low + 1)
            out.append(chr(low + k))
        elif c.isalpha():
            near = _relatives(c)
            n, k = divmod(n, len(near))
            out.append(near[k])
        else:
            out.append(c)
    return "".join(out)


@lru_cache(1 << 16)
def surrogate(kind: str, real: str, attempt: int, key: bytes) -> str:
    """Canonical spelling of the replacement."""
    if kind in ("phone", "ssn"):
        fixed = real[:1] if kind == "phone" and len(real) == 11 else ""
        rest = real[len(fixed) :]
        return fixed + str(_shuffled(int(rest or 0), 10 ** len(rest), key, kind, len(real), attempt)).zfill(len(rest))
    if kind == "card":  # the check digit stays right, or as wrong as it was
        off = (int(real[-1]) - _luhn(real[:-1])) % 10
        body = str(_shuffled(int(real[:-1]), 10 ** (len(real) - 1), key, kind, len(real), attempt)).zfill(len(real) - 1)
        return body + str((_luhn(body) + off) % 10)
    if kind == "ipv4":
        n = _shuffled(sum(int(p) << 8 * (3 - i) for i, p in enumerate(real.split("."))), 1 << 32, key, kind, attempt)
        return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":  # zeros stay, so that what is left out of the notation does, and a group keeps its width while draws last
        def group(i: int, g: int) -> int:
            low, high = (16 ** (len(f"{g:x}") - 1), 16 ** len(f"{g:x}")) if attempt < 8 else (1, 1 << 16)
            return low + _number(key, kind, real, attempt, i) % (high - low) if g else 0

        return str(ipaddress.IPv6Address(b"".join(group(i, g).to_bytes(2, "big") for i, g in enumerate(_groups(real)))))
    if kind == "email":
        local, _, domain = real.partition("@")
        labels, top = domain.rsplit(".", 1)
        return f"{_letters(local, key, kind, domain, attempt)}@{_letters(labels, key, 'domain')}.{top}"
    if kind == "secret" and re.fullmatch("[0-9a-f]+", real):
        n = [_number(key, kind, real, attempt, i) for i in range(0, len(real), 64)]
        return "".join(f"{x:064x}" for x in n)[: len(real)]
    if kind == "iban":
        return real[:2] + _letters(real[2:], key, kind, attempt)
    if kind in ("given_f", "given_m", "surname"):
        script = _script(real)
        if script not in SYLLABLES:  # letter by letter, longer where short names run out
            return _letters(real + real[-1] * (attempt // 4), key, kind, attempt)
        n, out = _number(key, kind, real, attempt), ""
        for _ in range(2 + attempt):
            n, k = divmod(n, 16)
            out += SYLLABLES[script][k]
        return out + ENDINGS[script, {"given_f": "f", "given_m": "m", "surname": "s"}[kind]]
    return _letters(real, key, kind, attempt)


def styled(kind: str, found: str, new: str) -> str:
    """The replacement in the notation of the place it goes to."""
    if kind in ("phone", "card", "ssn", "iban"):
        signs = [c for c in found if c.isascii() and c.isalnum()]
        new = new[len(new) - len(signs) :]
        it = iter(new)
        return "".join(next(it) if c.isascii() and c.isalnum() else c for c in found)
    if kind.startswith("given") or kind == "surname":
        return new.upper() if len(found) > 1 and found.isupper() else new.capitalize()
    if kind == "secret" and found != found.lower() and re.fullmatch("[0-9A-F]+", found):
        return new.upper()
    if kind == "ipv6":
        head, gap, tail = found.partition("::")
        before, after = [h for h in head.split(":") if h], [t for t in tail.split(":") if t]
        made = [f"{g:x}" for g in _groups(new)]
        shown = gap.join(
            ":".join(m.zfill(len(f)) for f, m in zip(part, drawn))
            for part, drawn in ((before, made), (after, made[8 - len(after) :]))
        ) if gap else ":".join(m.zfill(len(f)) for f, m in zip(before, made))
        return shown if found == found.lower() else shown.upper()
    if kind == "email" and found != found.lower():
        return new.upper() if found.isupper() else "".join(n.upper() if f.isupper() else n for f, n in zip(found, new))
    return new


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(kind, entity): every distinct one, once; repeats are folded inside each task before they move."""

    def run(batches):
        for batch in batches:
            found = {(k, c) for t in batch.column(text).to_pylist() if t for _, _, k, c in detect(t)}
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())], names=["kind", "entity"])

    return docs.select(text).mapInArrow(run, "kind string, entity string").distinct()


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate, attempt): no two of a kind share a surrogate, and none is a real entity of its kind.

    Of those that share one the smallest entity keeps it; the others draw again.
    """

    def draw(batches):
        for b in batches:
            yield b.assign(surrogate=[surrogate(k, e, a, key) for k, e, a in zip(b["kind"], b["entity"], b["attempt"].tolist())])[["kind", "entity", "attempt", "surrogate"]]

    schema = "kind string, entity string, attempt int, surrogate string"
    real = written(found.withColumn("attempt", F.lit(0)), "entities")
    drawn = written(real.mapInPandas(draw, schema), "surrogates")
    while True:
        owners = drawn.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
        twice = drawn.join(owners, ["kind", "surrogate"]).where(F.col("entity") != F.col("owner.entity")).select("kind", "entity")
        taken = drawn.join(real.select("kind", F.col("entity").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "entity")
        again = written(twice.unionByName(taken).distinct(), "collisions")
        if again.isEmpty():
            return drawn
        redrawn = drawn.join(again, ["kind", "entity"]).withColumn("attempt", F.col("attempt") + 1).drop("surrogate")
        drawn = written(drawn.join(again, ["kind", "entity"], "left_anti").unionByName(redrawn.select("kind", "entity", "attempt").mapInPandas(draw, schema)), "surrogates")


def replaced(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with surrogates in ``text`` and their number in ``n_replaced`` (replaced if there); all rows and other columns stay.

    First all distinct entities are drawn for and checked; what had to be drawn
    again is then joined to the documents that hold it, by (doc_id, text hash):
    a narrow table the planner copies while it is small, and shuffles beyond
    that. Everything else needs no look-up, as a surrogate follows from the key
    and the entity. A null text stays null.
    """
    drawn = assign(entities(docs, text), key)
    odd = written(drawn.where("attempt > 0").select("kind", "entity", "attempt"), "redrawn")
    again, name = _unused("again", docs), _unused("row_name", docs)
    if odd.isEmpty():
        source = docs.withColumn(again, F.lit(None).cast("array<struct<kind:string,entity:string,attempt:int>>"))
    else:
        held = _occurrences(docs.select(F.col(doc_id).cast("string").alias("doc"), F.col(text).alias("text")))
        per_row = held.join(odd, ["kind", "entity"]).groupBy("row_key").agg(F.collect_set(F.struct("kind", "entity", "attempt")).alias("again"))
        named = docs.withColumn(name, F.xxhash64(F.col(doc_id).cast("string"), text))
        source = named.join(written(per_row.toDF(name, again), "redrawn-rows"), name, "left").drop(name)
    return _apply(source, key, text, again).select(*[c for c in docs.columns if c != "n_replaced"], "n_replaced")


def _unused(name: str, rows: DataFrame) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name += "_"
    return name


def _occurrences(rows: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = {(r, k, c) for r, t in zip(b["row_key"].tolist(), b["text"]) if t for _, _, k, c in detect(t)}
            yield pd.DataFrame(sorted(out), columns=["row_key", "kind", "entity"]).astype({"row_key": "int64"})

    return rows.withColumn("row_key", F.xxhash64("doc", "text")).select("row_key", "text").mapInPandas(run, "row_key long, kind string, entity string")


def _apply(source: DataFrame, key: bytes, text: str, again_name: str) -> DataFrame:
    @F.pandas_udf("text string, n_replaced int")
    def change(texts: pd.Series, odd: pd.Series) -> pd.DataFrame:
        out = []
        for t, again in zip(texts, odd):
            spans = detect(t) if t else []
            if not spans:
                out.append((t, 0))
                continue
            attempts = {(o["kind"], o["entity"]): o["attempt"] for o in again} if again is not None else {}
            pieces, at = [], 0
            for a, b, kind, real in spans:
                pieces += [t[at:a], styled(kind, t[a:b], surrogate(kind, real, attempts.get((kind, real), 0), key))]
                at = b
            out.append(("".join(pieces) + t[at:], len(spans)))
        return pd.DataFrame(out, columns=["text", "n_replaced"])

    name = _unused("made", source)
    made = source.withColumn(name, change(F.col(text), F.col(again_name)))
    return made.withColumns({text: F.col(name)["text"], "n_replaced": F.col(name)["n_replaced"]}).drop(name, again_name)
