"""Surrogates for personal data: keyed, of the same type and format, and distinct.

Detected are e-mail addresses, IPv4 addresses, payment card numbers, phone
numbers, US social security numbers, and names: titled ones, and in the same text
also without a title, whole or in part. Every mention of an entity, in whatever
document, gets the same surrogate (coreference), as it depends on the entity and
the key alone: on a number, an address, a surname, or a given name and its gender
(by its title, else by a list of names, else by its ending). So "Mr. John Smith",
"Mr. Smith" and "John" of one text agree.

Numbers are mapped by a keyed permutation of those of their format without fixed
points: distinct numbers have distinct surrogates, however many there are, and
none is its own. Separators stay where they are, a card keeps its issuer digit
and whether its check digit is right, a phone number its country part and first
digit, an address its private block. (A surrogate may be a number that another
entity has; only names and e-mail addresses are kept apart from all own forms.)

Names and the local parts of addresses are drawn by a keyed hash, letter for
letter in an address's local part (case, digits and separators stay), by gender
and script in names. Distinctness is checked over all entities of the corpus: of
those of one type that draw one surrogate, the first by hash keeps it, the others
draw again from a longer range, until no two entities share one and none is
another entity's own form. Entities that needed more than one draw are few; they
are broadcast to the rewriting pass if they are no more than ``broadcast_rows``,
and otherwise joined to the documents that hold them.

Null texts stay null, empty texts empty; patterns take time in proportion to a
text's length, of whatever make. Every row gives one row, with all its columns
(those named n_entities and entity_spans are replaced); repeated rows get equal
ones. Of entities that overlap the first counts, of those that begin together the
longest. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textkit as tk
from .shipping import checkpointed

FIRST = {
    ("f", "latin"): "Ana Anna Alice Bea Carla Clara Dora Elin Emma Eva Freya Greta Hanna Ines Jane Julia Karla Laura Lena Lucy Maria Marie Mary Mira Nina Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("m", "latin"): "Adam Aron Ben Carlo Carlos Daniel David Emil Felix Frank George Gustav Henri Ivo James John Jonas Karl Leon Louis Luis Mark Martin Milan Niklas Oskar Pablo Paul Peter Robert Thomas Victor".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Иван Лев Олег Павел".split(),
}
GENDER = {name: gender for (gender, _), names in FIRST.items() for name in names}
SYLLABLES = {"latin": "ba den fel gor han kel lin mar nor pel ros sten tor vil wen zan".split(), "cyrillic": "ба ден вел гор кол лин мар нор пел рос тор вил".split()}
TITLES = {"mrs": "f", "ms": "f", "miss": "f", "frau": "f", "mme": "f", "sra": "f", "señora": "f", "mr": "m", "herr": "m", "sr": "m", "señor": "m", "dr": "", "prof": ""}

_WORD = "[A-ZÀ-ÖØ-ÞА-Я][a-zß-öø-ÿа-я]+"
PATTERNS = {
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?P<sep>[ -]?)[0-9]{4}(?P=sep)[0-9]{4}(?P=sep)[0-9]{4}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "name": rf"\b(?:Mrs?|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sra?|Señora?)\.?\x20{_WORD}(?:\x20{_WORD})?",
}
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_MAY = re.compile(r"[0-9][0-9.)( -]{5}|@|\b(?:Mr|Ms|Miss|Dr|Prof|Herr|Frau|Mme|Sr|Señor)")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
_LOCAL = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_%+.-")
_NAMED = re.compile(rf"(?<!\w){_WORD}(?!\w)")

#: An entity of a mention: where it stands, its kind, and its form, which all its mentions share.
Entity = tuple[int, int, str, str]


def _emails(text: str) -> Iterator[tuple[int, int, str]]:
    """From each @ to both sides, so that a run of letters is passed once."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        start = max(start, text.rfind("..", start, at) + 2) if ".." in text[start:at] else start
        start += text[start] == "." if start < at else 0
        domain = _DOMAIN.match(text, at + 1)
        free = at + 1
        if start < at and text[at - 1] != "." and domain:
            yield start, domain.end(), "email"
            free = domain.end()
        at = text.find("@", free)


def _apart(found: list[tuple]) -> list[tuple]:
    """Of spans that overlap the first, of those that begin together the longest."""
    out: list[tuple] = []
    for x in sorted(found, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def mentions(text: str) -> list[tuple[int, int, str, list[Entity]]]:
    """(start, end, type, entities) of what a text mentions, in its order, without overlaps; a full name has two entities."""
    if not _MAY.search(text):
        return []
    found: list[tuple] = [*_emails(text)]
    for m in _ANY.finditer(text):
        kind = next(k for k in PATTERNS if m.group(k) is not None)
        found.append((m.start(), m.end(), kind))
    found = _apart(found)
    given: dict[str, str] = {}
    last: set[str] = set()
    for start, end, kind in found:
        if kind == "name":
            title, *words = text[start:end].split()
            if len(words) > 1:
                given.setdefault(words[0], TITLES.get(title.rstrip(".").lower(), "") or _gender(words[0]))
            last.add(words[-1])
    last -= given.keys()
    if last or given:  # the same people without a title
        known = [m for m in _NAMED.finditer(text) if m.group() in last or m.group() in given]
        i = 0
        while i < len(known):
            start, end = known[i].span()
            if known[i].group() in given and i + 1 < len(known) and known[i + 1].group() in last and text[end : known[i + 1].start()] == " ":
                i, end = i + 1, known[i + 1].end()
            found.append((start, end, "name"))
            i += 1
        found = _apart(found)
    return [(start, end, kind, _entities(text, start, end, kind, given)) for start, end, kind in found]


def _entities(text: str, start: int, end: int, kind: str, given: dict[str, str]) -> list[Entity]:
    value = text[start:end]
    if kind != "name":
        return [(start, end, kind, canonical(kind, value))]
    words = [(m.start() + start, m.end() + start, m.group()) for m in re.finditer(r"\S+", value)]
    gender = ""
    if words[0][2].rstrip(".").lower() in TITLES and len(words) > 1:
        gender = TITLES[words[0][2].rstrip(".").lower()]
        words = words[1:]
    out = []
    for k, (a, b, w) in enumerate(words):
        first = w in given and (k < len(words) - 1 or len(words) == 1) or len(words) > 1 and k == 0
        out.append((a, b, "given", f"{gender or given.get(w) or _gender(w)}|{w}") if first else (a, b, "surname", w))
    return out


def _gender(first: str) -> str:
    return GENDER.get(first) or ("f" if first[-1] in "aeаяь" else "m")


def canonical(kind: str, value: str) -> str:
    """The form that all mentions of an address or number share."""
    if kind == "email":
        return value.lower()
    return re.sub(r"[^0-9.]" if kind == "ip" else r"[^0-9]", "", value)


def _stream(key: bytes, *parts: object) -> int:
    return int.from_bytes(hmac.new(key, "|".join(map(str, parts)).encode(), hashlib.sha256).digest(), "big")


def _luhn_digit(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _luhn_ok(digits: str) -> bool:
    return _luhn_digit(digits[:-1]) == digits[-1]


def _round(key: bytes, i: int, half: int, bits: int) -> int:
    digest = hashlib.blake2b(b"%d|%d" % (i, half), key=key[:64], digest_size=8).digest()
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def _feistel(key: bytes, x: int, bits: int, back: bool = False) -> int:
    left, right = x >> bits, x & ((1 << bits) - 1)
    for i in reversed(range(6)) if back else range(6):
        if back:
            left, right = right ^ _round(key, i, left, bits), left
        else:
            left, right = right, left ^ _round(key, i, right, bits)
    return left << bits | right


def permuted(key: bytes, x: int, size: int, allowed: Callable[[int], bool] = lambda x: True) -> int:
    """x's successor in a keyed cycle of all allowed numbers under ``size``: another number for each, and never itself if there are two."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    full = 1 << 2 * bits
    while True:
        x = _feistel(key, (_feistel(key, x, bits, back=True) + 1) % full, bits)
        if x < size and allowed(x):
            return x


def _public(x: int) -> bool:
    first = x >> 24
    return 0 < first < 224 and first not in (10, 127, 169, 172, 192)


def _number(key: bytes, kind: str, form: str) -> str:
    """A number's or address's surrogate: a permutation of those that share what must stay."""

    def digits(kept: str, free: str) -> str:
        own = hmac.new(key, f"{kind}|{kept}|{len(free)}".encode(), hashlib.sha256).digest()
        return kept + str(permuted(own, int(free), 10 ** len(free))).zfill(len(free)) if free else kept

    if kind == "ip":
        x = sum(int(p) << 8 * (3 - i) for i, p in enumerate(form.split(".")))
        free = 24 if x >> 24 in (10, 127) else 16 if x >> 16 in (0xC0A8, 0xA9FE) or 0xAC10 <= x >> 16 < 0xAC20 else 32
        own = hmac.new(key, f"ip|{x >> free}|{free}".encode(), hashlib.sha256).digest()
        public = free == 32 and _public(x)
        y = (x >> free << free) | permuted(own, x & ((1 << free) - 1), 1 << free, (lambda v: _public(v) == public) if free == 32 else lambda v: True)
        return ".".join(str(y >> 8 * (3 - i) & 255) for i in range(4))
    if kind == "card":
        body = digits(form[0], form[1:-1])
        off = (int(form[-1]) - int(_luhn_digit(form[:-1]))) % 10  # 0 where the check digit is right
        return body + str((int(_luhn_digit(body)) + off) % 10)
    if kind == "phone":
        kept = len(form) - 9 if len(form) > 9 else 1
        return digits(form[:kept], form[kept:])
    return digits("", form)


def surrogate_form(key: bytes, kind: str, form: str, attempt: int) -> str:
    """The form of an entity's surrogate; never its own."""
    if kind in PATTERNS and kind != "name":
        return _number(key, kind, form)
    again = 0
    while True:
        out = _draw(kind, form, _stream(key, kind, attempt, again, form), attempt)
        if out.lower() != form.rpartition("|")[2].lower():
            return out
        again += 1


def _draw(kind: str, form: str, n: int, attempt: int) -> str:
    """A name or address; later attempts draw from longer ones."""
    script = "cyrillic" if re.search("[А-я]", form) else "latin"

    def take(some) -> str:
        nonlocal n
        n, k = divmod(n, len(some))
        return some[k]

    if kind == "email":
        local, _, domain = form.partition("@")
        turn, out = 0, []
        for c in local:  # consonants and vowels in turn, digits for digits
            out.append(take("0123456789") if c.isdigit() else take("bcdfghklmnprstvz" if turn % 2 == 0 else "aeiou") if c.isalpha() else c)
            turn += c.isalpha()
        end = domain.rpartition(".")[2]
        return f"{''.join(out)}@mail{n % 10 ** (3 + attempt)}.example.{end if end in ('com', 'org', 'net') else 'com'}"
    if kind == "given":
        return "-".join(take(FIRST[form[0], script]) for _ in range(1 + (attempt + 1) // 2))
    return "".join(take(SYLLABLES[script]) for _ in range(5 + attempt // 2)).capitalize()


def in_format(kind: str, value: str, form: str) -> str:
    """A surrogate's form, written as the mention that it replaces."""
    if kind == "email":
        cased = "".join(f.upper() if v.isupper() else f for v, f in zip(value.partition("@")[0], form))
        return form.upper() if value.isupper() else cased + form[len(cased) :]
    if kind in ("ip", "given", "surname"):
        return form
    digits = iter(form)
    return re.sub("[0-9]", lambda _: next(digits), value)


def drawn_entities(text: str) -> set[tuple[str, str]]:
    """The entities of a text whose surrogates are drawn, and so may collide."""
    return {(kind, form) for *_, own in mentions(text) for _, _, kind, form in own if kind in DRAWN}


DRAWN = ("email", "given", "surname")


def find_entities(docs: DataFrame) -> DataFrame:
    """(kind, form): the entities of all texts whose surrogates are drawn, each as often as some Arrow batch holds it."""

    def run(batches):
        for batch in tk.steps(batches, "text"):
            found = set().union(*(drawn_entities(t) for t in tk.column(batch, "text").to_pylist() if t))
            if found:
                kinds, forms = zip(*sorted(found))
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(forms)], names=["kind", "form"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, form string")


def assign_surrogates(found: DataFrame, key: bytes, most_rounds: int = 40) -> DataFrame:
    """(kind, form, attempt) for entities that must not use attempt 0, so that all surrogates are distinct."""

    def draw(batches):
        for batch in batches:
            drawn = [surrogate_form(key, k, f, a) for k, f, a in zip(*(tk.column(batch, c).to_pylist() for c in ("kind", "form", "attempt")))]
            yield batch.append_column("drawn", pa.array(drawn, pa.string()))

    schema = "kind string, form string, attempt int, drawn string"
    known = checkpointed(found.distinct().withColumn("attempt", F.lit(0)).mapInArrow(draw, schema))
    own = known.select("kind", F.substring_index("form", "|", -1).alias("drawn")).distinct().withColumn("taken", F.lit(True))  # a given name without its gender
    by = Window.partitionBy("kind", "drawn").orderBy("attempt", F.xxhash64("form"), "form")
    for _ in range(most_rounds):
        # those drawn twice, or drawn as another entity's own form; an entity that changed comes after one that did not
        judged = known.join(own, ["kind", "drawn"], "left").withColumn("again", F.coalesce("taken", F.lit(False)) | (F.row_number().over(by) > 1))
        if not judged.where("again").limit(1).count():
            return known.where("attempt > 0").select("kind", "form", "attempt")
        moved = judged.where("again").select("kind", "form", (F.col("attempt") + 1).cast("int").alias("attempt")).mapInArrow(draw, schema)
        known = checkpointed(judged.where("NOT again").select("kind", "form", "attempt", "drawn").unionAll(moved))
    raise RuntimeError("surrogates still collide: their range is too small for so many entities")


def _rewritten(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, int, list[str]]:
    if not text:
        return text, 0, []
    out, at, spans = [], 0, []
    for start, end, kind, own in mentions(text):
        spans.append(f"{kind}:{start}:{end}")
        for a, b, part, form in own:
            out += [text[at:a], in_format(part, text[a:b], surrogate_form(key, part, form, attempts.get((part, form), 0)))]
            at = b
    return "".join([*out, text[at:]]), len(spans), spans


def replace_entities(docs: DataFrame, key: bytes, broadcast_rows: int = 100_000) -> DataFrame:
    """The rows of docs with entities in text replaced, and the columns n_entities and entity_spans."""
    docs = docs.drop("n_entities", "entity_spans").withColumn("text", F.col("text").cast("string"))
    names = docs.columns
    own_attempts = _free("attempts", names)
    moved = assign_surrogates(find_entities(docs), key)
    few = moved.limit(broadcast_rows + 1).count() <= broadcast_rows
    if few:
        sent = docs.sparkSession.sparkContext.broadcast({(r["kind"], r["form"]): r["attempt"] for r in moved.collect()})
        joined = docs.withColumn(own_attempts, F.expr("cast(null as array<struct<kind:string,form:string,attempt:int>>)"))
    else:
        sent = docs.sparkSession.sparkContext.broadcast({})
        joined = _with_attempts(docs, moved, own_attempts)

    def run(batches):
        for batch in tk.steps(batches, "text"):
            rows = []
            for text, own in zip(tk.column(batch, "text").to_pylist(), tk.column(batch, own_attempts).to_pylist()):
                rows.append(_rewritten(text, key, {(a["kind"], a["form"]): a["attempt"] for a in own} if own else sent.value))
            texts, counts, spans = zip(*rows)
            columns = [pa.array(texts, pa.string()) if c == "text" else tk.column(batch, c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int32()), pa.array([",".join(s) for s in spans])], names=[*names, "n_entities", "entity_spans"])

    schema = StructType([*docs.schema.fields, *StructType.fromDDL("n_entities int, entity_spans string").fields])
    return joined.mapInArrow(run, schema)


def _free(name: str, taken: list[str]) -> str:
    """The name, lengthened until no column has it."""
    while name.lower() in (t.lower() for t in taken):
        name += "_"
    return name


def _with_attempts(docs: DataFrame, moved: DataFrame, name: str) -> DataFrame:
    """docs with the entities of each text that have an attempt of their own, through a join by entity."""

    def run(batches):
        for batch in tk.steps(batches, "text"):
            texts = tk.column(batch, "text").to_pylist()
            found = [(h, k, f) for t, h in zip(texts, tk.column(batch, "hash").to_pylist()) if t for k, f in drawn_entities(t)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["hash", "kind", "form"])

    held = docs.select("text", F.xxhash64("text").alias("hash")).mapInArrow(run, "hash long, kind string, form string").distinct()
    own = held.join(moved, ["kind", "form"]).groupBy("hash").agg(F.collect_list(F.struct("kind", "form", "attempt")).alias("found"))
    own = own.select(F.col("hash").alias(_free("hash", docs.columns)), F.col("found").alias(name))
    key = own.columns[0]
    return docs.withColumn(key, F.xxhash64("text")).join(own, key, "left").drop(key)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, key=b"surrogates-v1")
