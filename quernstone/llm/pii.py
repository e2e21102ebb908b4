"""PII: surrogate generation.

Detected entities (mail addresses, phone, card, social security and bank account numbers,
IPv4 addresses, names behind a title) get keyed replacements of the same kind: the same
country code, issuer digit, separators, letter case, script, digits and gender, with valid check digits where
the original's are valid. A replacement depends on the key and the entity's canonical form
only, so all mentions of an entity in all documents stay one (coreference), whatever their
format. The gender of a name is settled once for the corpus: that of its titles, if they agree. Distinct entities stay distinct: the replacements of the whole corpus are checked
against each other and against all real entities, and those that clash are drawn
again until none does. Nearly all keep their first draw, which every task can compute; the
few others are joined to the documents that mention them. A form that runs out of draws grows, so this ends.

A name is a title in any letter case (but Miss, which is also a verb, begins with a capital), white space, and all capitalised parts, initials and particles
behind it on one line; it needs a part of two letters. Its parts are also replaced where they stand in the same document
without a title, capitalised. Digits may be of any script. The key must be secret: who has it can find the
original of a surrogate by trying candidates.
"""

from __future__ import annotations

import functools
import hashlib
import re
import string
import unicodedata
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import map_arrow, materialize, release, sized

KINDS = ("email", "iban", "ip", "ssn", "phone", "card", "name")
#: After so many draws of the same form a replacement may grow, so that small forms never run out.
SAME_FORM = 8
#: Far more draws than growing forms need; beyond them something is wrong.
MOST_DRAWS = 64

#: Titles that give a name's gender.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "господин", "г-н", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Signora", "госпожа", "г-жа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Professor", "Doktor", "Docteur", "доктор", "профессор")
#: Words in lower case inside names.
PARTICLES = ("de", "del", "della", "der", "den", "di", "da", "dos", "du", "la", "las", "le", "los", "ten", "ter", "van", "von", "vom", "zu", "zur", "bin", "ibn", "al", "el", "y")
#: Abbreviated degrees between a title and its name.
DEGREES = ("agr", "c", "dent", "h", "habil", "ing", "jur", "med", "nat", "oec", "phil", "pol", "rer", "theol", "vet")

_NAME_PART = r"[^\W\d_]+(?:-[^\W\d_]+|['’][^\W\d_]{2,})*"
_TITLES = "|".join(t for t in sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True) if t != "Miss")
_PATTERNS = {
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?!\w)"),
    "ip": re.compile(r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w|\.[0-9])"),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "phone": re.compile(r"(?<![\w.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{2,4}\)[ ]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3}[ .-][0-9]{3,4}[ .-][0-9]{4})(?!\w)"),
    "card": re.compile(r"(?<!\w)(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?!\w)"),
}
_TITLE = re.compile(rf"(?<!\w)(?:(?i:{_TITLES})|Miss|MISS)\.?(?=\s)")
_BEHIND_TITLE = re.compile(rf"(?P<gap>\s+)(?P<part>{_NAME_PART})")
_NEXT_PART = re.compile(rf"(?P<gap>[ \t\u00a0]+|(?<=\.))(?P<part>{_NAME_PART})")
_PART, _LETTERS = re.compile(_NAME_PART), re.compile(r"[^\W\d_]+")
_LOCAL = re.compile(r"[\w.+-]")
_DOMAIN = re.compile(r"(?:[\w-]+\.)+[^\W\d_]{2,}")
_OTHER_DIGIT = re.compile(r"[^\D0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_GENDERS = {t.lower(): g for g, titles in (("n", NEUTRAL), ("f", FEMALE), ("m", MALE)) for t in titles}
_SYLLABLES = {
    "LATIN": ("ba be bo da de do fa fe ga go ha ho ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo".split(), {"m": ["ron", "ten", "mar"], "f": ["na", "lia", "ra"], "n": ["ri", "lin", "mi"], "s": ["ner", "sen", "ton"]}),
    "CYRILLIC": ("ба бе бо да де до га го за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ва ве".split(), {"m": ["рон", "тин", "мир"], "f": ["на", "ля", "ра"], "n": ["ри", "ли", "ми"], "s": ["нко", "ник", "тюк"]}),
    "GREEK": ("βα γα γε δα δε θα κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το".split(), {"m": ["νος", "ρης", "μας"], "f": ["να", "λη", "ρα"], "n": ["λι", "μι", "ρι"], "s": ["κος", "δης", "λος"]}),
}

Mention = tuple[int, int, str, str]  # start, end, kind of entity, canonical form


def luhn(digits: str) -> int:
    """The check sum of a card number; 0 if it is valid."""
    doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(word: str) -> str:
    """Name of the script of a word's first letter."""
    return unicodedata.name(word[0], "LATIN").split()[0]


def ascii_digits(text: str) -> str:
    """The text with the decimal digits of all scripts as 0 to 9, character for character."""
    return _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def in_digits_of(digit: str, like: str) -> str:
    """A digit 0 to 9 in the script of another digit."""
    return digit if like in "0123456789" else chr(ord(like) - unicodedata.decimal(like) + int(digit))


def mentions(text: str | None) -> list[Mention]:
    """Entities of the whole text, by place, none over another. A name is a mention for each of its parts."""
    if not text:
        return []
    plain = ascii_digits(text)
    found: list[tuple[int, int, int, str, str]] = []
    if "@" in plain:
        found += [(a, 0, b, k, c) for a, b, k, c in _mails(plain)]
    if any(c in plain for c in "0123456789"):
        for rank, (kind, pattern) in enumerate(_PATTERNS.items(), 1):
            for m in pattern.finditer(plain):
                canon = _canonical(kind, m[0])
                if canon is not None:
                    found.append((m.start(), rank, m.end(), kind, canon))
    found += [(a, len(KINDS), b, k, c) for a, b, k, c in _names(plain)]
    out, end = [], 0
    for start, _, stop, kind, canon in sorted(found):
        if start >= end:
            out.append((start, stop, kind, canon))
            end = stop
    return out


def _mails(text: str) -> Iterable[Mention]:
    """Around each @: what may stand before it, back to the @ before, and a domain behind it."""
    at, before = text.find("@"), -1
    while at >= 0:
        start = at
        while start - 1 > before and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1)
        if m and start < at and text[at - 1] != ".":
            yield start, m.end(), "email", text[start : m.end()].lower()
            before = m.end() - 1
        else:
            before = at
        at = text.find("@", max(at + 1, before + 1))


def _canonical(kind: str, whole: str) -> str | None:
    """What all forms of one number have in common; None if it is none."""
    if kind == "ip":
        return ".".join(str(int(x)) for x in whole.split(".")) if all(int(x) <= 255 for x in whole.split(".")) else None
    if kind == "iban":
        canon = whole.replace(" ", "")
        return canon if 15 <= len(canon) <= 34 and mod97(canon) == 1 else None
    if kind == "phone":
        country = re.match(r"\+[0-9]{1,3}(?=[ .(-])", whole)
        canon = (country[0] + "/" if country else "") + _NOT_DIGIT.sub("", whole[country.end() :] if country else whole)
        return canon if 7 <= len(_NOT_DIGIT.sub("", canon)) <= 15 else None
    return _NOT_DIGIT.sub("", whole)


def _name(part: str) -> str:
    """A name in its canonical form: without letter case, with one sort of apostrophe."""
    return part.lower().replace("’", "'")


def _initial(part: str) -> bool:
    return len(part) == 1 and part.isupper()


def _titled(text: str, at: int) -> list[tuple[int, int, str]]:
    """The parts of the name that begins behind a title: capitalised ones and initials, over particles. Empty if all are initials."""
    parts: list[tuple[int, int, str]] = []
    m = _BEHIND_TITLE.match(text, at)
    degree = lambda m: not parts and m["part"] in DEGREES and text[m.end("part") : m.end("part") + 1] == "."
    while m and (m["part"] in PARTICLES or degree(m) or not m["part"][0].islower()):
        end = m.end("part")
        if degree(m):
            end += 1
        elif m["part"] not in PARTICLES:
            parts.append((m.start("part"), end, m["part"]))
        if _initial(m["part"]) and text[end : end + 1] == ".":
            end += 1
        m = _NEXT_PART.match(text, end)
    while parts and _initial(parts[-1][2]):  # the pronoun I, or an initial that belongs to nothing
        parts.pop()
    return parts


def _names(text: str) -> list[Mention]:
    """Names behind titles, and their parts where they stand in the text without one."""
    roles: dict[str, str] = {}
    found: dict[int, tuple[int, str]] = {}
    gender, chained = "n", -1
    for m in _TITLE.finditer(text):
        own = _GENDERS.get(m[0].rstrip(".").lower(), "n")
        gender = gender if m.start() == chained and own == "n" else own
        following = _BEHIND_TITLE.match(text, m.end())
        chained = following.start("part") if following else -1
        if following and _TITLE.match(text, chained):
            continue  # Prof. Dr. Smith: the name is behind the last title
        parts = _titled(text, m.end())
        for start, end, part in parts:
            found[start] = (end, canon := _name(part))
            kind = "name_i" if _initial(part) else "name_s" if start == parts[-1][0] else f"name_{gender}"
            # one word is one name in a document: a family name before all, then one with a gender
            if kind == "name_s" or roles.get(canon, "name_n") in ("name_n", "name_i"):
                roles[canon] = kind
    out = [(start, end, roles[canon], canon) for start, (end, canon) in found.items()]
    names = {canon for canon, kind in roles.items() if kind != "name_i"}
    for m in _PART.finditer(text) if names else ():
        # a hyphenated name as a whole, else the names in it
        for start, end in [m.span()] if _name(m[0]) in names else [x.span() for x in _LETTERS.finditer(text, *m.span())]:
            canon = _name(text[start:end])
            if start not in found and canon in names and not text[start].islower():
                out.append((start, end, roles[canon], canon))
    return out


class Draws:
    """A stream of numbers that depends on the key, the entity and the draw."""

    def __init__(self, key: bytes, *parts: object):
        self.seed, self.at, self.pool, self.left = hashlib.blake2b("\0".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key[:64]).digest(), 0, 0, 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            self.pool, self.left, self.at = int.from_bytes(hashlib.blake2b(self.seed + self.at.to_bytes(4, "big")).digest(), "big"), 1 << 512, self.at + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def alike(self, text: str) -> str:
        """Letters for letters of the same script and case and digits for digits, one by one; the rest as it is."""
        out = []
        for c in text:
            if c.isdecimal():
                out.append(in_digits_of(str(self.below(10)), c))
            elif c.isalpha():
                out.append(self.letter(c))
            else:
                out.append(c)
        return "".join(out)

    def letter(self, like: str) -> str:
        pool = _letters_like(like)
        return pool[self.below(len(pool))]


@functools.lru_cache(4096)
def _letters_like(c: str) -> str:
    """Letters of the script, category and code page of a letter; of ASCII for an ASCII letter."""
    if c.isascii():
        return string.ascii_uppercase if c.isupper() else string.ascii_lowercase
    page, script, category = ord(c) & ~0xFF, script_of(c), unicodedata.category(c)
    alike = [x for x in map(chr, range(page, page + 0x100)) if unicodedata.category(x) == category and script_of(x) == script and len(x.lower()) == len(x.upper()) == 1]
    return "".join(alike) or c


def surrogate(kind: str, canon: str, key: bytes, draw: int = 0) -> str:
    """The canonical form of an entity's replacement. Further draws give other ones."""
    d = Draws(key, kind, canon, draw)
    more = max(0, draw - SAME_FORM + 1)
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        name, _, top = domain.rpartition(".")
        return f"{d.alike(local)}{d.digits(more)}@{Draws(key, 'domain', domain).alike(name)}.{top}"
    if kind == "ip":
        if more > SAME_FORM:  # IPv4 is nearly full: a local address of IPv6
            return f"fd{d.below(256):02x}:" + ":".join(f"{d.below(1 << 16):x}" for _ in range(7))
        a, b, *_ = canon.split(".")
        kept = [a] if a in ("10", "127") else [a, b] if (a, b) == ("192", "168") or (a == "172" and 16 <= int(b) < 32) else []
        kept = [] if more else kept  # a private range may be full
        return ".".join([*kept, *(str(1 + d.below(254)) for _ in range(4 - len(kept)))])
    if kind == "iban":
        body = d.alike(canon[4:] + "0" * min(more, 34 - len(canon)))
        return f"{canon[:2]}{98 - mod97(f'{canon[:2]}00{body}'):02}{body}"
    if kind == "phone":
        country, slash, number = canon.rpartition("/")
        return f"{country}{slash}{d.digits(len(number) + more)}"
    if kind == "card":
        body = canon[0] + d.digits(len(canon) - 2 + more)
        check = -luhn(body + "0") % 10
        return body + str(check if luhn(canon) == 0 else (check + 1 + d.below(9)) % 10)
    if kind == "ssn":
        return d.digits(len(canon) + more)
    if kind == "name_i":
        return d.letter(canon)
    known = _SYLLABLES.get(script_of(canon))
    if known is None:
        return d.alike(canon + canon[-1] * more)
    syllables, endings = known
    last = endings[kind[-1]]
    return "".join(syllables[d.below(len(syllables))] for _ in range(3 + more)) + last[d.below(len(last))]


def rendered(kind: str, new: str, mention: str) -> str:
    """A canonical replacement in the form of a mention: its separators, its digits and its letter case."""
    if kind.startswith("name"):
        return new.upper() if mention.isupper() and (len(mention) > 1 or kind == "name_i") else new.title() if mention[0].isupper() else new
    if kind in ("email", "ip"):
        if kind == "email" and mention.isupper():
            return new.upper()
        like = _OTHER_DIGIT.search(mention) if kind == "ip" else None
        return new if like is None else "".join(in_digits_of(c, like[0]) if c in "0123456789" else c for c in new)
    country, _, number = new.rpartition("/") if kind == "phone" else ("", "", new)
    tail, left, out, like = mention[len(country) :], list(number), [mention[: len(country)]], "0"
    for c in tail:
        like = c if c.isdecimal() else like
        if not c.isalnum():
            out.append(c)
        elif left:
            new_c = left.pop(0)
            out.append(in_digits_of(new_c, like) if new_c in "0123456789" else new_c)
    return "".join(out + [in_digits_of(c, like) if c in "0123456789" else c for c in left])


def rewritten(text: str | None, settled: dict[tuple[str, str], tuple[str, int]], key: bytes) -> tuple[str | None, list[Mention]]:
    """The text with every entity replaced, and the mentions in the old one. ``settled``: kind and draw of entities for which they aren't the kind in this text and 0."""
    found, out, at = mentions(text), [], 0
    for start, end, kind, canon in found:
        of, draw = settled.get((kind, canon), (kind, 0))
        out += [text[at:start], rendered(of, surrogate(of, canon, key, draw), text[start:end])]
        at = end
    return ("".join([*out, text[at:]]) if found else text), found


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, start_at, end_at, kind, canon) for every mention."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(d, k, *m) for d, k, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for m in mentions(t)]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["doc_id", "text_key", "start_at", "end_at", "kind", "canon"])

    return map_arrow(_source(docs), run, "doc_id long, text_key long, start_at int, end_at int, kind string, canon string")


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canon) to (kind, canon, draw, new): replacements that clash neither with each other nor with an entity.

    Kinds of names share one space, so that no two names become one.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        kinds, canons, draws = (c.to_pylist() for c in batch.columns)
        new = [surrogate(k, c, key, n) for k, c, n in zip(kinds, canons, draws, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=["kind", "canon", "draw", "new"])

    drawn = lambda df: map_arrow(df.select("kind", "canon", "draw"), run, "kind string, canon string, draw int, new string")
    space = F.substring_index("kind", "_", 1)
    state = materialize(drawn(entities.select("kind", "canon", F.lit(0).alias("draw"))), "draws")
    real = state.select(space.alias("s"), F.col("canon").alias("c")).distinct()
    real = materialize(real, "entities")
    for _ in range(MOST_DRAWS):
        # of those that drew the same, the one that settled first keeps it
        first = Window.partitionBy(space, "new").orderBy("draw", "kind", "canon")
        judged = state.withColumn("nth", F.row_number().over(first)).join(real, (space == F.col("s")) & (F.col("new") == F.col("c")), "left")
        judged = materialize(judged.select("kind", "canon", "draw", "new", ((F.col("nth") > 1) | F.col("c").isNotNull()).alias("clash")), "judged")
        if not judged.where("clash").limit(1).count():
            release(judged)
            return state
        again = drawn(judged.where("clash").withColumn("draw", F.col("draw") + 1))
        before, state = state, materialize(judged.where("NOT clash").select("kind", "canon", "draw", "new").unionByName(again), "draws")
        release(before)
        release(judged)
    raise RuntimeError(f"{MOST_DRAWS} draws of surrogates clash")


def settled_names(names: DataFrame) -> DataFrame:
    """(canon, settled): one kind for each name of the corpus. A given name has the gender of its titles, none if they differ; other names are family names
    where they are nothing else anywhere. names: kind, canon."""
    seen = {k: F.bool_or(F.col("kind") == f"name_{k}").alias(k) for k in "mfs"}
    kind = F.when(F.col("m") & F.col("f"), "name_n").when(F.col("m"), "name_m").when(F.col("f"), "name_f").when(F.col("s"), "name_s").otherwise("name_n")
    return names.groupBy("canon").agg(*seen.values()).select("canon", kind.alias("settled"))


def configured_key(spark: SparkSession) -> bytes:
    """The key of the session's setting ``spark.quernstone.pii.key``; there is no default."""
    key = spark.conf.get("spark.quernstone.pii.key", None)
    if not key:
        raise ValueError("spark.quernstone.pii.key must name the secret key of the surrogates")
    return key.encode()


def replace_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text (with surrogates), mentions ARRAY<STRUCT<start_at, end_at, kind>> in the old text.

    Needs columns doc_id and text; others are ignored. A null or empty text stays as it is
    and has no mentions. Texts are read whole. Repeated rows give repeated results, an empty table none.
    ``key`` is the session's by default (see ``configured_key``). Initials are replaced by letters that may repeat.
    """
    key = configured_key(docs.sparkSession) if key is None else key
    found = materialize(find_pii(docs), "mentions")
    entities = materialize(found.where("kind <> 'name_i'").select("kind", "canon").distinct(), "entities")
    is_name = F.col("kind").startswith("name_")
    kinds = entities.where(~is_name).withColumn("settled", F.col("kind")).unionByName(entities.where(is_name).join(settled_names(entities.where(is_name)), "canon"))
    kinds = materialize(kinds, "kinds")
    state = assign(kinds.select(F.col("settled").alias("kind"), "canon").distinct(), key)
    other = kinds.join(state.select(F.col("kind").alias("settled"), "canon", "draw"), ["settled", "canon"]).where((F.col("draw") > 0) | (F.col("kind") != F.col("settled")))
    other = materialize(other.select("kind", "canon", "settled", "draw"), "other")
    own = found.select("doc_id", "text_key", "kind", "canon").distinct().join(sized(other, other.count()), ["kind", "canon"])
    own = materialize(own.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("kind", "canon", "settled", "draw")).alias("draws")), "redrawn")
    own = own.select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "draws")
    rows = _source(docs).join(sized(own, own.count() * 8), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left").select("doc_id", "text", "draws")
    span = pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32()), ("kind", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, spans = [], []
        for text, draws in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            new, old = rewritten(text, {(d["kind"], d["canon"]): (d["settled"], d["draw"]) for d in draws or ()}, key)
            texts.append(new)
            spans.append([{"start_at": a, "end_at": b, "kind": k} for a, b, k, _ in old])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, span)], names=["doc_id", "text", "mentions"])

    return map_arrow(rows, run, "doc_id long, text string, mentions array<struct<start_at:int,end_at:int,kind:string>>")


def pii_report(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    found = replace_pii(docs, key)
    count = lambda kind: F.size(F.filter("mentions", lambda m: m["kind"].startswith(kind))).cast("long")
    spans = F.array_join(F.transform("mentions", lambda m: F.concat_ws(":", m["kind"], m["start_at"], m["end_at"])), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in KINDS), spans.alias("spans"), "text")
