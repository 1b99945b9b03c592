"""Personal data replaced by keyed, type-consistent surrogates (operator 3)."""

from __future__ import annotations

import hmac
import re
import unicodedata
import warnings
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cambium.llm.common import batched, durable, fresh, told_apart

#: Session setting that holds the key where none is given, and the key of demonstrations: whoever knows it can search for the originals.
KEY_SETTING, DEMONSTRATION_KEY = "spark.cambium.surrogate.key", "a demonstration, not a secret"
#: Attempts within the format of the original; each later one has a character (in an address, every eighth one an octet) more.
IN_FORMAT = 16

# Given names that are recognised without a title or a cue. `names` of `pseudonymise` adds to them.
KNOWN = {
    "m": """James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew Kenneth George Kevin Brian Edward Peter
    Hans Karl Jürgen Klaus Wolfgang Stefan Uwe Dieter Pierre Jean Michel Philippe Jacques Luis Carlos Miguel José Juan Javier Pedro Giovanni Marco Luca Piotr Andrzej
    Ivan Dmitri Sergei Alexei Vladimir Mohammed Ahmed Omar Ali Hassan Raj Amit Rahul Wei Jun Hiroshi Kenji Takashi Minho Kwame
    Иван Пётр Алексей Дмитрий Сергей Николай Михаил Андрей Владимир Γιώργος Νίκος Δημήτρης Κώστας Παύλος Ανδρέας""".split(),
    "f": """Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Geraldine Helen Anna Emma Laura Julia
    Maria Greta Heidi Ursula Sabine Monika Petra Claire Sophie Isabelle Nathalie Carmen Lucia Elena Pilar Giulia Chiara Francesca Agnieszka Katarzyna
    Olga Natalia Svetlana Tatiana Irina Fatima Aisha Layla Priya Anjali Mei Yuki Sakura Keiko Soo-jin Amara
    Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Μαρία Ελένη Σοφία Άννα Κατερίνα Χριστίνα""".split(),
}
# Parts of which surrogates are made, by script; none of the made names is in KNOWN.
STEMS = {
    "latin": "bren cal dor fel gar hal jor kel lor mav nor per quil ros sel tar ul vel wend yor zel".split(),
    "cyrillic": "бор вел гор дар жел зор кал лод мир нев рад сев тор яр".split(),
    "greek": "αλκ βαρ γαλ δαν ζην καλ λυκ μελ νερ ορθ πελ ροδ σελ τερ".split(),
}
GIVEN_ENDINGS = {
    ("latin", "m"): "an en ic or us wyn".split(), ("latin", "f"): "ana elle ette ia ina ora".split(),
    ("cyrillic", "m"): "ан ей ий ин ор".split(), ("cyrillic", "f"): "ана ая ея ина ия".split(),
    ("greek", "m"): "ανος ης ιος ων".split(), ("greek", "f"): "άνα εια ίνα ώ".split(),
}
GIVEN = {key: [stem + end for stem in STEMS[key[0]] for end in ends] for key, ends in GIVEN_ENDINGS.items()}
SYLLABLES = {
    "latin": "bar ken lin mor tal ver han sol del rin gar pet nor win ros mel tor lan ber fal".split(),
    "cyrillic": "бар вол кар лин мор нов пет рос сол тар".split(),
    "greek": "βαρ καλ λιν μορ νικ παπ ρος σολ ταρ φιλ".split(),
}
ENDINGS = {"latin": ("", ""), "cyrillic": ("ов", "ова"), "greek": ("ίδης", "ίδου")}
TITLES = {"m": "Mr Herr Monsieur Señor Sr Sir г-н Κύριος".split(), "f": "Mrs Ms Miss Frau Madame Mme Señora Sra Madam г-жа Κυρία".split(), "u": "Dr Prof".split()}
# Words after which two capitalised words are a name.
CUES = r"(?i:my name is|name is|named|call me|contact(?: person)?|signed(?: by)?|written by|author|dear|regards|sincerely|attn|name|patient|customer|ich heiße|je m['’]appelle|me llamo|меня зовут|με λένε)"

_GENDER_OF_TITLE = {t: g for g, titles in TITLES.items() for t in titles}
_GENDER_OF_GIVEN = {n: g for g, names in KNOWN.items() for n in names}
_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀĂĄĆČĎĐĒĘĚĞĪİŁŃŇŌŘŚŞŠŤŪŮŹŻŽΆΈ-ΏΑ-ΩЀ-Я]"
_WORD = rf"{_CAPITAL}[^\W\d_]+(?:[-'’]{_CAPITAL}?[^\W\d_]+)*"
_LABEL = r"(?:[^\W_]|-)+"
NUMBERS = re.compile(
    rf"""(?P<email>(?<![\w.+-])[^\W_][\w.+%-]*@{_LABEL}(?:\.{_LABEL})*\.[^\W\d_]{{2,}}(?![\w-]))
    |(?P<iban>(?<!\w)[A-Z]{{2}}[0-9]{{2}}(?:[ ]?[A-Z0-9]{{4}}){{2,7}}(?:[ ]?[A-Z0-9]{{1,3}})?(?!\w))
    |(?P<ip>(?<![\w.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![\w]|\.[0-9]))
    |(?P<ssn>(?<![\w-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\w-]))
    |(?P<card>(?<![\w.+-])(?:[0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|[0-9]{{13,19}})(?![\w-]))
    |(?P<phone>(?<![\w.+])(?:(?:\+[0-9]{{1,3}}[ .-]?)?(?:\([0-9]{{2,4}}\)[ .-]?|[0-9]{{2,4}}[ .-])(?:[0-9]{{2,4}}[ .-])?[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}
        |(?:\+[0-9]{{1,3}}[ .-]?[1-9]|0[1-9])(?:[ .-]?[0-9]{{2}}){{4}}|\+[0-9]{{9,15}})(?![\w-]))""",
    re.X,
)
NAMES = re.compile(rf"(?:\b({'|'.join(sorted(_GENDER_OF_TITLE, key=len, reverse=True))})\.?[ ]({_WORD}(?:[ ]{_WORD})?))|(?:\b{CUES}[:,]?[ \n]({_WORD})[ ]({_WORD}))|({_WORD})[ ]({_WORD})")
_HINT, _PAIR = re.compile(r"[0-9@]"), re.compile(rf"[^\W\d_]\.?[ ]{_CAPITAL}")


def key_of(spark: SparkSession) -> bytes:
    """The key of surrogates, from the session setting; without it the demonstration key, with a warning."""
    key = spark.conf.get(KEY_SETTING, "")
    if not key:
        warnings.warn(f"{KEY_SETTING} isn't set: surrogates are made with a key that is public", stacklevel=2)
    return (key or DEMONSTRATION_KEY).encode()


def script(word: str) -> str:
    name = unicodedata.name(word[0], "")
    return "cyrillic" if name.startswith("CYRILLIC") else "greek" if name.startswith("GREEK") else "latin"


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _gender(given: str, names: dict[str, str]) -> str:
    """Of a given name: as known; otherwise the ending that is feminine in most of the languages, or unknown."""
    return names.get(given) or ("f" if given[-1] in "aаяα" else "u")


def entities(text: str | None, names: dict[str, str] | None = None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form), in order, without overlaps; equal normal forms of a kind are one entity.

    names: known given names with their gender (m, f or u), beside KNOWN.
    """
    if not text:
        return []
    out: list[tuple[int, int, str, str]] = []
    if _HINT.search(text):
        for m in NUMBERS.finditer(text):
            kind, value = m.lastgroup, m[0]
            if kind == "ip":
                if any(int(x) > 255 for x in value.split(".")):
                    continue
                normal = ".".join(str(int(x)) for x in value.split(".")) if all(x == "0" or x[0] != "0" for x in value.split(".")) else value
            elif kind == "email":
                normal = value.lower()
            elif kind == "iban":
                normal = value.replace(" ", "")
            else:
                normal = _only_digits(value)
                if kind == "phone" and not 9 <= len(normal) <= 15:
                    continue
            out.append((m.start(), m.end(), kind, normal))
    if _PAIR.search(text):
        known = _GENDER_OF_GIVEN | names if names else _GENDER_OF_GIVEN
        taken = [(a, b) for a, b, *_ in out]
        for m in NAMES.finditer(text):
            if m[1]:
                gender, words, at = _GENDER_OF_TITLE[m[1]], m[2].split(" "), m.start(2)
                if len(words) == 2 and gender == "u":
                    gender = _gender(words[0], known)
            elif m[3]:
                gender, words, at = _gender(m[3], known), [m[3], m[4]], m.start(3)
            elif m[5] in known:
                gender, words, at = known[m[5]], [m[5], m[6]], m.start(5)
            else:
                continue
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            for i, w in enumerate(words):
                part = "given" if i == 0 and len(words) == 2 else "surname"
                out.append((at, at + len(w), f"{part}:{gender if part == 'given' or script(w) != 'latin' else 'u'}:{script(w)}", w.casefold()))
                at += len(w) + 1
    return sorted(out)


def _stream(key: bytes, kind: str, normal: str, attempt: int) -> Iterator[int]:
    block = 0
    while True:
        yield from hmac.digest(key, f"{kind}|{normal}|{attempt}|{block}".encode(), "sha256")
        block += 1


def _like(char: str, byte: int) -> str:
    """A character of the same class."""
    if char.isdigit():
        return str(byte % 10)
    if "a" <= char <= "z":
        return chr(97 + byte % 26)
    if "A" <= char <= "Z":
        return chr(65 + byte % 26)
    if char.isalpha():
        letters = {"cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}.get(script(char), "abcdefghijklmnopqrstuvwxyz")
        return letters[byte % len(letters)]
    return char


def luhn(digits: str) -> bool:
    return not sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The keyed replacement of a normal form, of the same type; `attempt` chooses another.

    The first IN_FORMAT attempts keep the format; the later ones are longer and longer, so that a free one is found even
    when all values of a format occur.
    """
    stream, more = _stream(key, kind, normal, attempt), max(0, attempt - IN_FORMAT + 1)
    pick = lambda n: (next(stream) * 65536 + next(stream) * 256 + next(stream)) % n
    if kind.startswith(("given", "surname")):
        part, gender, letters = kind.split(":")
        parts = "".join(SYLLABLES[letters][pick(len(SYLLABLES[letters]))] for _ in range(attempt // 2 if part == "given" else 2 + attempt // 2))
        if part == "given":
            pool = GIVEN.get((letters, gender)) or GIVEN[letters, "m"] + GIVEN[letters, "f"]
            return parts + pool[pick(len(pool))]
        return parts + ENDINGS[letters][gender == "f"]
    if kind == "ip":
        low, high = {1: 1, 2: 10, 3: 100}, {1: 9, 2: 99, 3: 254}
        if attempt < 8:
            return ".".join(str(low[n] + pick(high[n] - low[n] + 1)).zfill(n) for n in map(len, normal.split(".")))
        return ".".join(str(1 + pick(254)) for _ in range(4 + more // 8))
    if kind == "email":
        name, _, top = normal.rpartition(".")
        local, _, domain = name.partition("@")
        return "".join(_like(c, next(stream)) for c in local) + "".join(_like("a", next(stream)) for _ in range(more)) + "@" + "".join(_like(c, next(stream)) for c in domain) + "." + top
    if kind == "iban":
        rest = "".join(_like(c, next(stream)) for c in normal[4:] + "0" * more)
        return normal[:2] + (_iban_check(normal[:2], rest) if _iban_check(normal[:2], normal[4:]) == normal[2:4] else normal[2:4]) + rest
    fixed = len(normal) - 10 if kind == "phone" and len(normal) > 10 else 0  # the country's code
    made = normal[:fixed] + "".join(_like(c, next(stream)) for c in normal[fixed:] + "0" * more)
    if kind == "card":
        made = str(1 + next(stream) % 9) + made[1:]
        if luhn(normal):
            made = next(made[:-1] + d for d in "0123456789" if luhn(made[:-1] + d))
    return made


def rendered(found: str, kind: str, new: str) -> str:
    """The surrogate in the format of one occurrence: its separators and its case."""
    if kind.startswith(("given", "surname")):
        return new.upper() if found.isupper() and len(found) > 1 else "-".join(x.capitalize() for x in new.split("-"))
    if kind == "email" and len(found) == len(new):
        return "".join(n.upper() if f.isupper() else n for f, n in zip(found, new))
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(new)
        shown = "".join(next(left, "") if c.isalnum() else c for c in found)
        return shown + "".join(left)
    return new


_SURROGATES = "kind string, normal string, attempt int, surrogate string"


def surrogates(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, normal) -> (kind, normal, surrogate), one row a distinct entity, distinct within a kind.

    Collision checks, in rounds over what isn't settled: a candidate must differ from every entity of its family (the
    kind without gender and script) that occurs, from every surrogate settled before, and from the other candidates
    (the smallest normal form keeps it); the others try again with the next attempt. No round gives an original away,
    and as later attempts are longer, the rounds end. They are joins on (family, value); nothing is collected.
    """
    real = durable(found.select("kind", "normal").distinct())
    family = F.element_at(F.split("kind", ":"), 1).alias("family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("kind").to_pylist(), b.column("normal").to_pylist(), b.column("attempt").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([surrogate(key, *r) for r in rows], pa.string())], ["kind", "normal", "attempt", "surrogate"])

    taken = real.select(family, F.col("normal").alias("surrogate")).distinct()
    pending, settled, attempt = real.withColumn("attempt", F.lit(0)), [], 0
    while not settled or not pending.isEmpty():
        tried = pending.mapInArrow(run, _SURROGATES).select("kind", "normal", "surrogate", family)
        free = tried.join(taken, ["family", "surrogate"], "left_anti")
        won = durable(free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "normal")).alias("of")).select("family", "of.kind", "of.normal", "surrogate"))
        settled.append(won.select("kind", "normal", "surrogate"))
        taken, attempt = taken.unionByName(won.select("family", "surrogate")), attempt + 1
        pending = durable(pending.join(won, ["kind", "normal"], "left_anti").withColumn("attempt", F.lit(attempt)))
    return reduce(DataFrame.unionByName, settled)


def pseudonymise(docs: DataFrame, key: bytes | None = None, count: str | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """docs with every detected entity in text replaced; n_chars, if there, is counted again; other columns unchanged.

    Kinds: e-mail, IBAN, IPv4, social security number, card, telephone, and names after a title or a cue or with a
    known given name (`names` adds some, with their gender); given names and surnames are entities of their own, so that
    'Mr Smith' and 'John Smith' agree. Equal entities get equal surrogates in all documents, different ones of a kind
    get different ones, and no surrogate is an entity that occurs. key: secret of the surrogates, see `key_of` for none.
    Null and empty texts and texts without entities pass unchanged (a null text stays null); repeated rows stay repeated
    and equal. `count` names a column with the number of entities, in place of one so named. A text is searched once.
    Only documents with entities are shuffled (and those that share their slot of a bitmap): such a text meets its
    surrogates by a hash of the text, and copies of it are counted once.
    """
    spark = docs.sparkSession
    batched(spark)
    secret = key or key_of(spark)
    if count:
        docs = docs.drop(count)
    h, surr = fresh("hash"), fresh("surrogates")
    kind = "array<struct<s:int,e:int,kind:string,normal:string>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [[dict(zip(("s", "e", "kind", "normal"), x)) for x in entities(t, names)] for t in b.column("text").to_pylist()]
            had = pa.array([bool(x) for x in spans], pa.bool_())
            spans = pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("normal", pa.string())])))
            yield pa.RecordBatch.from_arrays([b.column("slot").filter(had), b.column("h").filter(had), spans.filter(had)], ["slot", "h", "spans"])

    slot = F.xxhash64("text")
    found = docs.where("text is not null").select(slot.alias("slot"), F.sha2("text", 256).alias("h"), "text").mapInArrow(search, f"slot long, h string, spans {kind}")
    found = durable(found.groupBy("h").agg(F.first("slot").alias("slot"), F.first("spans").alias("spans")))
    each = durable(found.select("h", F.explode("spans").alias("x")).select("h", "x.*"))
    made = surrogates(each, secret)
    of_text = each.join(made, ["kind", "normal"]).groupBy("h").agg(F.collect_list(F.struct("s", "e", "kind", "surrogate")).alias(surr)).withColumnRenamed("h", h)
    some, rest = told_apart(docs, F.when(F.col("text").isNotNull(), slot), found.select("slot"))
    some = some.withColumn(h, F.sha2("text", 256)).join(of_text, h, "left")
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count, T.IntegerType())] if count else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, totals = [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column(surr).to_pylist()):
                out, at = [], 0
                for x in sorted(spans or [], key=lambda x: x["s"]):
                    out += [text[at : x["s"]], rendered(text[x["s"] : x["e"]], x["kind"], x["surrogate"])]
                    at = x["e"]
                texts.append("".join(out) + text[at:])
                totals.append(len(spans or []))
            new = {n: b.column(n) for n in columns} | {"text": pa.array(texts, b.column("text").type)}
            if "n_chars" in columns:
                new["n_chars"] = pc.if_else(pc.greater(pa.array(totals, pa.int32()), 0), pa.array([len(t) for t in texts], b.column("n_chars").type), b.column("n_chars"))
            if count:
                new[count] = pa.array(totals, pa.int32())
            yield pa.RecordBatch.from_arrays(list(new.values()), list(new))

    return some.mapInArrow(run, schema).unionByName(rest.withColumn(count, F.lit(0)) if count else rest)


def op3_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pseudonymise(docs.select("doc_id", "text"), count="n_entities")
