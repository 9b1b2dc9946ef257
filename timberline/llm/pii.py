"""PII surrogates: found entities get keyed replacements of the same type, gender, script and format.

1. Texts are scanned once for e-mail addresses, phone, card and social security
   numbers, IBANs, IP addresses, credentials and person names (after an honorific, or a known
   given name with a capitalised surname; then every capitalised mention of these words in the
   same text). Each entity has a canonical form, so that one entity has one surrogate in every
   text, spelling and letter case; names go word by word and by script, so "Ms. Mary Stone" and
   "Stone" agree. Part and gender of a name are settled over all its mentions.
2. The distinct entities of the corpus draw surrogates from a keyed hash. A draw
   fails if another entity has it or if it is itself an entity of the corpus; who
   fails draws again, so distinct entities stay distinct. Entities are one table, checked by grouping
   and joins.
3. The replacements are put into the texts in the surface form of what they replace:
   separators, letter case, honorifics, Luhn validity of cards and check digits of IBANs stay.

Defined results: null texts stay null; texts without entities stay as they are; equal
rows have equal results; a null doc_id is a value like another; very long texts are scanned whole, in linear time; an
empty table gives no rows; an input column ``n_replaced`` is replaced.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from hashlib import blake2b
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.llm import kernels as K
from timberline.llm.cluster import BROADCAST_BYTES, broadcast_if, lean, materialize

# ---- fixed values: names that are known and drawn, by script and gender
GIVEN = {
    ("latin", "f"): "Mary Anna Emma Laura Julia Sophie Marie Clara Elena Lucia Carmen Sofia Alice Helen Nora Ingrid Paula Irene Teresa Camille Margaret Sarah Linda Susan".split(),
    ("latin", "m"): "John James Robert Michael David Thomas Peter Paul Martin Stefan Hans Karl Jean Pierre Louis Carlos Juan Pablo Miguel Antonio William Daniel George Henry".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Вера Дарья".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай Андрей Михаил Павел Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Κατερίνα".split(),
    ("greek", "m"): "Γιώργος Νίκος Κώστας Δημήτρης Γιάννης Παύλος".split(),
}
SURNAMES = {
    "latin": "Miller Carter Bennett Foster Hughes Palmer Keller Brandt Vogel Lindner Moreau Girard Lambert Fontaine Navarro Ortega Serrano Vidal Castro Morales Warren Sutton Fischer Roussel".split(),
    "cyrillic": "Соколов Лебедев Морозов Волков Зайцев Павлов Орлов Макаров Никитин Захаров".split(),
    "greek": "Παπαδόπουλος Νικολάου Γεωργίου Δημητρίου Ιωάννου Αντωνίου".split(),
}
HONORIFICS = {
    "Mr.": "m", "Mr": "m", "Mrs.": "f", "Mrs": "f", "Ms.": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Madam": "f", "Herr": "m", "Herrn": "m", "Frau": "f", "Monsieur": "m", "Madame": "f",
    "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr.": "m", "Sra.": "f", "Dr.": "n", "Prof.": "n", "г-н": "m", "г-жа": "f", "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба бе бо ва ве да де до ка ко ла ле ма ме мо на не но па ра ре ро са се со та те то".split(),
    "greek": "βα βε γα γε δα δε κα κε λα λε μα με να νε πα πε ρα ρε σα σε τα τε".split(),
}
_ENDINGS = {("latin", "f"): "na", ("latin", "m"): "rik", ("latin", "n"): "ren", ("cyrillic", "f"): "на", ("cyrillic", "m"): "рик", ("cyrillic", "n"): "ей", ("greek", "f"): "να", ("greek", "m"): "ρος", ("greek", "n"): "ις"}

# fixed values: calling codes of one and two digits; all others have three
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_WORD = r"[^\W\d_]+(?:['’-][^\W\d_]+)*"
_LOCAL = "A-Za-z0-9À-ɏͰ-ϿЀ-ӿ"
_EMAIL = re.compile(rf"(?<![{_LOCAL}._%+\-])[{_LOCAL}._%+\-]++@(?:[{_LOCAL}\-]++\.)+[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]{{2,24}}(?![{_LOCAL}])")
_IS = r"(?:\\?[\"'])?\s{0,3}(?::=|=>|={1,3}|:)\s{0,3}"
#: What stands after a password keyword, to the closing quote or the end of the word, whatever it is.
_PASSWORD = re.compile(rf"(?i)(?<![a-z])(?:password|passwd|passphrase|pwd){_IS}(?:\"([^\"\n]+)\"|'([^'\n]+)'|(?:\\?[\"'])?((?:(?!&\w+=)[^\s\"'<>])+))")
_KEYED = re.compile(rf"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret(?:[_-]?key)?){_IS}(?:\\?[\"'])?([^\s\"'<>,;&(){{}}\[\]|\\]{{12,}})")
_SHAPED = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_\-]{20,}|gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})|(?<![A-Za-z0-9_\-])eyJ[A-Za-z0-9_\-]+(?:\.[A-Za-z0-9_\-]+)+")
_NUMBER = re.compile(
    rf"(?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))"
    rf"|(?P<ip>(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d))"
    r"|(?P<phone>\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[\-.]\d{4}(?!\d)|(?<![\d.\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\d\-]))"
    r"|(?P<card>(?<![\d.])(?:\d{13,19}|\d{4}(?P<gap>[ \-])\d{4}(?P=gap)\d{4}(?P=gap)\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d))"
)
_GROUPS = r"(?:[0-9A-Fa-f]{0,4}:){2,8}(?:(?:\d{1,3}\.){3}\d{1,3}|[0-9A-Fa-f]{0,4})"
_IPV6 = re.compile(rf"(?<![0-9A-Za-z_.:])(?:({_GROUPS})|\w{{1,40}}:({_GROUPS}))(?!:?[0-9A-Za-z_])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])")
_TITLED = re.compile(rf"(?<!\w)(?P<title>{'|'.join(sorted(map(re.escape, HONORIFICS), key=len, reverse=True))})(?:\s(?:Dr\.|Prof\.))?\s(?P<name>{_WORD}(?:\s{_WORD}){{0,2}})")
_KNOWN = {n.casefold(): (script, gender) for (script, gender), names in GIVEN.items() for n in names}
_GIVEN = re.compile(rf"(?<!\w)(?:{'|'.join(sorted((n for names in GIVEN.values() for n in names), key=len, reverse=True))})(?:\s{_WORD}){{1,2}}")


#: Words that can stand capitalised behind a name and are none: they make no mention elsewhere.
_COMMON = frozenset(
    "the a an and or but in on at of to for from by with as is was are were he she it they we you his her this that these those not no yes if when while who what where how why "
    "der die das ein eine und oder aber im am von zu mit aus ist war sind er sie es wir ihr nicht le la les un une des et ou mais dans sur de du pour par avec est il elle nous vous ce "
    "el los las una y o pero en con por para es son no se lo su и в на с по не он она они мы вы это но а ο η το και οι τα".split()
)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 or 0x1F00 <= c < 0x2000 else "latin"


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; 0 for valid numbers."""
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def _iban_left(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def _groups(address: str) -> list[int]:
    n = int(IPv6Address(address))
    return [n >> k & 0xFFFF for k in range(112, -1, -16)]


def _capitalised(words: list[str]) -> int:
    """How many of the first words are written as names are."""
    n = 0
    for w in words:
        if not w[0].isupper() or (len(w) == 1 and n == 0):
            break
        n += 1
    return n


def _bare(word: str) -> str:
    """Without the ending of a possessive."""
    return re.sub(r"['’][sS]?$", "", word)


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Names where they are introduced, then every other capitalised mention of their words in the text."""
    found = [(m.start("name"), m["name"], HONORIFICS[m["title"]], True) for m in _TITLED.finditer(text)]
    found += [(m.start(), m[0], _KNOWN[m[0].split()[0].casefold()][1], False) for m in _GIVEN.finditer(text)]
    out, told = [], {}
    for start, name, gender, titled in found:
        words = [(start + m.start(), _bare(m[0])) for m in re.finditer(_WORD, name)]
        n = _capitalised([w for _, w in words])
        if n == 0 or (not titled and n == 1):
            continue
        for k, (at, w) in enumerate(words[:n]):
            script = script_of(w)
            known = _KNOWN.get(w.casefold())
            kind = f"given:{script}:{known[1] if known else gender}" if k < n - 1 or (known and not titled) else f"surname:{script}"
            out.append((at, at + len(w), kind, w.casefold()))
            if len(w) > 1 and w.casefold() not in _COMMON:
                told.setdefault(w.casefold(), kind)
    if told:
        for m in re.finditer(_WORD, text):
            if m[0][0].isupper() or not m[0].isalpha():
                whole = _bare(m[0])
                # a name of several parts is a mention as a whole, or else by its parts
                parts = [(m.start(), whole)] if whole.casefold() in told else [(m.start() + x.start(), x[0]) for x in re.finditer(r"[^\W\d_]+", m[0])]
                for at, w in parts:
                    kind = told.get(w.casefold()) if w[0].isupper() else None
                    # "The Mary" is a ship or a title
                    if kind and not (kind.startswith("given:") and re.search(r"(?<!\w)The\s$", text[max(0, at - 5) : at])):
                        out.append((at, at + len(w), kind, w.casefold()))
    return out


def _secrets(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Passwords as they are; behind other keywords and by shape what is not a plain word."""
    for m in _PASSWORD.finditer(text):
        value = m[m.lastindex] if m.lastindex < 3 else m[3].rstrip(".,;:!?)]}\\") or m[3]
        if value.strip("*•.…_- "):
            yield m.start(m.lastindex), m.start(m.lastindex) + len(value), "secret", value
    for m in _KEYED.finditer(text):
        value = m[1].rstrip(".:!?")
        if len(value) >= 12 and (len(value) >= 20 or any(c.isdigit() for c in value) or re.search(r"[a-z][A-Z]", value)):
            yield m.start(1), m.start(1) + len(value), "secret", value
    for m in _SHAPED.finditer(text):
        if any(c.isdigit() for c in m[0]):
            yield m.start(), m.end(), "secret", m[0]


def _ipv6(text: str) -> Iterator[tuple[int, int, str, str]]:
    """Addresses in every spelling, but for ``::``, ``::1`` and their like, which are nobody's (and slices in code)."""
    for m in _IPV6.finditer(text):
        s = m[m.lastindex]
        s = s[:-1] if s[-1] == ":" and (s[-2:] != "::" or s[-3:] == ":::") else s
        try:
            address = IPv6Address(s)
        except ValueError:
            continue
        if (int(address) >= 1 << 32 or "." in s) and re.search(r"\d|[A-Fa-f]{3}", s):
            yield m.start(m.lastindex), m.start(m.lastindex) + len(s), "ipv6", address.compressed


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, canonical form) of the entities, in order, without overlaps; earlier kinds win."""
    got: list[tuple[int, int, str, str]] = []
    if any(x in text for x in ("=", ":", "AKIA", "sk-", "gh", "eyJ")):
        got += _secrets(text)
    if "::" in text or text.count(":") >= 7:
        got += _ipv6(text)
    if "@" in text:
        got += [(m.start(), m.end(), "email", m[0].lower()) for m in _EMAIL.finditer(text)]
    if re.search(r"\d", text):
        got += [(m.start(), m.end(), "iban", code) for m in _IBAN.finditer(text) if 15 <= len(code := m[0].replace(" ", "")) <= 34 and _iban_left(code) == 1]
        for m in _NUMBER.finditer(text):
            kind = next(k for k in ("ssn", "ip", "phone", "card") if m[k])
            digits = re.sub(r"\D", "", m[0])
            if kind == "card" and len(digits) != 16 and luhn(digits):
                continue
            if kind == "phone" and m[0][0] == "+":
                digits = re.sub(r"\D", "", m[0].replace("(0)", ""))
                code = next((digits[:k] for k in (1, 2) if digits[:k] in CALLING_CODES), digits[:3])
                got.append((m.start(), m.end(), kind, f"+{code} {digits[len(code) :]}"))
            else:
                got.append((m.start(), m.end(), kind, m[0] if kind == "ip" else digits))
    got += _names(text)
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []
    for x in got:
        i = bisect.bisect_left(taken, (x[0], x[1]))
        if (i and taken[i - 1][1] > x[0]) or (i < len(taken) and taken[i][0] < x[1]):
            continue
        taken.insert(i, (x[0], x[1]))
        out.append(x)
    return sorted(out)


class Draw:
    """A stream of choices from a keyed hash."""

    def __init__(self, key: bytes, *parts: object):
        self.key, self.seed, self.left, self.turn = key, "\0".join(map(str, parts)).encode(), 0, 0
        self.pool = 1

    def below(self, n: int) -> int:
        if self.pool < n << 32:
            block = blake2b(self.seed + self.turn.to_bytes(4, "big"), key=self.key, digest_size=64).digest()
            self.left, self.pool, self.turn = int.from_bytes(block, "big"), 1 << 512, self.turn + 1
        self.left, out = divmod(self.left, n)
        self.pool //= n
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def alike(self, s: str) -> str:
        """Digits for digits and letters for letters; hex letters stay hex in hex strings."""
        hexes = re.fullmatch(r"[0-9a-fA-F]+", s) is not None
        return "".join(str(self.below(10)) if c in "0123456789" else chr(ord("a" if c >= "a" else "A") + self.below(6 if hexes else 26)) if c.isascii() and c.isalpha() else c for c in s)


def surrogate(key: bytes, kind: str, canonical: str, attempt: int) -> str:
    """The canonical surrogate of an entity at this attempt. More attempts widen what can be drawn: where the format's own
    length leaves too few, surrogates grow by a digit an attempt, so that drawing ends however many entities there are."""
    d, more = Draw(key, kind, canonical, attempt), max(0, attempt - 6)
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels = domain.split(".")
        # other letters than those from a to z are drawn from these, too
        local = "".join("z" if c.isalnum() and not c.isascii() else c for c in local)
        return d.alike((local if len(local) + attempt > 7 else (local + "abcdefgh")[: 8 + attempt]) + "z" * more) + "@" + d.alike("mail") + str(d.below(100)) + ".example." + labels[-1]
    if kind == "ip":
        # beyond what addresses there are the first part grows
        return ".".join(str(1 + d.below(254)) for _ in range(4)) if not more else f"{255 + d.below(100**more)}." + ".".join(str(1 + d.below(254)) for _ in range(3))
    if kind == "ipv6":
        # groups of zeros stay, unless too few others are left to draw from
        return IPv6Address(":".join(f"{1 + d.below(65535):x}" if g or attempt > 3 else "0" for g in _groups(canonical))).compressed
    if kind == "ssn":
        return "9" + d.digits(8 + more)
    if kind == "card":
        body = canonical[0] + d.digits(len(canonical) - 2 + more)
        want = luhn(canonical) == 0
        last = [c for c in "0123456789" if (luhn(body + c) == 0) == want]
        return body + last[d.below(len(last))]
    if kind == "phone":
        code, gap, rest = canonical.rpartition(" ")
        return code + gap + (str(1 + d.below(9)) if rest[0] != "0" else "0") + d.digits(len(rest) - 1 + more)
    if kind == "iban":
        body = d.alike(canonical[4:] + "9" * more)
        return canonical[:2] + f"{98 - _iban_left(canonical[:2] + '00' + body):02d}" + body
    if kind == "secret":
        head = re.match(r"AKIA|sk-|gh[pousr]_|github_pat_|eyJ", canonical)
        body = "".join("z" if c.isalnum() and not c.isascii() else c for c in canonical[head.end() if head else 0 :])
        # short ones grow, and ones of signs alone turn to letters
        body = body if any(c.isalnum() for c in body) else "z" * len(body)
        return (head[0] if head else "") + d.alike(body + "z" * (attempt // 2))
    what, script, *gender = kind.split(":")
    pool = SURNAMES[script] if what == "surname" else GIVEN.get((script, gender[0])) or GIVEN[script, "f"] + GIVEN[script, "m"]
    if attempt < 2:
        return pool[d.below(len(pool))].casefold()
    stem = "".join(_SYLLABLES[script][d.below(len(_SYLLABLES[script]))] for _ in range(2 + attempt // 4))
    return stem + (_ENDINGS[script, gender[0]] if gender else _SYLLABLES[script][d.below(8)] + ("н" if script == "cyrillic" else "ν" if script == "greek" else "n"))


def render(surface: str, kind: str, new: str) -> str:
    """The canonical surrogate in the form of the surface."""
    if kind in ("ssn", "card", "phone", "iban"):
        code, _, rest = new.partition(" ") if kind == "phone" and " " in new else ("", "", new)
        chars = iter(rest)
        # the zero in brackets is no digit of the number; what is longer than the surface follows on it
        parts = re.split(r"(\(0\))", surface[len(code) :]) if code else [surface]
        return code + "".join(x if x == "(0)" and code else "".join(next(chars) if c.isalnum() else c for c in x) for x in parts) + "".join(chars)
    if kind == "ipv6":
        groups = _groups(new)
        if "." in surface:
            head = ":".join(f"{g:x}" for g in groups[:6]) if any(groups[:5]) or "::" not in surface else f"::{groups[5]:x}"
            new = head + ":" + ".".join(str(x) for g in groups[6:] for x in (g >> 8, g & 255))
        elif "::" not in surface:
            new = ":".join(f"{g:04x}" if all(len(x) == 4 for x in surface.split(":")) else f"{g:x}" for g in groups)
    if kind.startswith(("given", "surname")):
        return new.upper() if surface.isupper() and len(surface) > 1 else "-".join(w[:1].upper() + w[1:] for w in new.split("-"))
    return new.upper() if kind != "secret" and surface.isupper() else new


def _space(kind):
    """Where surrogates must differ: names of a script share one space, whatever part or gender."""
    return F.when(kind.rlike("^(given|surname):"), F.concat(F.lit("name:"), F.split_part(kind, F.lit(":"), F.lit(2)))).otherwise(kind)


def resolve(mentions: DataFrame) -> DataFrame:
    """kind and canonical, a row an entity: a name is a given name if it is one anywhere, of the gender that all its mentions which tell one agree on, else of none."""
    gender = F.split_part("kind", F.lit(":"), F.lit(3))
    told = F.array_sort(F.collect_set(F.when(gender.isin("f", "m"), gender)))
    rows = mentions.withColumn("space", _space(F.col("kind"))).groupBy("space", "canonical").agg(F.max(F.col("kind").startswith("given:")).alias("given"), told.alias("told"), F.min("kind").alias("kind"))
    script = F.split_part("space", F.lit(":"), F.lit(2))
    kind = F.when(~F.col("space").startswith("name:"), F.col("kind")).when(F.col("given"), F.concat(F.lit("given:"), script, F.lit(":"), F.when(F.size("told") == 1, F.col("told")[0]).otherwise("n"))).otherwise(F.concat(F.lit("surname:"), script))
    return rows.select(kind.alias("kind"), "canonical")


_SPAN = T.StructType([T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("canonical", pa.string())])
    for batch in batches:
        mark, texts = batch.columns
        rows, spans = [], []
        for i in range(batch.num_rows):
            found = find(texts[i].as_py() or "")
            if found:
                rows.append(mark[i].as_py())
                spans.append([dict(zip(("begin", "end", "kind", "canonical"), x, strict=True)) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string()), pa.array(spans, pa.list_(span))], names=["mark", "spans"])


def settle(entities: DataFrame, key: bytes) -> DataFrame:
    """kind, canonical, surrogate: all distinct in surrogate among a kind, or all names of a script, and none of them an entity."""

    def draw(attempt: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, names = (c.to_pylist() for c in batch.columns)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, k, c, attempt) for k, c in zip(kinds, names, strict=True)], pa.string())], names=["kind", "canonical", "surrogate"])

        return run

    entities = entities.withColumn("space", _space(F.col("kind")))
    taken = entities.select("space", F.col("canonical").alias("surrogate"))
    todo, done, attempt = entities.select("kind", "canonical"), None, 0
    while True:
        drawn = todo.mapInArrow(lean(draw(attempt)), "kind string, canonical string, surrogate string").withColumn("space", _space(F.col("kind")))
        first = drawn.groupBy("space", "surrogate").agg(F.min_by(F.struct("kind", "canonical"), F.struct("canonical", "kind")).alias("e"))
        free = first.join(taken, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done.select(_space(F.col("kind")).alias("space"), "surrogate"), ["space", "surrogate"], "left_anti")
        free = materialize(free.select("e.kind", "e.canonical", "surrogate"), "surrogates")
        todo = materialize(todo.join(free, ["kind", "canonical"], "left_anti"), "surrogates-left")
        done = free if done is None else done.union(free)
        if todo.isEmpty():
            return done
        attempt += 1


def replacements(docs: DataFrame, key: bytes, *, text: str = "text", most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """mark (the MD5 digest of the text) and parts: begin, end, kind and surrogate of each entity, in order."""
    base = docs.select(F.md5(text).alias("mark"), F.col(text).alias("text"))
    occurrences = materialize(base.mapInArrow(lean(_scan), T.StructType([T.StructField("mark", T.StringType()), T.StructField("spans", T.ArrayType(_SPAN))])), "entities")
    each = occurrences.select("mark", F.explode("spans").alias("s")).select("mark", "s.*").distinct()
    entities = materialize(resolve(each.select("kind", "canonical").distinct()), "distinct-entities")
    settled = materialize(settle(entities, key).withColumn("space", _space(F.col("kind"))), "settled")
    told = each.withColumn("space", _space(F.col("kind"))).drop("kind").join(broadcast_if(settled, most_broadcast), ["space", "canonical"])
    return materialize(told.groupBy("mark").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "kind", "surrogate"))).alias("parts")), "replacements")


def pseudonymise(docs: DataFrame, key: bytes, *, text: str = "text", most_broadcast: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` with surrogates in column ``text``, and n_replaced."""
    parts = replacements(docs, key, text=text, most_broadcast=most_broadcast)
    others = [c for c in docs.columns if c not in (text, "n_replaced")]
    rows = docs.select(*others, F.md5(text).alias("__mark"), F.col(text).alias("__text")).join(broadcast_if(parts.withColumnRenamed("mark", "__mark").withColumnRenamed("parts", "__parts"), most_broadcast), "__mark", "left")

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offs = K.buffers(batch.column("__text"))
            for lo, hi in K.row_slices(offs):
                part = batch.slice(lo, hi - lo)
                texts, lists = part.column("__text").to_pylist(), part.column("__parts").to_pylist()
                for i, found in enumerate(lists):
                    if found:
                        at, out, t = 0, [], texts[i]
                        for x in found:
                            out += [t[at : x["begin"]], render(t[x["begin"] : x["end"]], x["kind"], x["surrogate"])]
                            at = x["end"]
                        texts[i] = "".join([*out, t[at:]])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in others), pa.array(texts, pa.string()), pa.array([len(x or ()) for x in lists], pa.int64())], names=[*others, text, "n_replaced"])

    schema = T.StructType([*(docs.schema[c] for c in others), T.StructField(text, T.StringType()), T.StructField("n_replaced", T.LongType())])
    return rows.drop("__mark").mapInArrow(lean(replace), schema)
