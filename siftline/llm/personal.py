"""Personal information in free text, replaced by typed placeholders.

E-mail addresses, telephone numbers and street addresses are found by their form. Names and
identity numbers are found by bootstrapped contextual extraction: seeds of certain form (pairs
of words that also make up the record's own user name, address or display name; numbers whose
form is that of one kind of document only) induce lexical patterns, the words beside them;
Spark scores the graph of patterns and instances in turn, over all texts, and patterns and
instances of high score find further ones: first names that no user name shows, and the
labels under which other identity numbers stand.

A name is a known first name beside a surname, in either order, or an initial beside a word
that is no common word. Defined cases: null texts stay null and hold nothing; empty texts stay
empty; texts are read whole; items that overlap count for the kind found first in the order
e-mail, identity number, telephone, address, name; texts made of look-alike characters are
read in their canonical form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.llm import addresses
from siftline.llm.canonical import mapping
from siftline.session import stored

KINDS = ("email", "idnum", "phone", "address", "name")

_EMAIL = re.compile(addresses.EMAIL_RE, re.I)
#: What is no name, by the sign it holds: links, handles, parameters, tags, joined words.
_MASKS = (
    ("://", re.compile(r"https?://\S+", re.I)),
    ("www.", re.compile(r"\bwww\.\S+", re.I)),
    ("@", re.compile(r"(?<!\w)@\w+")),
    ("=", re.compile(r"=[\w.]+")),
    ("<", re.compile(r"<[^<>]*>")),
    ("_", re.compile(r"[^\W_]+_\w+")),
)
_PHONE = regex.compile(
    r"(?<![\p{L}\p{N}#$€£.,/=-])(?<!\d[ .-])(?<!\b(?:ticket|order|ref|id|case|invoice)\s?)"
    r"(?:\+\(?\d(?:[\s().-]{0,2}\d){7,14}|00[\s.-]?[1-9](?:[\s().-]{0,2}\d){7,13}|\(?\d{3}\)?[\s.-]\d{3}[\s.-]\d{4}|\(?0\d{2,4}\)?[\s./-]\d{3,4}[\s.-]?\d{3,5})"
    r"(?![\p{L}\p{N}]|[.-]\d)",
    regex.I,
)
#: Forms of one kind of identity number only: US social security, Brazilian CPF, Spanish DNI and NIE.
_SEED_ID = re.compile(r"(?<![\w.#-])(?:\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2}|\d{8}-?[A-HJ-NP-TV-Z]|[XYZ]-?\d{7}-?[A-Z])(?!\w|-\d)", re.I)
# Words for a street, by language; with what stands before or behind the name.
_BEHIND = r"street|st\.|road|rd\.|lane|ln\.|avenue|ave\.?|court|ct\.|row|drive|dr\.|square|place|way|close|terrace|boulevard|blvd\.?|crescent|alley|walk|mews"
_BEFORE = (
    r"calle|c/|avda\.?(?: de)?|avenida(?: d[aeo]s?)?|av\.(?: d[aeo]s?)?|plaza(?: de)?|paseo(?: de)?|camino(?: de)?|ronda(?: de)?|carrera"
    r"|rua(?: d[aeo]s?)?|travessa(?: d[aeo]s?)?|largo(?: d[aeo]s?)?|praça(?: d[aeo]s?)?|alameda(?: d[aeo]s?)?|estrada(?: d[aeo]s?)?"
    r"|ul\.|ulica|al\.|aleja|os\.|osiedle|pl\.|ул\.|улица|пр\.|пр-т|проспект|пер\.|переулок|бульвар|б-р|шоссе|наб\.|набережная|площадь"
)
_FRENCH = r"rue|avenue|av\.|bd|boulevard|allée|impasse|place|quai|chemin|route|cours|passage|square"
_ADDRESS = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}])(?:"
    rf"(?:[\p{{L}}'’-]+ House, )?\d{{1,5}}[a-z]? (?:[\p{{L}}'’-]+ ){{1,3}}(?:{_BEHIND})(?![\p{{L}}])"
    rf"|\d{{1,5}}(?: ?(?:bis|ter))?,? (?:{_FRENCH}) (?:d[eu] (?:la )?|des |de l['’]|d['’])?[\p{{L}}'’-]+"
    rf"|(?:{_BEFORE})\s?(?:[\p{{L}}'’-]+\.?\s?){{1,4}},?\s?(?:nº|no\.?|n\.?|№|д\.|дом|nr\.?)?\s?\d{{1,5}}[a-z]?"
    rf"|[\p{{L}}-]*\p{{L}}{{2,}}(?:str\.|straße|strasse|weg|allee|platz|gasse) ?\d{{1,4}} ?[a-z]?"
    rf")(?:/\d{{1,4}})?(?![\p{{L}}\p{{N}}])"
    rf"(?:,? (?:flat|apt\.?|apto\.?|piso|kv\.|кв\.|квартира|m\.|lok\.) ?\d{{1,4}})?"
    rf"(?:,? (?:in )?(?:\d{{2}}-\d{{3}}|\d{{4}}-\d{{3}}|\d{{4,6}}) \p{{Lu}}[\p{{L}}-]+|, \p{{Lu}}[\p{{L}}-]+(?: \d{{4,5}})?)?",
    regex.I,
)
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
# What a text must hold for one of the forms above to occur in it; cheap to look for.
_MAYBE_EMAIL = re.compile(r"@|[(\[{]\s?at\s?[)\]}]|\sat\s+[\w-]+(?:\s+dot\s|\s?[(\[{]\s?dot|\.[\w-])", re.I)
_HIDDEN = re.compile(r"[\s(\[{]at[\s)\]}]")
_MAYBE_PHONE = re.compile(r"\d(?:[\s()./-]{0,2}\d){7}")
_MAYBE_ID = re.compile(r"\d{3}(?:-\d\d-|\.\d{3}\.|\d{4}-?[A-Za-z])")
_JOINED = ("str.", "straße", "strasse", "weg", "allee", "platz", "gasse", "c/", "б-р", "пр-т")
_BEYOND = re.compile("[^\\x00-\\x9f\\u00a1-\\u00ac\\u00ae-\\u017f–—‘’“”…]")
#: Digits beyond ASCII; what lies above the basic plane is taken for one.
_OTHER_DIGITS = re.compile("[" + "".join(chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd") + "\U00010000-\U0010ffff]")
_APART = re.compile(r"[\d_]+")
_LONG = re.compile(r"\d\S{4,}")
_NUMBER = re.compile(r"[^\W_]+(?:[./-][^\W_]+){0,4}")
_BETWEEN = " .:№#°º"
_LABEL = re.compile(rf"([^\W\d_][^\W\d_.]{{1,14}})[{_BETWEEN}]{{1,3}}$")
# For texts in lower case.
_MAYBE_ADDRESS = re.compile(
    rf"\d(?: ?(?:bis|ter)|[a-z])?,? (?:[\w'’-]+ ){{0,4}}(?:{_BEHIND}|{_FRENCH})|(?<![^\W_])(?:{_BEFORE})[^\d_!?;:()\[\]{{}}<>|/@#=+*\"]+\d|(?:str\.|straße|strasse|weg|allee|platz|gasse) ?\d"
)
_CAPITAL = "A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĲĴĶĹĻĽĿŁŃŅŇŊŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽΑ-ΩЀ-Я"
_CAPITALS = re.compile(rf"(?<![^\W_])(?=([{_CAPITAL}][^\W\d_]{{2,}})( |, | [{_CAPITAL}]\. )([{_CAPITAL}][^\W\d_]{{2,}}))")

# Cyrillic letters and their Latin spelling, and Latin letters made one.
_FOLD = {ord(c): x for c, x in zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", ["a", "b", "v", "g", "d", "e", "e", "j", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "c", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"])}
_ONE = str.maketrans("qxyw", "kkiv")
_FLAT = {**{c: x.translate(_ONE) for c, x in _FOLD.items()}, **_ONE}
_STREET = frozenset(k.translate(_FLAT) for k in re.findall(r"[^\W\d_]{2,}", f"{_BEHIND}|{_FRENCH}|{_BEFORE}") if k not in ("de", "do", "da", "dos"))

#: Distinct partners that a first name must have among the seeds, and the part of its mentions
#: that seeds must make up: a number alone is reached by anything in enough texts.
SEED_PARTNERS, SEED_SHARE = 3, 0.05
#: Rounds of scoring, and the score that patterns and instances of a kind need. Only some
#: identity numbers have a form of their own, so their seeds fill a smaller part of a pattern.
ROUNDS, SCORES = 3, {"name": 0.5, "idnum": 0.25}
#: Part of an instance's mentions that one partner may make up; more is a fixed phrase.
ONE_PARTNER = 0.5
#: Entries up to which the lexicons are sent to all tasks; larger ones are joined to the texts.
LEXICON = 50_000
#: Words that a worker remembers.
REMEMBERED = 1 << 17
#: Share of all lower-case words that makes a word a common one; at most its inverse of words pass.
COMMON = 2e-5


#: What is no ASCII letter as a space.
_SPACED = {c: " " for c in range(128) if not chr(c).isalpha()}
_LEFT = re.compile(r"([^\W\d_]+|[^\s]|\n|^)[ \t]*$")
_RIGHT = re.compile(r"[ \t]*([^\W\d_]+|[^\s]|\n|$)")


@lru_cache(REMEMBERED)
def folded(word: str) -> str:
    return word.lower().translate(_FOLD).translate(_ONE)


@dataclass
class Model:
    """What bootstrapping found: first names, labels of identity numbers, common words."""

    first: frozenset[str] = field(default_factory=frozenset)
    labels: frozenset[str] = field(default_factory=frozenset)
    common: frozenset[str] = field(default_factory=frozenset)
    #: kind and instance of all entries, where there are too many to send them to all tasks
    table: DataFrame | None = None


#: What a word can be.
NAME, STREET = 1, 2


class Words(dict):
    """NAME and STREET of words in lower case, as a model knows them."""

    def __init__(self, first: frozenset[str]) -> None:
        self.first = first

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        f = folded(word)
        self[word] = what = NAME * (f in self.first) | STREET * (f in _STREET)
        return what


def digits(text: str) -> int:
    """Digits of a text, or more than any form needs if there are some beyond ASCII."""
    if not text.isascii() and _OTHER_DIGITS.search(text):
        return 99
    return sum(map(text.count, "0123456789"))


# What the canonical form can change, in the alphabets of these texts.
_FOREIGN = "\u0370-\u03ff\u0400-\u052f"
_suspect = re.compile(
    "[\u00a0\u00ad\u0300-\u036f\u034f\u061c\u115f\u1160\u1680\u180b-\u180e\u2000-\u200f\u202a-\u202f\u205f-\u206f\u2100-\u214f\u2460-\u24ff\u3000\u3164\ufe00-\ufe0f\ufeff\uff01-\uffee\U0001d400-\U0001d7ff\U0001f100-\U0001f16f]"
    f"|[A-Za-z\u00c0-\u024f][0-9]*[{_FOREIGN}]|[{_FOREIGN}][0-9]*[A-Za-z\u00c0-\u024f]|[\u0370-\u03ff][0-9]*[\u0400-\u052f]|[\u0400-\u052f][0-9]*[\u0370-\u03ff]"
)


def readable(text: str) -> str:
    """The canonical form of a text."""
    if text.isascii() or not _BEYOND.search(text):
        return text
    return mapping().rewrite(text)[0] if _suspect.search(text) else text


def word_pairs(text: str, known: Words) -> Iterator[tuple[int, int, str, str, str]]:
    """start, end, form, and the two words of what can be a name: a known first name or an initial is in it.

    Forms: ab (two words), a,b (turned round), i.b (initial first), a.j (initial last).
    """
    words = list(_WORD.finditer(text))
    near = set()
    for n, m in enumerate(words):
        if len(m[0]) == 1 or known[m[0].lower()] & NAME:
            near.update((n - 2, n - 1, n))
    for n in sorted(near):
        if n < 0:
            continue
        m = words[n]
        if len(m[0]) == 1:
            if text[m.end() : m.end() + 2] == ". " and n + 1 < len(words) and words[n + 1].start() == m.end() + 2 and m[0].isupper() and len(words[n + 1][0]) > 2:
                if n == 0 or not (words[n - 1].end() + 1 == m.start() and len(words[n - 1][0]) > 1 and words[n - 1][0][0].isupper()):
                    yield m.start(), words[n + 1].end(), "i.b", m[0], words[n + 1][0]
            continue
        if n + 1 >= len(words):
            continue
        nxt = words[n + 1]
        gap = text[m.end() : nxt.start()]
        if gap in (" ", ", ") and len(nxt[0]) > 1:
            yield m.start(), nxt.end(), "ab" if gap == " " else "a,b", m[0], nxt[0]
        elif gap == " " and len(nxt[0]) == 1 and nxt[0].isupper() and text[nxt.end() : nxt.end() + 1] == ".":
            if n + 2 < len(words) and text[nxt.end() : words[n + 2].start()] == ". " and len(words[n + 2][0]) > 1:
                yield m.start(), words[n + 2].end(), "ab", m[0], words[n + 2][0]
            yield m.start(), nxt.end() + 1, "a.j", m[0], nxt[0]


def has_initial(text: str) -> bool:
    """Whether a single letter and a full stop stand before a word."""
    at = text.find(". ")
    while at > 0:
        if text[at - 1].isalpha() and (at < 2 or not text[at - 2].isalnum()) and text[at + 2 : at + 5].isalpha():
            return True
        at = text.find(". ", at + 2)
    return False


def masked(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """Text with everything found by form blanked to a mark, and what was found."""
    found: list[tuple[int, int, str]] = []

    def blank(start: int, end: int) -> None:
        nonlocal text
        text = text[:start] + "\x01" * (end - start) + text[end:]

    for m in list(_EMAIL.finditer(text)) if ("@" in text or _HIDDEN.search(text.lower())) and _MAYBE_EMAIL.search(text) else ():
        found.append((m.start(1), m.end(1), "email"))
        blank(m.start(1), m.end(1))
    for sign, form in _MASKS:
        if sign in text:
            for m in list(form.finditer(text)):
                blank(m.start(), m.end())
    return text, found


def labelled_numbers(text: str) -> Iterator[tuple[int, int, str, str]]:
    """start, end, word before it and value of every run with six digits or more that a word precedes."""
    for run in _LONG.finditer(text):
        if sum(map(str.isdigit, run[0])) < 6:
            continue
        start = run.start()
        while start and text[start - 1].isalnum():
            start -= 1
        if not start or text[start - 1] not in _BETWEEN + "\n":
            continue
        label = _LABEL.search(text, max(0, start - 22), start)
        m = label and _NUMBER.match(text, start)
        if m and sum(map(str.isdigit, m[0])) >= 6:
            yield start, m.end(), label[1].lower(), m[0]


def context(text: str, start: int, end: int) -> tuple[str, str]:
    """The word or mark on either side of a span."""
    left = _LEFT.search(text[max(0, start - 30) : start])
    right = _RIGHT.match(text[end : end + 30])
    return (left[1].lower() if left and left[1] != "\n" else "^"), (right[1].lower() if right and right[1] != "\n" else "$")


def find(text: str, model: Model, known: Words | None = None) -> list[tuple[int, int, str]]:
    """Spans of personal information in a text, in order, without overlaps.

    Each pattern runs only over texts that hold as many digits, or a word, as it needs.
    """
    known = Words(model.first) if known is None else known
    text, found = masked(text)

    def take(start: int, end: int, kind: str) -> None:
        nonlocal text
        found.append((start, end, kind))
        text = text[:start] + "\x01" * (end - start) + text[end:]

    low = text.lower()
    held = digits(text)
    if held >= 6:
        if any(k in low for k in model.labels):
            for start, end, label, _ in list(labelled_numbers(text)):
                if label in model.labels:
                    take(start, end, "idnum")
        if held >= 7 and _MAYBE_ID.search(text):
            for m in list(_SEED_ID.finditer(text)):
                take(m.start(), m.end(), "idnum")
        if held >= 8 and _MAYBE_PHONE.search(text):
            for m in list(_PHONE.finditer(text)):
                if 8 <= sum(ch.isdigit() for ch in m[0]) <= 15:
                    take(m.start(), m.end(), "phone")
    said = 0
    for what in {known[w] for w in (low.translate(_SPACED).split() if low.isascii() else _WORD.findall(low))}:
        said |= what
    if held and (said & STREET or any(k in low for k in _JOINED)) and _MAYBE_ADDRESS.search(text.lower()):
        for m in list(_ADDRESS.finditer(text)):
            take(m.start(), m.end(), "address")
    if not said & NAME and not has_initial(text):
        return sorted(found)
    case: list[bool] = []

    def one_case() -> bool:
        if not case:
            letters = [w for w in _WORD.findall(text) if len(w) > 2]
            case.append(bool(letters) and (sum(map(str.islower, letters)) > 0.97 * len(letters) or sum(map(str.isupper, letters)) > 0.97 * len(letters)))
        return case[0]

    last = -1
    for start, end, form, a, b in word_pairs(text, known):
        if start < last:
            continue
        if is_name(form, a, b, model, one_case):
            found.append((start, end, "name"))
            last = end
    return sorted(found)


def is_name(form: str, a: str, b: str, model: Model, one_case: Callable[[], bool]) -> bool:
    fa, fb = folded(a), folded(b)

    def proper(word: str) -> bool:
        return len(word) > 2 and word.lower() not in model.common and (word[0].isupper() or word.islower() and form == "ab" or one_case())

    if form == "ab":
        if a[0].islower() != b[0].islower() or "'" in a or "’" in a:
            return False
        return (fa in model.first and fb not in model.first and proper(b)) or (fb in model.first and fa not in model.first and proper(a) and not a.islower())
    if form == "a,b":
        return fb in model.first and fa not in model.first and proper(a) and a[0].isupper() == b[0].isupper()
    if form == "i.b":
        return (b[0].isupper()) and proper(b) and fb not in model.first
    return fa in model.first and a[0].isupper()


_MENTION = "kind string, a string, b string, at string, form string, seed boolean"


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels with their number, and pairs of capitalised words, with what stands around them; those of seed form are marked."""
    for batch in batches:
        out = []
        for text, hints in zip(batch.column("text").to_pylist(), batch.column("hints").to_pylist()):
            if not text:
                continue
            whole, _ = masked(readable(text))
            for start, _, label, value in labelled_numbers(whole):
                left = " ".join(whole[max(0, start - 50) : start].lower().split()[:-1][-2:])
                out.append(("idnum", label, value, left, "", bool(_SEED_ID.fullmatch(value))))
            own = None
            for m in _CAPITALS.finditer(whole):
                if own is None:
                    own = {w for w in _WORD.findall(_APART.sub(" ", hints.lower()).translate(_FLAT)) if len(w) > 2} if hints else set()
                fa, fb = folded(m[1]), folded(m[3])
                left, right = context(whole, m.start(1), m.end(3))
                out.append(("name", fa, fb, f"{left} _ {right}", "a,b" if m[2] == ", " else "ab", fa in own and fb in own and fa != fb))
        columns = list(zip(*out)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if i == 5 else pa.string()) for i, c in enumerate(columns)], ["kind", "a", "b", "at", "form", "seed"])


def both_ways(found: DataFrame) -> DataFrame:
    """kind, instance, partner, pattern and seed; either word of a pair may be the first name, in a pattern of its own."""
    as_is = F.struct(F.col("a").alias("instance"), F.col("b").alias("partner"), F.col("at").alias("pattern"))
    turned = lambda mark: F.struct(F.col("b").alias("instance"), F.col("a").alias("partner"), F.concat("at", F.lit(mark)).alias("pattern"))
    ways = F.when(F.col("form") == "ab", F.array(as_is, turned(" /"))).when(F.col("form") == "a,b", F.array(turned(" ,"))).otherwise(F.array(as_is))
    return found.select("kind", "seed", F.explode(ways).alias("m")).select("kind", "m.*", "seed")


def sown(mentions: DataFrame, fit: DataFrame) -> DataFrame:
    """kind and instance of the seeds: words that have more partners than most of the partners they are sown with.

    A surname, too, goes with several first names where texts are many, but with fewer words than they do.
    """
    able = fit.where(F.col("sown") >= F.greatest(F.lit(SEED_PARTNERS), SEED_SHARE * F.col("total")))
    other = fit.select("kind", F.col("instance").alias("partner"), F.col("partners").alias("theirs"))
    beside = mentions.where("seed").select("kind", "instance", "partner").distinct().join(able.select("kind", "instance", "partners"), ["kind", "instance"])
    led = F.count_if(F.col("partners") > F.coalesce("theirs", F.lit(0)))
    ahead = beside.join(other, ["kind", "partner"], "left").groupBy("kind", "instance").agg(led.alias("led"), F.count("*").alias("seeds"))
    return ahead.where((F.col("led") >= SEED_PARTNERS) & (2 * F.col("led") > F.col("seeds"))).select("kind", "instance")


def bootstrap(texts: DataFrame, rounds: int = ROUNDS, lexicon: int = LEXICON) -> Model:
    """The model of all texts; texts: text and hints (user names, addresses, display names).

    Up to ``lexicon`` entries are brought to the driver; of a larger model the table is kept.
    """
    mentions = both_ways(stored(texts.select("text", "hints").where("text is not null").mapInArrow(_mentions, _MENTION), "mentions"))
    graph = stored(mentions.groupBy("kind", "instance", "pattern").agg(F.count("*").alias("n")), "graph")
    pairs = mentions.groupBy("kind", "instance", "partner").agg(F.count("*").alias("n"), F.count_if("seed").alias("s"))
    spread = pairs.groupBy("kind", "instance").agg(F.count("*").alias("partners"), F.sum("n").alias("total"), F.max("n").alias("most"), F.sum("s").alias("sown"))
    # a first name goes with many surnames, a label with many numbers, a fixed phrase with one word
    fit = stored(spread.where((F.col("partners") >= SEED_PARTNERS) & (F.col("most") <= ONE_PARTNER * F.col("total"))), "spread")
    seeds = sown(mentions, fit)
    need = F.when(F.col("kind") == "name", SCORES["name"]).otherwise(SCORES["idnum"])
    known = seeds
    for _ in range(rounds):
        held = graph.join(known.withColumn("hit", F.lit(1)), ["kind", "instance"], "left")
        rate = F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)) / F.sum("n")
        patterns = held.groupBy("kind", "pattern").agg(rate.alias("rate"), F.count("hit").alias("support"))
        good = patterns.where((F.col("rate") >= need) & (F.col("support") >= F.when(F.col("kind") == "name", SEED_PARTNERS).otherwise(2)))
        told = graph.join(good.select("kind", "pattern"), ["kind", "pattern"]).groupBy("kind", "instance").agg(F.sum("n").alias("told"), F.count("*").alias("ways"))
        rated = told.join(fit, ["kind", "instance"]).where((F.col("ways") >= 2) & (F.col("told") >= need * F.col("total")))
        known = stored(rated.select("kind", "instance").unionByName(seeds).distinct(), "known")
    plain = texts.select(F.explode(F.split("text", r"[^\p{L}]+")).alias("w")).where((F.length("w") >= 2) & (F.col("w") == F.lower("w")))
    counts = stored(plain.groupBy("w").agg(F.count("*").alias("n")), "plain")
    total = counts.agg(F.sum("n")).first()[0] or 0
    common = [r["w"] for r in counts.where(F.col("n") >= max(5.0, total * COMMON)).select("w").collect()]  # at most 1 / COMMON words
    if known.count() > lexicon:
        names = known.where("kind = 'name'").select("instance")
        shown = texts.sparkSession.createDataFrame([(w, folded(w)) for w in common], "w string, instance string").join(names, "instance", "left_semi")
        first = {r["w"] for r in shown.collect()}  # part of the common words
        return Model(common=frozenset(w for w in common if w not in first), table=known)
    held = known.collect()
    first = {r["instance"] for r in held if r["kind"] == "name"}
    return Model(frozenset(first), frozenset(r["instance"] for r in held if r["kind"] == "idnum"), frozenset(w for w in common if folded(w) not in first))


_SPANS = T.StructType([T.StructField("redacted", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType()))])


def spans(t: str | None, model: Model, known: Words | None = None) -> tuple[str | None, list[str]]:
    """The redacted form of a text and the kinds of what was replaced."""
    if t is None:
        return None, []
    read = readable(t)
    parts, at, kinds = [], 0, []
    for start, end, kind in find(read, model, known):
        if start < at:
            continue
        parts += [read[at:start], f"[{kind.upper()}]"]
        at = end
        kinds.append(kind)
    return ("".join([*parts, read[at:]]), kinds) if kinds else (t, [])


def detector(model: Model, redact: bool = True):
    """An Arrow UDF from a text to its redacted form and the kinds of what was replaced, or to the kinds alone."""
    small = Model(model.first, model.labels, model.common)

    def detect(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Words(small.first)
        for s in texts:
            out = [spans(t, small, known) for t in s.to_pylist()]
            kinds = pa.array([k for _, k in out], pa.list_(pa.string()))
            yield pa.StructArray.from_arrays([pa.array([r for r, _ in out], pa.string()), kinds], ["redacted", "kinds"]) if redact else kinds

    return F.arrow_udf(detect, _SPANS if redact else T.ArrayType(T.StringType()))


def detector_of_own(model: Model):
    """The same with the entries that each text holds beside it."""
    common = model.common

    @F.pandas_udf(_SPANS)
    def detect(texts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for s, first, labels in texts:
            out = [spans(t, Model(frozenset(f if f is not None else ()), frozenset(k if k is not None else ()), common)) for t, f, k in zip(s, first, labels)]
            yield pd.DataFrame(out, columns=["redacted", "kinds"])

    return detect


def _said(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What the lexicons can know of a text: its words as names, words before numbers as labels."""
    for pdf in rows:
        out = []
        for key, text in zip(pdf["_key"], pdf["_text"]):
            read = readable(text)
            whole, _ = masked(read)
            out += [(key, "name", folded(w)) for w in set(_WORD.findall(read.lower()))]
            out += [(key, "idnum", label) for label in {x[2] for x in labelled_numbers(whole)}]
        yield pd.DataFrame(out, columns=["_key", "kind", "instance"])


def kinds(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """df with ``kinds``; the redacted texts are not sent back from Python."""
    if model.table is not None:
        return redacted(df, model, column).drop("redacted")
    return df.withColumn("kinds", detector(model, redact=False)(F.col(f"`{column}`")))


def redacted(df: DataFrame, model: Model, column: str = "text") -> DataFrame:
    """df with ``redacted`` and ``kinds``."""
    text = F.col(f"`{column}`")
    if model.table is None:
        out = df.withColumn("_pi", detector(model)(text))
    else:
        keyed = df.withColumn("_key", F.sha2(text, 256))
        said = keyed.where("_key is not null").select("_key", text.alias("_text")).mapInPandas(_said, "_key string, kind string, instance string").distinct()
        known = said.join(model.table.select("kind", "instance"), ["kind", "instance"], "left_semi")
        # a text's own words bound both lists
        own = [F.collect_set(F.when(F.col("kind") == k, F.col("instance"))).alias(f"_{k}") for k in ("name", "idnum")]
        out = keyed.join(known.groupBy("_key").agg(*own), "_key", "left").withColumn("_pi", detector_of_own(model)(text, F.col("_name"), F.col("_idnum"))).drop("_key", "_name", "_idnum")
    return out.withColumn("redacted", F.col("_pi.redacted")).withColumn("kinds", F.col("_pi.kinds")).drop("_pi")
