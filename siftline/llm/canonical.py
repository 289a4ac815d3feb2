"""Visually identical text with different characters, brought to one form.

The mapping is compiled once from Unicode's own data by rule: widths and styles from the
compatibility decompositions, accents from canonical composition, spaces and invisible
characters from the general categories, and look-alike letters from the pairs below. It is
checked for conflicts while it is compiled: no key has two targets, and no target holds a
key, so a second pass changes nothing. The compiled form is a longest-match transducer: the
text is read once from left to right in stretches that no ASCII space or mark interrupts; at
each position of a stretch the longest key wins. Only look-alikes depend on their surroundings:
a letter is replaced if its word, which lies in one stretch, mixes alphabets, and the word takes
the alphabet of most of its letters. Stretches of ASCII are their own form, and the forms of
others are remembered, so that a text costs little more than its length.

Defined cases: null stays null with zero changes; an empty text stays empty; texts of any
length are read whole; words wholly in one alphabet, typographic quotes and dashes, composed
accented letters, line breaks and emoji with their joiners and selectors stay as they are; a
mark that composes with nothing stays; letters of another alphabet without a look-alike stay
but count as a change, since their word is disguised.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other alphabets that look like a Latin letter.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухԁԛԝһ"
CYRILLIC_AS_LATIN = "ABESIJKMHOPCTYXaesijopcyxdqwh"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαινορυχ"
GREEK_AS_LATIN = "ABEZHIKMNOPTYXaivopux"
# Small letters that look like a Latin one only in some type, used towards Cyrillic as well.
CYRILLIC_SMALL = "кмнтвг"
CYRILLIC_SMALL_AS_LATIN = "kmhtbr"

# Small capitals, which have no decomposition, and the letters they show.
SMALL_CAPITALS = "ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ"
SMALL_CAPITALS_AS_LATIN = "abcdefghijklmnoprstuvwyz"

#: Decomposition tags that mark a width or a style rather than another character.
STYLES = ("<wide>", "<narrow>", "<font>", "<circle>", "<square>")
#: First letters A of alphabets in negative circles and squares, which have no decomposition.
NEGATIVE = (0x1F150, 0x1F170)
#: Ligatures of Latin letters, by their decomposition.
LIGATURES = range(0xFB00, 0xFB07)
#: Blank of the Braille patterns, which shows as a space.
BRAILLE_BLANK = 0x2800
#: Fillers that leave no trace on the page, like the format characters; those of Arabic and of
#: older scripts are signs that show, and stay.
INVISIBLE_EXTRA = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0)


#: Forms of stretches that a worker remembers.
REMEMBERED = 200_000


class Mapping:
    """The compiled, conflict-checked mapping."""

    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        for cp in range(0x80, 0x110000):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind in ("Cn", "Cs", "Co"):
                continue
            if cp in INVISIBLE_EXTRA:
                self._add(ch, "")
                continue
            if cp == BRAILLE_BLANK:
                self._add(ch, " ")
                continue
            if cp in LIGATURES:
                self._add(ch, unicodedata.normalize("NFKC", ch))
                continue
            style = unicodedata.decomposition(ch).partition(" ")[0]
            if kind == "Zs":  # the wide space has a style too, and is a space first
                self._add(ch, " ")
            elif style in STYLES:
                plain = unicodedata.normalize("NFKC", ch)
                if len(plain) == 1 and plain.isalnum():
                    self._add(ch, plain)
            elif kind == "Cf" and cp < 0xE0000 and not (0x600 <= cp <= 0x8FF and cp != 0x61C) and not 0x11000 <= cp <= 0x1345F or 0xFE00 <= cp <= 0xFE0F:
                self._add(ch, "")
        for first in NEGATIVE:
            for i in range(26):
                if not regex.fullmatch(r"\p{Emoji}", chr(first + i)):  # A, B, O and P in squares are emoji
                    self._add(chr(first + i), chr(ord("A") + i))
        for a, b in zip(SMALL_CAPITALS, SMALL_CAPITALS_AS_LATIN, strict=True):
            self._add(a, b)
        self.latin = self._pairs(CYRILLIC + GREEK + CYRILLIC_SMALL, CYRILLIC_AS_LATIN + GREEK_AS_LATIN + CYRILLIC_SMALL_AS_LATIN)
        self.cyrillic = self._pairs(CYRILLIC_AS_LATIN + CYRILLIC_SMALL_AS_LATIN, CYRILLIC + CYRILLIC_SMALL)
        self.greek = self._pairs(GREEK_AS_LATIN, GREEK)
        for a in self.single.values():
            if any(ch in self.single for ch in a):
                raise ValueError("a target of the mapping is a key of it")
        for table in (self.latin, self.cyrillic, self.greek):
            if set(table.values()) & set(table):
                raise ValueError("a look-alike maps to another look-alike")
        self.known: dict[str, tuple[str, int]] = {}
        # a stretch may begin with an ASCII sign, which a mark or an enclosing keycap can follow
        self.stretch = re.compile(r"[!-/:-@\[-`{-~]?[^\x00-/:-@\[-`{-\x7f]+")
        keys = "".join(regex.escape(k, special_only=True) for k in sorted(self.single))
        # circled letters are symbols by category: a key is an emoji only if it may be one and a selector says so
        styled = rf"(?![{keys}](?!(?<=\p{{Emoji}})\uFE0F))"
        # longest first: an emoji sequence, a letter with its loose marks, then single keys
        self.machine = regex.compile(
            rf"(?P<emoji>{styled}[\p{{So}}\p{{Sk}}\p{{Emoji_Presentation}}][︎️\U0001F3FB-\U0001F3FF]*(?:‍[\p{{So}}\p{{Emoji_Presentation}}][︎️\U0001F3FB-\U0001F3FF]*)*|[0-9#*]️?⃣)"
            rf"|(?P<cluster>[^\p{{M}}\s](?:[​-‍⁠﻿­]*\p{{Mn}})+)"
            rf"|(?P<single>[{keys}]+)"
        )
        self.word = regex.compile(r"[\p{L}\p{M}\p{N}]+")
        self.mixed = regex.compile(r"\p{Latin}[\p{M}\p{N}]*[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}][\p{M}\p{N}]*\p{Latin}|\p{Cyrillic}[\p{M}\p{N}]*\p{Greek}|\p{Greek}[\p{M}\p{N}]*\p{Cyrillic}")

    def _add(self, key: str, target: str) -> None:
        if self.single.setdefault(key, target) != target:
            raise ValueError(f"{key!r} has two targets")

    @staticmethod
    def _pairs(keys: str, targets: str) -> dict[str, str]:
        if len(keys) != len(targets):
            raise ValueError("the look-alikes do not pair up")
        table: dict[str, str] = {}
        for a, b in zip(keys, targets):
            table.setdefault(a, b)
        return table

    def rewrite(self, text: str) -> tuple[str, int]:
        """The text in its one form and the number of places that were changed."""
        if text.isascii():
            return text, 0
        total = 0

        def look(m: re.Match) -> str:
            nonlocal total
            run = m[0]
            if run.isascii():
                return run
            found = self.known.get(run)
            if found is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                found = self.known[run] = self.transduce(run)
            total += found[1]
            return found[0]

        return self.stretch.sub(look, text), total

    def transduce(self, text: str) -> tuple[str, int]:
        """One stretch in its one form and the number of changed places."""
        changes = 0

        def step(m: regex.Match) -> str:
            nonlocal changes
            if m.lastgroup == "emoji":
                return m[0]
            if m.lastgroup == "cluster":
                bare = "".join(self.single.get(ch, ch) if not unicodedata.combining(ch) else ch for ch in m[0])
                new = unicodedata.normalize("NFC", bare)
            else:
                new = "".join(self.single[ch] for ch in m[0])
            changes += new != m[0]
            return new

        out = self.machine.sub(step, text)
        if self.mixed.search(out):

            def one_alphabet(m: regex.Match) -> str:
                nonlocal changes
                if not self.mixed.search(m[0]):
                    return m[0]
                changes += 1
                return self.settle(m[0])

            out = self.word.sub(one_alphabet, out)
        return out, changes

    def settle(self, word: str) -> str:
        """A mixed word in the alphabet that its unmistakable, else most of its letters have."""
        alphabets = {"latin": 0.0, "cyrillic": 0.0, "greek": 0.0}
        for ch in word:
            name = unicodedata.name(ch, "").partition(" ")[0].lower()
            if name in alphabets:
                twin = ch in self.latin or ch in self.cyrillic or ch in self.greek
                alphabets[name] += 1 if twin else 3
        home = max(alphabets, key=lambda k: (alphabets[k], k == "latin"))
        table = getattr(self, home)
        if home != "latin":  # by way of the Latin twin
            return "".join(table.get(self.latin.get(ch, ch), ch) if not unicodedata.name(ch, "").lower().startswith(home) else ch for ch in word)
        return "".join(table.get(ch, ch) for ch in word)


@lru_cache(1)
def mapping() -> Mapping:
    return Mapping()


#: What a text must hold for the mapping to change it; every key of the mapping falls in here.
SUSPECT = (
    r"[\p{M}\p{Cf}[\p{Zs}&&[^ ]]͏ᅟᅠ឴឵ㅤ＀-￯℀-⅏①-⓿㈀-㋿ﬀ-ﬆﬠ-﬩⠀ᴀʙᴄᴅᴇꜰɢʜɪᴊᴋʟᴍɴᴏᴘʀꜱᴛᴜᴠᴡʏᴢ\x{1D400}-\x{1D7FF}\x{1EE00}-\x{1EEFF}\x{1F100}-\x{1F2FF}\x{1FBF0}-\x{1FBF9}]"
    r"|\p{IsLatin}\p{N}*[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{N}*\p{IsLatin}|\p{IsCyrillic}\p{N}*\p{IsGreek}|\p{IsGreek}\p{N}*\p{IsCyrillic}"
)


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("changes", T.IntegerType())]))
def _rewrite(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    m = mapping()
    for s in texts:
        yield pd.DataFrame([m.rewrite(t) if t is not None else (None, 0) for t in s], columns=["text", "changes"])


def suspect(text: Column) -> Column:
    """Whether the transducer can change a text; decided in the JVM. A text with as many bytes as letters is ASCII."""
    return F.coalesce((F.octet_length(text) > F.length(text)) & text.rlike(SUSPECT), F.lit(False))


def canonical(df: DataFrame, column: str, into: str = "canonical", changes: str = "changes") -> DataFrame:
    """df with the one form of a text column and the number of changed places.

    Texts that hold no key of the mapping are their own form and never leave the JVM.
    """
    text = F.col(f"`{column}`")
    # what is its own form goes to Python as a null
    work = df.withColumn("_cn", _rewrite(F.when(suspect(text), text)))
    return work.withColumn(into, F.coalesce("_cn.text", text)).withColumn(changes, F.col("_cn.changes")).drop("_cn")


def disguised(df: DataFrame, column: str) -> DataFrame:
    """The rows of which the transducer changes the text, with the changed text."""
    text = F.col(f"`{column}`")
    return df.where(suspect(text)).withColumn("_cn", _rewrite(text)).where("_cn.changes > 0").withColumn("canonical", F.col("_cn.text")).drop("_cn")
