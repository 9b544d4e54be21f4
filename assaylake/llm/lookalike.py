"""One spelling for texts that look the same."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from assaylake.plans.joins import hot_keys, join_hot, semi_join_skewed
from assaylake.plans.scratch import Scratch

#: Digests are broadcast up to so many (some 15 MB); beyond, both sides are shuffled under salts.
BROADCAST = 100_000
COLLATION = "UNICODE"  # tertiary strength: accents and case count, ignorable characters don't

# Letters of other scripts (and of the phonetic alphabet) that are drawn like a Latin letter.
LOOK_ALIKES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "Ꮮ",
    "M": "МΜϺᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥ", "Z": "ΖᏃ",
    "a": "аαɑ", "b": "Ь", "c": "сϲᴄ", "d": "ԁ", "e": "еҽ", "f": "ϝ", "g": "ɡց", "h": "һհ", "i": "іι", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօᴏ",
    "p": "рρ", "q": "ԛզ", "s": "ѕꜱ", "u": "υսᴜ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уүγ", "z": "ᴢ",
}
# Hyphens drawn like the ASCII one, and invisible characters that aren't format characters.
HYPHENS = "‐‑﹣－"
UNSEEN = "".join(chr(c) for c in range(0x80, 0xA0) if c != 0x85) + "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10))) + "".join(map(chr, range(0xE0100, 0xE01F0)))
#: ASCII control characters differ from each other and from nothing, but the collation ignores them.
_CONTROLS = [c for c in [*range(0x20), 0x7F] if chr(c) not in "\t\n\v\f\r"]


@lru_cache(maxsize=1)
def look_alike_map() -> dict[str, str]:
    """Character -> what it looks like ("" for what isn't seen), by rule from the Unicode tables."""
    letter = {x: latin for latin, xs in LOOK_ALIKES.items() for x in xs}
    out = dict(letter)
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        kind, decomposed = unicodedata.category(c), unicodedata.decomposition(c)
        if kind in ("Cn", "Co", "Cs") and c not in UNSEEN:
            continue
        tag, _, rest = decomposed.partition(" ")
        if c in HYPHENS:
            out[c] = "-"
        elif kind == "Cf" or c in UNSEEN:
            out[c] = ""
        elif kind == "Zs" and code != 0x1680:
            out[c] = " "
        elif tag in ("<wide>", "<narrow>"):
            plain = chr(int(rest, 16))
            out[c] = out.get(plain, plain)
        elif tag == "<font>" and kind[0] == "L":
            # styled letters (bold, italic, script, double-struck, ...) are drawn like the plain ones, Greek ones like theirs
            plain = unicodedata.normalize("NFKC", c)
            out[c] = letter.get(plain, plain)
        elif tag == "<compat>" and len(rest.split()) > 1 and kind in ("Ll", "Lu", "Lt"):
            plain = unicodedata.normalize("NFKC", c)
            if plain.isascii():  # ligatures of Latin letters
                out[c] = plain
        elif decomposed and tag[0] != "<":
            parts = unicodedata.normalize("NFD", c)
            if any(p in letter for p in parts):  # an accented look-alike
                out[c] = unicodedata.normalize("NFC", "".join(letter.get(p, p) for p in parts))
    return out


def _char_class(chars: Iterable[str]) -> str:
    """The inside of a regular expression's class, as ranges."""
    runs: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def look_alike(text: Column) -> Column:
    """The text with every character replaced by what it looks like; JVM expressions only.

    Accents stay as they are written, composed or not: :func:`composed` and the
    collation take care of them. ASCII is left alone, except that control characters are moved to
    private-use ones, which the collation doesn't ignore. Texts of ASCII alone
    take no work, and characters that become several are looked for only in texts
    that have any.
    """
    mapping = look_alike_map()
    several = {c: t for c, t in mapping.items() if len(t) > 1}
    single = {c: t for c, t in mapping.items() if len(t) == 1} | {chr(c): chr(0xF0000 + c) for c in _CONTROLS}
    gone = "".join(c for c, t in mapping.items() if not t)
    widened = text
    for c, t in several.items():
        widened = F.replace(widened, F.lit(c), F.lit(t))
    widened = F.when(text.rlike(f"[{_char_class(several)}]"), widened).otherwise(text)
    plain = (F.octet_length(text) == F.length(text)) & ~text.rlike(f"[{_char_class(map(chr, _CONTROLS))}]")
    return F.when(plain, text).otherwise(F.translate(widened, "".join(single) + gone, "".join(single.values())))


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """Accents in one order and joined to their letters; the collation takes them as they stand otherwise."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


def _not_blank(text: Column) -> Column:
    """Whether anything but spaces, line ends and unseen characters is there; looks no further than the first."""
    unseen = [c for c, t in look_alike_map().items() if t in ("", " ")]
    return text.rlike(f"[^\\s\\x{{85}}\\x{{2028}}\\x{{2029}}{_char_class(unseen)}]")


@lru_cache(maxsize=1)
def coarse_map() -> dict[str, str]:
    """Character -> what is left of it without accents: equal for all texts that look the same, and for some others."""
    look, out, dropped = look_alike_map(), {}, set()
    mark = lambda c: unicodedata.category(c)[0] == "M"
    for code in range(0x80, sys.maxunicode + 1):
        c = chr(code)
        if unicodedata.category(c) in ("Cn", "Co", "Cs") and c not in look:
            continue
        parts = [p for x in unicodedata.normalize("NFD", c) for p in unicodedata.normalize("NFD", look.get(x, x)) if not mark(p)]
        ligature = c in look and unicodedata.decomposition(c).startswith("<compat>")
        if not ligature:
            dropped.update(parts[1:])  # the later parts of a syllable
        if parts != [c]:
            out[c] = "".join(parts) if ligature else "".join(parts[:1])
    return out | dict.fromkeys(dropped, "")


def coarse_signature(text: Column) -> Column:
    """A hash that texts which look the same share; it only serves to leave out texts that are alone."""
    mapping = coarse_map()
    several = {c: t for c, t in mapping.items() if len(t) > 1}
    single = {c: t for c, t in mapping.items() if len(t) == 1}
    gone = "".join(c for c, t in mapping.items() if not t)
    widened = text
    for c, t in several.items():
        widened = F.replace(widened, F.lit(c), F.lit(t))
    widened = F.when(text.rlike(f"[{_char_class(several)}]"), widened).otherwise(text)
    coarse = F.translate(widened, "".join(single) + gone, "".join(single.values()))
    return F.xxhash64(F.when(F.octet_length(text) == F.length(text), text).otherwise(coarse))


def _identity(text: Column) -> Column:
    """What stands for a text: 128 bits, which no two texts share by chance at any size of table."""
    return F.unhex(F.md5(text))


def _near_rows(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(_key, _id) of the rows whose text may look like a different one.

    ``rows`` is (_key, _text). A text's accent-free signature is equal wherever the
    collation finds equality, so only texts whose signature is shared by a
    different text go on. Texts are read once for it; digests are shuffled, folded
    to two a task and signature.
    """
    signed = scratch.save(rows.select("_key", _identity(F.col("_text")).alias("_id"), coarse_signature(F.col("_text")).alias("_sig")), "signed")
    shared = signed.groupBy("_sig").agg(F.min("_id").alias("_a"), F.max("_id").alias("_b")).where("_a <> _b")
    return scratch.save(semi_join_skewed(signed, shared, "_sig", spread=F.col("_id"), limit=BROADCAST).select("_key", "_id"), "near")


def _spellings(rows: DataFrame, near: DataFrame, scratch: Scratch) -> DataFrame:
    """(_id, canonical, class_id, _n): the spellings of all classes that have more than one, with their canonical member.

    The look-alike-mapped values are grouped under the collation; the canonical
    member is chosen in each class and joined back to all of its spellings. Copies
    of a text are folded in every task and go through this once.
    """
    counts = scratch.save(near.groupBy("_id").agg(F.count(F.lit(1)).alias("_n")), "counts")
    texts = semi_join_skewed(rows.select("_key", "_text", _identity(F.col("_text")).alias("_id")), counts, "_id", spread=F.col("_key"), limit=BROADCAST)
    once = texts.groupBy("_id").agg(F.first("_text").alias("_text")).withColumn("_look", composed(look_alike(F.col("_text"))))
    once = scratch.save(once, "texts")
    foreign = F.octet_length("_text") - F.length("_text")
    order = F.struct(foreign.alias("f"), F.length("_text").alias("n"), F.col("_text").alias("t"))
    classes = once.groupBy(F.collate("_look", COLLATION).alias("_class")).agg(F.min(order).alias("_best"), F.count(F.lit(1)).alias("_k")).where("_k > 1")
    named = classes.select("_class", F.col("_best.t").alias("canonical"))
    joined = once.join(named, F.collate("_look", COLLATION) == F.col("_class")).join(counts, "_id")
    return scratch.save(joined.select("_id", "canonical", _identity(F.col("canonical")).alias("class_id"), "_n"), "spellings")


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, class_id, canonical): every text in the one spelling of its class.

    Texts that look the same form a class: their look-alike-mapped values are
    equal under the accent-sensitive Unicode collation. Its canonical member is
    the one with the fewest characters outside ASCII, among these the shortest,
    among these the first in byte order, so it is certain at any order of rows.
    ``class_id`` (16 bytes) is the digest of the canonical member. A null text
    stays null with a null class; blank texts are classes like any other. One row
    for every row of ``df``; repeated rows stay.

    A text that is alone in its class is its own canonical member, so only the
    others are looked up; a text with a third of all rows is divided over tasks.
    """
    scratch = Scratch(df.sparkSession, "lookalike")
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    texts = rows.where(F.col("_text").isNotNull())
    near = _near_rows(texts, scratch)
    found = _spellings(texts, near, scratch)
    hot = hot_keys(found, ["_id"], "_n", df.count())
    named = rows.withColumn("_id", _identity(F.col("_text")))
    joined = join_hot(named, found.select("_id", "class_id", F.col("canonical").alias("_c")), ["_id"], hot, spread=F.col("_key"), how="left")
    return joined.select(F.col("_key").alias(key), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("_c", "_text").alias("canonical"))


@dataclass(frozen=True)
class LookAlikes:
    """Classes of texts that look the same but are spelled in more than one way.

    ``classes``   (class_id, canonical, n_spellings, n_rows), one row a class
    ``spellings`` (class_id, variant, representative, n_rows), one row a spelling, known by its smallest key;
                  the pairs of representatives of a class are all that is needed to link different texts
    ``members``   (class_id, variant, key), one row for each row of a spelling, repeated rows once
    """

    classes: DataFrame
    spellings: DataFrame
    members: DataFrame


def look_alike_classes(df: DataFrame, key: str, text: str) -> LookAlikes:
    """The classes that hold more than one spelling. Null and blank texts (nothing but
    spaces and unseen characters), and rows with a null key, are left out; an empty
    table has no classes.

    Every class goes through its canonical member: ``class_id`` is that one's
    digest, and ``variant`` the spelling's own; equal texts share it.
    """
    scratch = Scratch(df.sparkSession, "lookalike")
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull() & _not_blank(F.col("_text")))
    near = _near_rows(rows, scratch)
    found = _spellings(rows, near, scratch)
    hot = hot_keys(found, ["_id"], "_n", near.count())
    members = join_hot(near, found.select("_id", "class_id"), ["_id"], hot, spread=F.col("_key"))
    members = scratch.save(members.select("class_id", F.col("_id").alias("variant"), F.col("_key").alias(key)).distinct(), "members")
    spellings = members.groupBy("class_id", "variant").agg(F.min(key).alias("representative"), F.count(F.lit(1)).alias("n_rows"))
    classes = found.groupBy("class_id").agg(F.first("canonical").alias("canonical"), F.count(F.lit(1)).alias("n_spellings"), F.sum("_n").alias("n_rows"))
    return LookAlikes(classes, spellings, members)


def look_alike_pairs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_a, doc_b) with doc_a < doc_b: all pairs of rows whose texts differ but look the same.

    This expands :func:`look_alike_classes`, for results that ask for every pair.
    Pairs of spellings are formed first, then expanded by the rows that hold them,
    so rows with equal texts are never paired with each other, not even to be
    thrown away. Repeated rows give a pair once. A common spelling's rows are
    divided over tasks.
    """
    found = look_alike_classes(df, key, text)
    total = max(1, found.members.count())
    hot = hot_keys(found.spellings, ["variant"], "n_rows", total)
    other = found.spellings.select("class_id", F.col("variant").alias("_w"))
    spelled = found.spellings.select("class_id", "variant").join(other, "class_id").where("variant < _w").select("variant", "_w")
    one = join_hot(found.members.select("variant", F.col(key).alias("_a")), spelled, ["variant"], hot, spread=F.col("_a")).select("_a", F.col("_w").alias("variant"))
    pairs = join_hot(one, found.members.select("variant", F.col(key).alias("_b")), ["variant"], hot, spread=F.col("_a")).where("_a <> _b")
    return pairs.select(F.least("_a", "_b").alias("doc_a"), F.greatest("_a", "_b").alias("doc_b"))
