"""letters read aloud, matched by their spoken names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.maths import half_up

# Spoken names of Urdu letters and digits.
URDU_NAMES = {
    "ا": ["الف", "الیف", "alif", "alef"],
    "ب": ["بے", "بی", "bay", "be", "bee"],
    "پ": ["پے", "پی", "pay", "pe", "pee"],
    "ت": ["تے", "تی", "tay", "te", "tee"],
    "ٹ": ["ٹے", "ٹی", "ttay", "tte", "ttee"],
    "ث": ["ثے", "ثی", "say", "se", "see"],
    "ج": ["جیم", "جم", "jeem", "jim", "jm"],
    "چ": ["چے", "چی", "chay", "che", "chee"],
    "ح": ["حے", "حی", "hay", "he", "hee", "bari he"],
    "خ": ["خے", "خی", "khay", "khe", "khee"],
    "د": ["دال", "ڈال", "daal", "dal"],
    "ڈ": ["ڈال", "ڈڈال", "ddaal", "ddal"],
    "ذ": ["ذال", "zaal", "zal"],
    "ر": ["رے", "ری", "ray", "re", "ree"],
    "ڑ": ["ڑے", "ڑی", "rray", "rre"],
    "ز": ["زے", "زی", "zay", "ze", "zee"],
    "ژ": ["ژے", "ژی", "zhay", "zhe"],
    "س": ["سین", "سن", "seen", "sin"],
    "ش": ["شین", "شن", "sheen", "shin"],
    "ص": ["صاد", "صواد", "suad", "sad", "swad"],
    "ض": ["ضاد", "ضواد", "zuad", "zad", "zwad"],
    "ط": ["طوئے", "طے", "toay", "toe", "toy"],
    "ظ": ["ظوئے", "ظے", "zoay", "zoe", "zoy"],
    "ع": ["عین", "عن", "ain", "ayn"],
    "غ": ["غین", "غن", "ghain", "ghayn"],
    "ف": ["فے", "فی", "fay", "fe", "fee"],
    "ق": ["قاف", "قف", "qaaf", "qaf"],
    "ک": ["کاف", "کف", "kaaf", "kaf"],
    "گ": ["گاف", "گف", "gaaf", "gaf"],
    "ل": ["لام", "لم", "laam", "lam"],
    "م": ["میم", "مم", "meem", "mim"],
    "ن": ["نون", "نن", "noon", "nun"],
    "و": ["واؤ", "واو", "wao", "vao", "wow"],
    "ہ": ["ہے", "ہی", "hay", "he", "choti he", "gol he"],
    "ھ": ["دو چشمی ہے", "dochasmi he", "do chashmi"],
    "ء": ["ہمزہ", "hamza", "hamzah"],
    "ی": ["یے", "یی", "yay", "ye", "yee", "choti ye"],
    "ے": ["بڑی یے", "bari ye", "bari yay"],
    "۰": ["صفر", "زیرو", "zero", "sifar"],
    "۱": ["ایک", "one", "ek"],
    "۲": ["دو", "two", "do"],
    "۳": ["تین", "three", "teen"],
    "۴": ["چار", "four", "char"],
    "۵": ["پانچ", "five", "paanch"],
    "۶": ["چھ", "six", "chhe"],
    "۷": ["سات", "seven", "saat"],
    "۸": ["آٹھ", "eight", "aath"],
    "۹": ["نو", "nine", "nau"],
}

# Spoken names and sounds of English letters.
ENGLISH_SOUNDS = {
    "a": ["ay", "a", "ah", "ae"],
    "b": ["bee", "be", "buh", "b"],
    "c": ["see", "cee", "ce", "c", "kuh", "suh"],
    "d": ["dee", "de", "d", "duh"],
    "e": ["ee", "e", "eh"],
    "f": ["ef", "eff", "f", "fuh"],
    "g": ["jee", "gee", "ge", "g", "guh"],
    "h": ["aitch", "aych", "h", "huh"],
    "i": ["eye", "ai", "i", "ih"],
    "j": ["jay", "je", "j", "juh"],
    "k": ["kay", "ke", "k", "kuh"],
    "l": ["el", "ell", "l", "luh"],
    "m": ["em", "emm", "m", "muh"],
    "n": ["en", "enn", "n", "nuh"],
    "o": ["oh", "o", "aw"],
    "p": ["pee", "pe", "p", "puh"],
    "q": ["cue", "queue", "kyoo", "q", "kwuh"],
    "r": ["ar", "are", "r", "ruh"],
    "s": ["es", "ess", "s", "suh"],
    "t": ["tee", "te", "t", "tuh"],
    "u": ["you", "yu", "u", "uh"],
    "v": ["vee", "ve", "v", "vuh"],
    "w": ["double you", "double u", "w", "wuh"],
    "x": ["ex", "x", "ks"],
    "y": ["why", "wye", "y", "yuh"],
    "z": ["zee", "zed", "z", "zuh"],
}
UPPER_WORDS = ["capital", "big"]
LOWER_WORDS = ["small", "little", "lowercase"]


def spoken_names(letter: str) -> list[str]:
    """All names of one symbol; empty when it has none."""
    if letter in URDU_NAMES:
        return URDU_NAMES[letter]
    if letter.lower() not in ENGLISH_SOUNDS:
        return []
    words = UPPER_WORDS if letter.isupper() else LOWER_WORDS
    low = letter.lower()
    return ENGLISH_SOUNDS[low] + [f"{w} {low}" for w in words]


def normalize(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[،؟۔,.!?:;'\"()\[\]{}]", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def letters_correct(readings: DataFrame) -> DataFrame:
    """``readings(id, letters array<string>, transcript)`` to ``id, total, matched, accuracy``.

    A letter counts when any of its names occurs in the cleaned transcript; a symbol without
    names is looked for itself. Letters and transcript share a row, so nothing is shuffled: the
    name table is a literal map.
    """
    letters = list(URDU_NAMES) + list(ENGLISH_SOUNDS) + [x.upper() for x in ENGLISH_SOUNDS]
    table = F.create_map(
        *[c for x in letters for c in (F.lit(x), F.array(*[F.lit(n) for n in spoken_names(x)]))]
    )
    clean = readings.withColumn("_clean", normalize(F.col("transcript")))
    has_text = F.coalesce("transcript", F.lit("")) != ""

    def read(letter: Column) -> Column:
        names = F.coalesce(table[letter], F.array(normalize(letter)))
        return has_text & F.exists(names, lambda n: F.contains(F.col("_clean"), n))

    total = F.coalesce(F.size("letters"), F.lit(0))
    matched = F.size(F.filter("letters", read))
    return clean.select(
        "id",
        total.alias("total"),
        matched.alias("matched"),
        F.when(total == 0, 0).otherwise(half_up(matched / total * 100)).cast("int").alias("accuracy"),
    )
