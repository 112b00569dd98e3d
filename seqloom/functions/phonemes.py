"""Phoneme features, encodings of position and context, kana; all as map look-ups and array expressions inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order of the 32 feature bits.
BITS = """
vowel consonant silence long nasal fricative plosive semivowel
bilabial alveolar palatal velar glottal dental
m_stop m_fricative m_nasal m_liquid m_glide voiced aspirated palatalized
front central back high mid low rounded unrounded v_long nasalized
""".split()

# The features of each phoneme and its other spellings.
PHONEMES = """
a: vowel central low unrounded
i: vowel front high unrounded
u: vowel back high rounded
e: vowel front mid unrounded
o: vowel back mid rounded
aa a:: vowel central low unrounded long v_long
ii i:: vowel front high unrounded long v_long
uu u:: vowel back high rounded long v_long
ee e:: vowel front mid unrounded long v_long
oo o:: vowel back mid rounded long v_long
p: consonant plosive m_stop bilabial
b: consonant plosive m_stop bilabial voiced
t: consonant plosive m_stop alveolar
d: consonant plosive m_stop alveolar voiced
k: consonant plosive m_stop velar
g: consonant plosive m_stop velar voiced
s: consonant fricative m_fricative alveolar
z: consonant fricative m_fricative alveolar voiced
sh ʃ: consonant fricative m_fricative palatal palatalized
zh ʒ: consonant fricative m_fricative palatal palatalized voiced
h: consonant fricative m_fricative glottal
m: consonant nasal m_nasal bilabial voiced
n: consonant nasal m_nasal alveolar voiced
ng ŋ: consonant nasal m_nasal velar voiced
r: consonant m_liquid alveolar voiced
y: consonant semivowel m_glide palatal voiced
w: consonant semivowel m_glide velar voiced
ts: consonant plosive alveolar
dz: consonant plosive alveolar voiced
ch tʃ: consonant plosive palatal palatalized
j dʒ: consonant plosive palatal palatalized voiced
sil <SIL> pau: silence
Q っ: consonant plosive
N ん: consonant nasal m_nasal voiced
"""

# Kana and their letters; the first kana of equal letters is the one to go back to.
KANA = """
あ a い i う u え e お o
か ka き ki く ku け ke こ ko が ga ぎ gi ぐ gu げ ge ご go
さ sa し shi す su せ se そ so ざ za じ ji ず zu ぜ ze ぞ zo
た ta ち chi つ tsu て te と to だ da ぢ ji づ zu で de ど do
な na に ni ぬ nu ね ne の no
は ha ひ hi ふ fu へ he ほ ho ば ba び bi ぶ bu べ be ぼ bo ぱ pa ぴ pi ぷ pu ぺ pe ぽ po
ま ma み mi む mu め me も mo
や ya ゆ yu よ yo ら ra り ri る ru れ re ろ ro わ wa を wo ん n
ゃ ya ゅ yu ょ yo っ xtu ぁ xa ぃ xi ぅ xu ぇ xe ぉ xo
""".split()

# The labels of an inventory in the order of their numbers.
INVENTORY = """
sil unk a i u e o
k g s z t d n h b p m y r w
ka ki ku ke ko ga gi gu ge go
sa shi su se so za ji zu ze zo
ta chi tsu te to da di du de do
na ni nu ne no ha hi fu he ho
ba bi bu be bo pa pi pu pe po
ma mi mu me mo ya yu yo
ra ri ru re ro wa wi we wo
br cl
""".split()


def _masks() -> dict[str, int]:
    found = {}
    for line in PHONEMES.strip().splitlines():
        names, features = line.split(": ")
        for name in names.split():
            found[name] = sum(1 << BITS.index(f) for f in features.split())
    return found


MASKS = _masks()
SILENCE = 1 << BITS.index("silence")
ROMAJI = dict(zip(KANA[::2], KANA[1::2], strict=True))
#: Small kana have no way back.
HIRAGANA = {r: k for k, r in reversed(ROMAJI.items()) if k not in "ゃゅょっぁぃぅぇぉ"}
CODES = {p: i for i, p in enumerate(INVENTORY)}


def _map(entries: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def mask(phoneme: Column) -> Column:
    """The features as a number: those of the phoneme as spelt, else in lower case, else (and for null) those of silence."""
    table = _map(MASKS)
    return F.coalesce(F.try_element_at(table, phoneme), F.try_element_at(table, F.lower(phoneme)), F.lit(SILENCE))


def _each(values: list[Column], of: Callable[[Column], Column]) -> Column:
    """The arrays that ``of`` makes of each value, one after the other; a value is computed once, however often ``of`` uses it."""
    return F.flatten(F.transform(F.array(*values), of))


def _places(n: int) -> Column:
    return F.sequence(F.lit(0), F.lit(n - 1))


def bits(*masks: Column) -> Column:
    """The 32 features of each mask as an array of 0 and 1."""
    return _each(list(masks), lambda m: F.transform(_places(len(BITS)), lambda i: F.getbit(m, i).cast("double")))


def category(mask: Column) -> Column:
    """What kind of sound a mask stands for, the first that holds of a fixed order."""
    has = lambda name: mask.bitwiseAND(1 << BITS.index(name)) != 0
    found = F.when(has("silence"), "silence").when(has("vowel") & has("long"), "long_vowel")
    for name in ("vowel", "nasal", "plosive", "fricative", "semivowel", "consonant"):
        found = found.when(has(name), name)
    return found.otherwise("unknown")


def position_vector(ratios: list[Column], flags: list[Column], strength: Column, accent: Column, boundaries: list[Column]) -> Column:
    """16 numbers: five ratios, six edge flags, accent strength, whether there is an accent, a tenth of its position (-1 for none), two boundary flags."""
    as_number = lambda c: F.coalesce(c.cast("int"), F.lit(0)).cast("float")
    number = lambda c: F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))
    where = F.coalesce(accent, F.lit(-1))
    middle = [number(strength), as_number(where >= 0), (where.cast("float") / F.lit(10.0).cast("float")).cast("float")]
    return F.array(*map(number, ratios), *map(as_number, flags), *middle, *map(as_number, boundaries))


def context_vector(phonemes: list[Column], positions: list[Column], timing: list[Column], midi: list[Column], vcv: list[Column]) -> Column:
    """Bits of each phoneme, then each position vector, then duration, confidence and validity, note / 127, velocity / 127 and hertz / 1000
    (zeros without a note above 0), and confidence and presence of the three parts (zeros where the first of ``vcv``, validity, is not true).

    Seven phonemes and positions give 346 numbers. All are rounded to single precision; nulls count as zero."""
    number = lambda c: F.coalesce(c.cast("float"), F.lit(0.0).cast("float"))
    note = F.coalesce(midi[0] > 0, F.lit(False))
    scaled = [F.when(note, number(x) / s).otherwise(0.0).cast("float") for x, s in zip(midi, (127, 127, 1000), strict=True)]
    valid, confidence, *parts = vcv
    ok = F.coalesce(valid, F.lit(False))
    tail = [F.when(ok, number(confidence)).otherwise(0.0), *(F.when(ok & (F.length(p) > 0), 1.0).otherwise(0.0) for p in parts)]
    # all but the bits are single precision already
    rest = F.concat(*(p.cast("array<float>") for p in positions), F.array(*map(number, timing)), F.array(*scaled), F.array(*tail).cast("array<float>"))
    return F.concat(bits(*map(mask, phonemes)), rest.cast("array<double>"))


def code(label: Column) -> Column:
    """The label's number in the inventory; that of ``unk`` where it has none."""
    return F.coalesce(F.try_element_at(_map(CODES), label), F.lit(CODES["unk"]))


def quinphone_vector(labels: list[Column], numbers: list[Column], one_hot: bool = True) -> Column:
    """Labels as one-hot vectors over the inventory (or as numbers), followed by the continuous features."""
    codes = [code(x) for x in labels]
    if one_hot:
        part = _each(codes, lambda c: F.transform(_places(len(INVENTORY)), lambda i: (i == c).cast("double")))
    else:
        part = F.array(*codes).cast("array<double>")
    return F.concat(part, F.array(*(x.cast("double") for x in numbers)))


def romaji(kana: Column) -> Column:
    """Each kana in letters; other characters stay."""
    table = _map(ROMAJI)
    return F.array_join(F.transform(F.split(kana, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


def hiragana(letters: Column) -> Column:
    """The kana of one syllable, or the text itself where it is none."""
    return F.coalesce(F.try_element_at(_map(HIRAGANA), letters), letters)


def is_hiragana(text: Column) -> Column:
    return text.rlike("^[ぁ-ゖ]+$")


def is_romaji(text: Column) -> Column:
    return text.rlike("^[a-z]+$")
