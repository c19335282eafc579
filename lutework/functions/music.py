"""Pitch and position arithmetic of the seven-string zither as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# String fractions and harmonic intervals of the thirteen studs, degrees of the major scale, pitch classes, the three
# tonics whose first degree is pinned, and the semitones by which positions outside the studs lie below their anchor.
STUD_FRACTIONS = [1 / 8, 1 / 6, 1 / 5, 1 / 4, 1 / 3, 2 / 5, 1 / 2, 3 / 5, 2 / 3, 3 / 4, 4 / 5, 5 / 6, 7 / 8]
HARMONIC_SEMITONES = [36, 31, 28, 24, 19, 28, 12, 28, 19, 24, 28, 31, 36]
MAJOR = [0, 2, 4, 5, 7, 9, 11]
PITCH_CLASS = {"C": 0, "C#": 1, "DB": 1, "D": 2, "D#": 3, "EB": 3, "E": 4, "F": 5, "F#": 6, "GB": 6, "G": 7, "G#": 8, "AB": 8, "A": 9, "A#": 10, "BB": 10, "B": 11}
PINNED_TONICS = {"F": 65.0, "C": 60.0, "B": 58.0}
NOTE_NAMES = ["C", "C♯", "D", "E♭", "E", "F", "F♯", "G", "A♭", "A", "B♭", "B"]
OUTSIDE_DROP, OUTSIDE_ANCHOR = {"徽外": 1.0, "徽外半": 2.0}, 12.3
STANDARD_TUNING = [48.0, 50.0, 53.0, 55.0, 57.0, 60.0, 62.0]
ZH_NUMBERS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12, "十三": 13}


def _table(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def stud_fraction(hui: Column) -> Column:
    """The fraction of the string at a stud position, linear between studs; null outside 1 to 13."""
    low = F.floor(hui).cast("int")
    a, b = F.get(_table(STUD_FRACTIONS), low - 1), F.get(_table(STUD_FRACTIONS), F.least(low, F.lit(12)))
    return F.when(hui.between(1, 13), a + (hui - low) * (b - a))


def stopped_pitch(opened: Column, hui: Column) -> Column:
    return opened + F.lit(12.0) * F.log2(F.lit(1.0) / stud_fraction(hui))


def outside_pitch(opened: Column, label: Column) -> Column:
    """A position beyond the studs: so many semitones below the anchor."""
    return stopped_pitch(opened, F.lit(OUTSIDE_ANCHOR)) - _lookup(OUTSIDE_DROP)[label]


def harmonic_pitch(opened: Column, hui: Column) -> Column:
    """Null at positions between studs."""
    return F.when((hui == F.floor(hui)) & hui.between(1, 13), opened + F.get(_table(HARMONIC_SEMITONES), F.floor(hui).cast("int") - 1))


def position_pitch(opened: Column, hui: Column, label: Column, mode: Column) -> Column:
    """The sounding pitch of an open, stopped, outside or harmonic position."""
    return (
        F.when(mode == "open", opened)
        .when(label.isNotNull() & (mode == "harmonic"), F.lit(None).cast("double"))
        .when(label.isNotNull(), outside_pitch(opened, label))
        .when(mode == "harmonic", harmonic_pitch(opened, hui))
        .otherwise(stopped_pitch(opened, hui))
    )


def tone_region_cost(hui: Column, mode: Column) -> Column:
    """A mild prior for the middle of the string."""
    cost = F.abs(hui - 7.5) * 0.12 + F.greatest(F.lit(0.0), 4 - hui) * 0.8 + F.greatest(F.lit(0.0), hui - 11) * 0.9
    return F.when(mode == "open", F.lit(0.25)).when(mode == "harmonic", F.lit(0.45)).otherwise(F.round(cost, 6))


def node_cost(cents: Column, region_cost: Column) -> Column:
    return F.abs(cents) * 0.03 + region_cost


def transition_cost(string: Column, hui: Column, prev_string: Column, prev_hui: Column, beats: Column, prev_direction: Column) -> Column:
    """The cost of a move between positions in the given time; a null hui is an open string."""
    at = lambda h: F.coalesce(stud_fraction(h), F.lit(0.0))
    delta, far = F.abs(string - prev_string), F.abs(at(hui) - at(prev_hui))
    turn = F.when((direction(hui, prev_hui) * prev_direction) < 0, F.lit(0.35)).otherwise(F.lit(0.0))
    fast = F.when(beats < 0.5, far * 4.0 / F.greatest(beats, F.lit(0.125))).otherwise(F.lit(0.0))
    return delta * 0.75 + F.greatest(F.lit(0), delta - 1) * 0.30 + far * 8.0 + fast + turn


def direction(hui: Column, prev_hui: Column) -> Column:
    return F.coalesce(F.sign(hui - prev_hui), F.lit(0.0)).cast("int")


# The names of lengths and their ticks, each sought before the names that are part of it.
LENGTHS = {"六十四分": 60, "三十二分": 120, "十六分": 240, "八分": 480, "四分": 960, "二分": 1920, "全音": 3840}


def ticks(name: Column) -> Column:
    """The ticks of a length by its name; a quarter's where none is named."""
    out = F.lit(LENGTHS["四分"])
    for word, n in reversed(LENGTHS.items()):
        out = F.when(name.contains(word), F.lit(n)).otherwise(out)
    return out


def degree_midi(text: Column, tonic: Column) -> Column:
    """Numbered notation to MIDI; combining dots move octaves; null for rests, ties and texts without a degree."""
    count = lambda ch: F.length(text) - F.length(F.translate(text, ch, ""))
    degree = F.try_element_at(_table(MAJOR), F.regexp_extract(text, "([1-7])", 1).try_cast("int"))
    shift = (count("̇") - count("̣")) * 12 + count("♯#") - count("♭b")
    rest = text.contains("休止") | text.contains("延音")
    return F.when(~rest, tonic + degree + shift)


def tonic_midi(tonic: Column, captured: Column) -> Column:
    """The first degree of a tonic such as 1=F; a captured value wins; null where the letter is unknown."""
    letter = F.trim(F.element_at(F.split(F.coalesce(tonic, F.lit("1=C")), "="), -1))
    letter = F.when(letter.rlike("^b[A-Ga-g]$"), F.concat(F.upper(F.substring(letter, 2, 1)), F.lit("B"))).otherwise(F.upper(letter))
    letter = F.replace(F.replace(letter, F.lit("♯"), F.lit("#")), F.lit("♭"), F.lit("B"))
    named = F.coalesce(_lookup(PINNED_TONICS)[letter], _lookup(PITCH_CLASS)[letter] + F.lit(60.0))
    return F.coalesce(captured.cast("double"), named)


def compact_stud(text: Column) -> Column:
    """Compact stud spellings: 76 is 7.6, X is 10, X1 to X3 are 11 to 13, other X digits are tenths; null for open, outside or unknown."""
    t = F.upper(F.trim(text))
    number, digits = t.try_cast("double"), F.regexp_extract(t, r"^X(\d+)$", 1)
    whole = F.substring(digits, 1, 1).try_cast("double")
    tenth = F.concat(F.lit("0."), F.substring(digits, 2, 20)).try_cast("double")
    tens = F.when(digits.isin("1", "2", "3"), 10 + digits.try_cast("double")).when(F.length(digits) == 1, 10 + digits.try_cast("double") / 10).otherwise(10 + whole + tenth)
    return (
        F.when(t.isin("", "OPEN", "SAN", "散", "0", "Y", "徽外"), F.lit(None).cast("double"))
        .when(t.rlike(r"^\d+(\.\d+)?$") & ~t.contains(".") & (F.length(t) == 2) & (number > 13), F.substring(t, 1, 1).try_cast("double") + F.substring(t, 2, 1).try_cast("double") / 10)
        .when(t.rlike(r"^\d+(\.\d+)?$"), number)
        .when(t == "X", F.lit(10.0))
        .when(digits != "", tens)
    )


def midi_name(midi: Column) -> Column:
    n = F.rint(midi).cast("int")
    return F.concat(F.get(_table(NOTE_NAMES), F.pmod(n, F.lit(12))), (F.floor(n / 12) - 1).cast("string"))
