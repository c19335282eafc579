"""Text functions over notation cells and documents as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .music import ZH_NUMBERS, _lookup

_ONE = "一二三四五六七1-7"


def number(token: Column) -> Column:
    return _lookup(ZH_NUMBERS | {str(i): i for i in range(1, 10)})[token]


def string_numbers(text: Column) -> Column:
    """The strings named in a cell, compact sequences such as 四七弦 as two; 如一 names a technique."""
    bare = F.replace(text, F.lit("如一"), F.lit(""))
    found = F.regexp_extract_all(bare, F.lit(f"([{_ONE}]{{2,}}|十[一二三]?|[{_ONE}])弦"), F.lit(1))
    each = F.flatten(F.transform(found, lambda x: F.when(x.startswith("十"), F.array(x)).otherwise(F.filter(F.split(x, ""), lambda c: c != ""))))
    return F.filter(F.transform(each, lambda x: number(x)), lambda n: n.between(1, 7))


def sweep_strings(text: Column) -> Column:
    """The ordered strings of a sweep: a range by 至, in either direction, or a list."""
    a = F.regexp_extract(text, f"[历歷厉]([{_ONE}])弦?至([{_ONE}])弦", 1)
    b = F.regexp_extract(text, f"[历歷厉]([{_ONE}])弦?至([{_ONE}])弦", 2)
    listed = F.regexp_extract(text, f"[历歷厉]([{_ONE}](?:[、，,＋+]?\\s*[{_ONE}])+)", 1)
    tokens = F.regexp_extract_all(listed, F.lit(f"[{_ONE}]"), F.lit(0))
    return F.when(a != "", F.sequence(number(a), number(b))).otherwise(F.transform(tokens, lambda x: number(x)))


def stud(text: Column) -> Column:
    """The numeric stud position in a cell, tenths after 徽; null if none or outside."""
    pattern = "(十三|十二|十一|十|九|八|七|六|五|四|三|二|一)徽(?:([一二三四五六七八九])分)?"
    whole, tenth = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    value = number(whole) + F.coalesce(number(F.when(tenth != "", tenth)), F.lit(0)) / 10
    return F.when(~text.contains("徽外") & (whole != ""), value)


def stud_label(text: Column) -> Column:
    return F.when(text.contains("徽外半"), F.lit("徽外半")).when(text.contains("徽外"), F.lit("徽外"))


def first_of(text: Column, choices: list[str]) -> Column:
    """The first choice, in the order of the choices, that the text holds."""
    return F.get(F.filter(F.array(*[F.lit(c) for c in choices]), lambda c: F.contains(text, c)), 0)


def lexed(text: Column, lexicon: dict[str, str]) -> Column:
    """Canonical terms of a text by longest match from the left, each once, in the order of their first place."""
    keys = sorted(lexicon, key=lambda k: (-len(k), k))
    pattern = "|".join(f"\\Q{k}\\E" for k in keys)
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda x: _lookup(lexicon)[x]))


def token_counts(text: Column, terms: list[str]) -> Column:
    """How often each term comes, longest first, what is found being taken out before the next is sought: a map."""
    rest, out = text, []
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        out += [F.lit(term), ((F.length(rest) - F.length(F.replace(rest, F.lit(term), F.lit("")))) / len(term)).cast("long")]
        rest = F.replace(rest, F.lit(term), F.lit(""))
    return F.create_map(*out)


def canonical_cell(text: Column) -> Column:
    """A cell for comparison: full-width forms folded, brackets and white space gone, digits before 弦 in Chinese."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    folded = F.translate(F.coalesce(text, F.lit("")), wide + "　", "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " ")
    bare = F.regexp_replace(folded, r"[\s()\[\]{}]", "")
    for digit, zh in zip("1234567", "一二三四五六七", strict=True):
        bare = F.regexp_replace(bare, f"{digit}(?=弦)", zh)
    return bare


def markers(text: Column, terms: list[str]) -> Column:
    """All markers of a text, leftmost and longest first, without overlap."""
    pattern = "|".join(f"\\Q{t}\\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def redacted(text: Column, banned: list[str], mask: str) -> Column:
    """Banned terms masked whatever their case, the longest first."""
    pattern = "|".join(f"\\Q{t}\\E" for t in sorted(banned, key=lambda t: (-len(t), t)))
    return F.regexp_replace(text, f"(?i)({pattern})", mask)


def new_numbers(before: Column, after: Column) -> Column:
    """Numbers that stand in a rewritten text and not in its source."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))
    return F.array_sort(F.array_except(numbers(after), numbers(before)))


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the sets of tokens; 0 where either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(x, y)), F.size(x) + F.size(y)), F.lit(0.0))


def bigrams(a: Column) -> Column:
    pairs = F.transform(a, lambda x, i: F.concat_ws(" ", x, F.get(a, i + 1)))
    return F.slice(pairs, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))


def tie_noise(seed: int, key: Column) -> Column:
    """A stable number from 0 to 1 of 32 hash bits."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


# Structure, gestures and spellings of cells

# Bars and repeats with their kinds and names, endings' numbers, and gestures of several sounds that are one.
BARS = {
    "|": ("bar", "小节线"), "||": ("double_bar", "双小节线"), "|||": ("multiple_bar", "多重小节线"), "|]": ("end_bar", "结束线"), "||:": ("repeat_start", "反复开始"),
    "|:": ("repeat_start", "反复开始"), ":||": ("repeat_end", "反复结束"), ":|": ("repeat_end", "反复结束"), "::": ("repeat_both", "反复结束／开始"),
}
ENDING_NUMBERS = {"1": "一", "2": "二", "3": "三", "4": "四", "5": "五", "6": "六", "7": "七", "8": "八", "9": "九", "10": "十"}
GESTURE = "掐(?:拨剌|拂[歷历]|撮)[一二三]声|[歷历]拂|拂[歷历]|拨"
DURATIONS = {"": "四分", "q": "八分", "s": "十六分", "d": "三十二分"}


def structure(token: Column) -> Column:
    """kind and label of a token that doesn't sound: a bar, a repeat or the bracket of an ending; null for any other."""
    raw = F.trim(F.coalesce(token, F.lit("")))
    pattern = r"^(\])?([|:]+)(?:\[([1-9][0-9,\-]*))?$"
    closing, base, ending = (F.regexp_extract(raw, pattern, k) for k in (1, 2, 3))
    kinds, labels = ({k: v[i] for k, v in BARS.items()} for i in (0, 1))
    shown = F.array_join(F.transform(F.regexp_extract_all(ending, F.lit(r"(\d+|[^\d]+)"), F.lit(1)), lambda x: F.coalesce(_lookup(ENDING_NUMBERS)[x], x)), "")
    bracket = (closing != "") | (ending != "")
    kind = F.coalesce(_lookup(kinds)[raw], F.when(bracket & _lookup(kinds)[base].isNotNull(), F.when(ending != "", "repeat_ending").otherwise(_lookup(kinds)[base])))
    parts = F.concat_ws("／", F.when(closing != "", "反复结尾结束"), _lookup(labels)[base], F.when(ending != "", F.concat(F.lit("第"), shown, F.lit("遍结尾"))))
    return F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.coalesce(_lookup(labels)[raw], parts).alias("label")))


def invalid_strings(text: Column) -> Column:
    """The strings outside one to seven that a cell names, sorted, each once."""
    tokens = F.regexp_extract_all(text, F.lit(r"([零〇一二三四五六七八九十百\d]+)\s*弦"), F.lit(1))
    units = {z: n for z, n in ZH_NUMBERS.items() if n <= 9}

    def values(x: Column) -> Column:
        left, right = F.substring_index(x, "十", 1), F.regexp_replace(x, "^[^十]*十", "")
        tens = F.when(left == "", F.lit(1)).otherwise(F.coalesce(_lookup(units)[left], F.lit(1)))
        each = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.coalesce(_lookup(units)[c], c.try_cast("int"), F.lit(0)))
        return (
            F.when(x.rlike("^[1-7]+$"), F.array().cast("array<int>")).when(x.rlike("^[0-9]+$"), F.array(x.try_cast("int"))).when(x.contains("百"), F.array(F.lit(100)))
            .when(x.contains("十"), F.array(tens * 10 + F.coalesce(_lookup(ZH_NUMBERS)[right], F.lit(0)))).otherwise(each)
        )

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(tokens, values)), lambda n: ~n.between(1, 7))))


def gesture(text: Column) -> Column:
    """The first gesture of several sounds; null if there is none."""
    return F.nullif(F.regexp_extract(text, f"({GESTURE})", 1), F.lit(""))


def without_gesture(text: Column) -> Column:
    """A cell without its first such gesture."""
    return F.regexp_replace(text, f"(?s)^(.*?)(?:{GESTURE})", "$1")


def reviewed_cell(text: Column) -> Column:
    """A cell for review: no white space, digits instead of Chinese numbers one to seven; null stays null."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "一二三四五六七", "1234567")


def rendered_stud(text: Column) -> Column:
    """Compact stud spellings written out: 79 is the seventh stud and nine tenths, X the tenth, X1 to X3 the eleventh to the thirteenth."""
    t = F.coalesce(text, F.lit(""))
    digits = {str(i): c for i, c in enumerate("〇一二三四五六七八九")}
    number = lambda n: F.when(n < 10, _lookup(digits)[n.cast("string")]).when(n == 10, "十").when(n < 20, F.concat(F.lit("十"), _lookup(digits)[(n - 10).cast("string")])).otherwise(n.cast("string"))
    tail = F.regexp_extract(t, r"^X(\d+)$", 1)
    head, last = F.regexp_extract(t, r"^(\d+)(\d)$", 1).try_cast("int"), F.regexp_extract(t, r"(\d)$", 1).try_cast("int")
    long = F.length(tail) >= 2
    hui = (
        F.when(t == "X", 10).when(long, 10 + F.substring(tail, 1, 1).try_cast("int")).when(tail.isin("0", "1", "2", "3"), 10 + tail.try_cast("int"))
        .when(tail != "", 10).when(t.rlike(r"^\d$"), t.try_cast("int")).when(t.rlike(r"^\d+$"), head)
    )
    tenths = F.when(long, F.substring(tail, 2, 9).try_cast("int")).when((tail != "") & ~tail.isin("0", "1", "2", "3"), tail.try_cast("int")).when(t.rlike(r"^\d{2,}$"), last)
    named = F.concat(number(hui), F.lit("徽"), F.when(F.coalesce(tenths, F.lit(0)) > 0, F.concat(number(tenths), F.lit("分"))).otherwise(""))
    return F.when(t == "Y", "徽外").when(hui.isNull(), t).otherwise(named)


def numbered_token(token: Column) -> Column:
    """A raw token of numbered notation: kind (bar, tie, run, grace, rest or note), code and name of its duration, pitch, octave, divisor and name."""
    dots = lambda n: F.when(n > 0, F.repeat(F.lit("̇"), n)).when(n < 0, F.repeat(F.lit("̣"), -n)).otherwise("")
    count = lambda t, ch: F.length(t) - F.length(F.replace(t, F.lit(ch), F.lit("")))
    level = lambda marks: count(marks, "'") - count(marks, ",")
    atoms = F.split(F.substring(token, 3, 1 << 20), "/")
    is_run = token.startswith("y:") & (F.size(atoms) >= 3) & F.forall(atoms, lambda a: a.rlike("^[1-7][',]*$"))
    run_name = F.concat(F.array_join(F.transform(atoms, lambda a: F.concat(F.substring(a, 1, 1), dots(level(a)))), " "), F.lit("（饰）"))
    grace = r"^y:([1-7])([',]*)(?:/(\d+))?'?$"
    plain = r"^([qsd]?)([0-7])?('*)(,*)"
    code, pitch = F.regexp_extract(token, plain, 1), F.regexp_extract(token, plain, 2)
    octave = F.length(F.regexp_extract(token, plain, 3)) - F.length(F.regexp_extract(token, plain, 4))
    graced, marks = F.regexp_extract(token, grace, 1), F.regexp_extract(token, grace, 2)
    no, word = F.lit(None).cast("int"), F.lit(None).cast("string")

    def fields(kind: str, code: Column, length: Column, pitch: Column, octave: Column, divisor: Column, name: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), code.alias("code"), length.alias("duration"), pitch.alias("pitch"), octave.alias("octave"), divisor.alias("divisor"), name.alias("name"))

    ornament = (F.lit("y"), F.lit("装饰音"))
    first = F.get(atoms, 0)
    return (
        F.when(structure(token).isNotNull(), fields("bar", word, F.lit("小节线"), no, no, no, F.lit("|")))
        .when(token == "-", fields("tie", word, word, no, no, no, F.lit("－（延音）")))
        .when(is_run, fields("run", *ornament, F.substring(first, 1, 1).try_cast("int"), level(first), no, run_name))
        .when(graced != "", fields("grace", *ornament, graced.try_cast("int"), level(marks), F.regexp_extract(token, grace, 3).try_cast("int"), F.concat(graced, dots(level(marks)), F.lit("（饰）"))))
        .when(pitch.isin("", "0"), fields("rest", code, _lookup(DURATIONS)[code], F.lit(0), no, no, F.lit("0（休止）")))
        .otherwise(fields("note", code, _lookup(DURATIONS)[code], pitch.try_cast("int"), octave, no, F.concat(pitch, dots(octave))))
    )


# Generated answers

def plain_words(text: Column) -> Column:
    """The words of a text in lower case, punctuation being blank."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda x: x != "")


def _grams(words: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))


def key_phrases(words: Column) -> Column:
    """Words of over three letters, and pairs and triples of words of over five in all."""
    none = F.array().cast("array<string>")
    grams = [F.when(F.size(words) >= n, _grams(words, n)).otherwise(none) for n in (2, 3)]
    return F.array_distinct(F.concat(F.filter(words, lambda w: F.length(w) > 3), F.filter(F.concat(*grams), lambda p: F.length(p) > 5)))


def answer_metrics(answer: Column, truth: Column, context: Column) -> dict[str, Column]:
    """Of word arrays: token F1, bigram precision (F1 where either side has no bigram), relevance and support of phrases."""
    a, t, c = F.array_distinct(answer), F.array_distinct(truth), F.array_distinct(context)
    f1 = F.when((F.size(a) == 0) & (F.size(t) == 0), F.lit(1.0)).otherwise(token_f1(answer, truth))
    none = F.array().cast("array<string>")
    pairs = lambda w: F.when(F.size(w) >= 2, F.array_distinct(_grams(w, 2))).otherwise(none)
    precision = F.when((F.size(answer) < 2) | (F.size(truth) < 2), f1).otherwise(F.size(F.array_intersect(pairs(answer), pairs(truth))) / F.size(pairs(answer)))
    said = key_phrases(answer)
    return {
        "token_f1": f1, "bigram_precision": precision, "relevance": F.coalesce(F.try_divide(F.size(F.array_intersect(a, c)).cast("double"), F.size(a)), F.lit(0.0)),
        "support": F.when(F.size(said) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(said, key_phrases(context))) / F.size(said)),
    }
