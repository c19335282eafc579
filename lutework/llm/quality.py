"""Line-first quality cleaning, in DataFrame functions throughout.

Every line is judged by itself: a punctuation rule (more symbols than SYMBOLS_PER_WORD for each word, or no letter or digit at all), a
navigation rule (several separators, or a list of menu words) and a boilerplate rule (set phrases). Lines that fail go; a document is
kept if it passes the base rules and enough of its words stand in the lines that are left.

Defined results: null, empty and blank texts have no words and fail the base rules; lines without words are no lines; rows are judged
one by one, so that ties and repeated rows don't matter; an empty table gives an empty result; other columns are ignored or passed on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACES, fenced, row_of, words

WINDOW, LEAST_WORDS, REPEATED_PERCENT = 8, 20, 30
SYMBOLS_PER_WORD, SEPARATORS, KEPT_SHARE = 0.25, 3, 0.5
NAVIGATION = r"\| |» |› |· | > | / |• "
#: Words of menus and phrases of boilerplate in English, German, French and Spanish.
MENU_WORDS = (
    "home|menu|about( us)?|contact( us)?|log ?in|sign (in|up)|search|next|previous|back( to top)?|faq|help|news|share|sitemap|register"
    "|startseite|menü|über uns|kontakt|impressum|anmelden|suche|weiter|zurück|hilfe|registrieren"
    "|accueil|à propos|contactez-nous|connexion|recherche|suivant|précédent|aide|plan du site|inscription"
    "|inicio|menú|acerca de|contacto|iniciar sesión|buscar|siguiente|anterior|ayuda|mapa del sitio|regístrate"
)
PHRASES = (
    "all rights reserved|terms (of|and) (use|service|conditions)|privacy policy|cookies? policy|we use cookies|accept cookies"
    "|enable javascript|click here|subscribe to (our|the)|sign up for|follow us on|share (this|on)|read more|powered by|skip to content"
    "|alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|wir verwenden cookies|cookies akzeptieren|hier klicken|newsletter abonnieren"
    "|weiterlesen|zum inhalt springen"
    "|tous droits réservés|conditions (générales )?d'utilisation|politique de confidentialité|nous utilisons des cookies|cliquez ici|abonnez-vous"
    "|lire la suite|aller au contenu"
    "|todos los derechos reservados|términos y condiciones|política de privacidad|utilizamos cookies|haga clic aquí|suscríbete|leer más|saltar al contenido"
)
#: What a text with a phrase has, in lower case: each phrase holds one of these. A long s, which lower case leaves, counts as one, too.
STEMS = (
    "rights reserved|terms |privacy policy|cookie|javascript|click here|subscribe to |sign up for|follow us on|share |read more|powered by|skip to content|rechte vorbehalten|nutzungsbed|datenschutzerkl|hier klicken"
    "|newsletter|weiterlesen|zum inhalt|droits réservés|conditions |politique de|cliquez ici|abonnez-vous|lire la suite|aller au contenu|los derechos|términos y|política de|haga clic|suscríbete|leer más|saltar al|ſ"
).split("|")
MENU, BOILERPLATE = rf"(?iu)^\W*(({MENU_WORDS})\W*)+$", rf"(?iu)({PHRASES})"


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[#*$%&|<>]"))


def _n_words(line: Column) -> Column:
    return F.size(F.split(F.btrim(line, F.lit(SPACE)), SPACES))


def has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE)) != ""


def line_fails(line: Column, phrased: Column | None = None) -> Column:
    """Whether the line fails one of the three rules; line has a word. phrased: whether its text may hold a phrase at all, where that is known."""
    # the words are counted of lines with symbols only
    punctuation = ((_symbols(line) > 0) & (_symbols(line) > _n_words(line) * F.lit(SYMBOLS_PER_WORD))) | ~line.rlike(r"[\p{L}\p{N}]")
    separators = F.size(F.split(line, NAVIGATION)) - 1 >= SEPARATORS
    boilerplate = line.rlike(BOILERPLATE)
    return punctuation | separators | line.rlike(MENU) | (boilerplate if phrased is None else phrased & boilerplate)


def _paired(hashes: Column, step: int) -> Column:
    """Each hash with the one so many places behind it."""
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + step)))


def measured(docs: DataFrame) -> DataFrame:
    """Of docs (text, ...): row, a struct of all its columns, kept_lines, those that passed, and the MEASURES. A word stands in a repeated window if one of the windows of WINDOW words over it comes twice or more in the text, the first time included."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    split = docs.select(row_of(docs)).withColumn("__w", words(F.col("row.text"))).withColumn("__lines", F.filter(F.split(text, "\n"), has_word))
    n = F.size("__w")
    # a window's hash from its words' hashes; none in texts shorter than a window
    # of pairs, then of pairs of pairs, and of those: three hashes of two, whatever the words
    hashed = split.withColumn("__wh", F.transform("__w", lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):
        hashed = hashed.withColumn("__wh", _paired(F.col("__wh"), step))
    none = F.array().cast("array<bigint>")
    hashed = hashed.withColumn("__win", F.when(n >= WINDOW, F.slice("__wh", F.lit(1), n - WINDOW + 1)).otherwise(none))
    # most texts repeat no window: only the others are sorted
    some = F.size(F.array_distinct("__win")) < F.size("__win")
    ordered = F.when(some, F.sort_array(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    hashed = hashed.withColumn("__ord", ordered)
    lower = F.lower(text)
    phrased = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(x)) for x in STEMS])
    # each line beside the text's flag, which array_repeat evaluates once
    flags = F.array_repeat(phrased, F.size("__lines"))
    judged = F.zip_with("__lines", flags, lambda x, p: F.struct(x.alias("line"), line_fails(x, p).alias("fails")))
    hashed = hashed.withColumn("__judged", judged)
    hashed = hashed.withColumn("__kept", F.transform(F.filter("__judged", lambda x: ~x["fails"]), lambda x: x["line"])).withColumn("__gone", F.filter("__judged", lambda x: x["fails"]))
    last = F.size("__ord")

    def twice(x: Column, k: Column) -> Column:
        o = F.col("__ord")
        return ((k > 0) & (F.get(o, k - 1)["h"] == x["h"])) | ((k < last - 1) & (F.get(o, k + 1)["h"] == x["h"]))

    places = F.array_sort(F.transform(F.filter("__ord", twice), lambda x: x["i"]))
    hashed = hashed.withColumn("__at", F.when(some, places).otherwise(F.array().cast("array<int>")))
    at = F.col("__at")
    # each place adds the words up to the next one, a window's at most
    repeats = F.aggregate(
        F.transform(at, lambda p, k: F.when(k < F.size(at) - 1, F.least(F.lit(WINDOW), F.get(at, k + 1) - p)).otherwise(F.lit(WINDOW))),
        F.lit(0), lambda a, x: a + x,
    )
    gone = F.aggregate("__gone", F.lit(0), lambda a, x: a + _n_words(x["line"]))
    long = {
        "n_words": n,
        "word_chars": F.length(F.array_join("__w", "")),
        "n_symbols": _symbols(text),
        "n_dup_lines": F.size("__lines") - F.size(F.array_distinct("__lines")),
        "n_repeat_words": repeats,
        "n_lines": F.size("__lines"),
        "n_kept_lines": F.size("__kept"),
        "kept_words": n - gone,
    }
    out = hashed.select("row", F.col("__kept").alias("kept_lines"), *[c.cast("long").alias(k) for k, c in long.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEATED_PERCENT)
    enough = F.col("kept_words") >= F.col("n_words") * F.lit(KEPT_SHARE)
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & enough)


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_kept_lines", "kept_words"]


def report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the measures and the verdict."""
    found = measured(docs.select("doc_id", "text"))
    return found.select("row.doc_id", *MEASURES)


def cleaned(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, their text being the lines that passed, and n_chars its length where docs has such a column."""
    text = F.array_join("kept_lines", "\n")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return fenced(measured(docs)).where("kept").select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])


ORACLE_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT r, i, array_to_string(w[i + 1 : i + 8], ' ') AS g FROM (SELECT r, w, unnest(range(len(w) - 7)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT r, i FROM win QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY r),
judged AS (SELECT *, list_filter(lines, lambda x: NOT (
      length(x) - length(translate(x, '#*$%&|<>', '')) > 0.25::DOUBLE * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+'))
      OR NOT regexp_matches(x, '[\p{L}\p{N}]')
      OR len(regexp_extract_all(x, '\| |» |› |· | > | / |• ')) >= 3
      OR regexp_matches(x, '(?i)^[^a-zA-Z0-9_]*((MENU_WORDS)[^a-zA-Z0-9_]*)+$')
      OR regexp_matches(x, '(?i)(PHRASES)')
    )) AS good FROM w),
m AS (SELECT r, doc_id, len(w)::BIGINT AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
      (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(good)::BIGINT AS n_kept_lines,
      coalesce(list_sum(list_transform(good, lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))), 0)::BIGINT AS kept_words
      FROM judged LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_kept_lines, kept_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  (NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND kept_words >= 0.5::DOUBLE * n_words) AS kept
FROM m
""".replace("MENU_WORDS", MENU_WORDS).replace("PHRASES", PHRASES.replace("'", "''"))
