"""Quality rules: all failing rules of a document, or the first one."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarryline.functions import text as T

#: German stop words, and phrases that mark boilerplate.
STOPWORDS = ("der die das und ist ein eine mit fuer nicht werden wird im in den dem zu auf von sich dass auch als oder wenn diese dieser diesen ich du wir sie er es hat haben kann sind").split()
PHRASES = ("cookie", "cookies akzeptieren", "datenschutz", "newsletter", "javascript", "registrieren", "einloggen", "warenkorb", "agb")
#: Patterns of boilerplate, any case.
BOILERPLATE = (
    r"cookie[- ]?einstellungen",
    r"datenschutzerklärung",
    r"alle rechte vorbehalten",
    r"newsletter abonnieren",
    r"javascript (?:ist )?deaktiviert",
    r"bitte akzeptieren sie die cookies",
    r"zum inhalt springen",
    r"hier kostenlos herunterladen",
    r"download(?:en)? sie (?:jetzt|hier)",
    rf"copyright{T.SPACE}+\p{{Nd}}{{4}}",
    r"melden sie sich an",
    r"passwort vergessen",
)


@dataclass(frozen=True)
class PilotRules:
    min_chars: int = 200
    max_chars: int = 40_000
    min_words: int = 40
    max_run: int = 8
    max_non_letters: float = 0.40
    min_stopwords: int = 5
    phrases: tuple[str, ...] = PHRASES


@dataclass(frozen=True)
class StreamRules:
    min_chars: int = 300
    max_chars: int = 100_000
    max_urls: float = 0.05
    max_digits: float = 0.2
    max_symbols: float = 0.2
    min_words: int = 60
    min_letters: float = 0.55
    max_repeated_lines: float = 0.25
    max_repeated_ngrams: float = 0.12
    max_boilerplate: int = 2


@dataclass(frozen=True)
class MetadataRules:
    language: str = "deu"
    script: str = "Latn"
    min_language_score: float = 0.98
    min_quality_score: float = 0.25
    max_cluster: int = 500


def non_letter_ratio(c: Column) -> Column:
    seen = F.length(F.regexp_replace(c, f"{T.SPACE}+", ""))
    return T.let(seen, lambda n: F.when(n == 0, 1.0).otherwise(1 - T.matching_chars(c, r"\p{L}") / n))


def stopword_hits(c: Column) -> Column:
    return F.size(F.filter(T.words(c), lambda w: w.isin(*STOPWORDS))).cast("long")


def first_phrase(c: Column, phrases: tuple[str, ...]) -> Column:
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(p.lower()), F.lit(p)) for p in phrases])


def rejection_reasons(c: Column, rules: PilotRules = PilotRules()) -> Column:
    """Every failing rule, in a fixed order; an empty text fails by that alone."""
    return T.let(c, lambda t: _reasons(t, rules))


def _reasons(c: Column, rules: PilotRules) -> Column:
    failed = F.array_compact(
        F.array(
            F.when(F.length(c) < rules.min_chars, "too_short_chars"),
            F.when(T.word_count(c) < rules.min_words, "too_few_words"),
            F.when(c.rlike(rf"(?d)(.)\1{{{rules.max_run},}}"), "repeated_character_run"),
            F.when(non_letter_ratio(c) > rules.max_non_letters, "too_many_non_letters"),
            F.when(stopword_hits(c) < rules.min_stopwords, "not_enough_german_stopwords"),
            F.concat(F.lit("boilerplate:"), first_phrase(c, rules.phrases)),
        )
    )
    return F.when(F.coalesce(c, F.lit("")) == "", F.array(F.lit("empty_text"))).otherwise(failed)


def url_ratio(c: Column) -> Column:
    return (F.length(c) - F.length(F.regexp_replace(c, T.URL, ""))) / F.greatest(F.length(c), F.lit(1))


def share_of(c: Column, of_one: str) -> Column:
    return T.matching_chars(c, of_one) / F.greatest(F.length(c), F.lit(1))


def repeated_share(items: Column) -> Column:
    return T.let(items, lambda x: F.when(F.size(x) <= 0, 0.0).otherwise((F.size(x) - F.size(F.array_distinct(x))) / F.size(x)))


def lines(c: Column) -> Column:
    """The canonical form of each line that isn't blank; white space is looked at once for the whole text, not line by line."""
    return F.filter(F.transform(F.split(T.spaced(F.lower(c), T.LINE_ENDS), T.LINE_END), lambda x: F.trim(x)), lambda x: x != "")


def ngrams(w: Column, n: int) -> Column:
    none = F.array().cast("array<string>")
    made = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(x, i, F.lit(n)), " "))
    return T.let(w, lambda x: F.when(F.size(x) < n, none).otherwise(made(x)))


def repeats_ngrams(w: Column, n: int, most: float) -> Column:
    """Whether more than this share of the n-grams of words repeats another one.

    Hashes of n-grams differ in at most as many ways as the n-grams do, so a text whose hashes repeat little enough
    passes; only for the others the n-grams themselves are made.
    """
    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))
    seems = T.let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: repeated_share(hashes(h)) > most)
    return F.when(F.size(w) < n, F.lit(0.0) > most).when(seems, repeated_share(ngrams(w, n)) > most).otherwise(False)


def boilerplate_matches(c: Column) -> Column:
    """Patterns that occur, any case: the text is folded once, so that plain literals are searched."""
    found = lambda t: sum((t.rlike(p).cast("int") for p in BOILERPLATE[1:]), t.rlike(BOILERPLATE[0]).cast("int"))
    return T.let(F.lower(F.translate(c, "ſıİ", "sii")), found).cast("long")


def metrics(c: Column) -> dict[str, Column]:
    return {
        "n_chars": T.chars(c),
        "url_ratio": url_ratio(c),
        "digit_ratio": T.digit_chars(c) / F.greatest(F.length(c), F.lit(1)),
        "symbol_ratio": share_of(c, T.SYMBOL),
        "n_words": F.size(T.words(c)).cast("long"),
        "alpha_ratio": share_of(c, r"\p{L}"),
        "duplicate_lines": repeated_share(lines(c)),
        "repeated_5grams": repeated_share(ngrams(T.words(c), 5)),
        "boilerplate": boilerplate_matches(c),
    }


def quality_rejection(c: Column, rules: StreamRules = StreamRules()) -> Column:
    """The first failing rule, null if none fails. Cheap rules come first; later ones aren't evaluated then.

    The text is bound once: otherwise a filter by this would repeat the cleaning that made it in every rule.
    """
    return T.let(c, lambda t: _first_failing(t, rules))


def _first_failing(c: Column, rules: StreamRules) -> Column:
    m = metrics(c)
    failed = F.when(m["n_chars"] < rules.min_chars, "too_short").when(m["n_chars"] > rules.max_chars, "too_long")
    for name, most in (("url_ratio", rules.max_urls), ("digit_ratio", rules.max_digits), ("symbol_ratio", rules.max_symbols)):
        failed = failed.when(m[name] > most, name)

    def of_words(w: Column) -> Column:
        late = F.when(F.size(w) < rules.min_words, "too_few_words").when(m["alpha_ratio"] < rules.min_letters, "alpha_ratio").when(m["duplicate_lines"] > rules.max_repeated_lines, "duplicate_lines")
        return late.when(repeats_ngrams(w, 5, rules.max_repeated_ngrams), "repeated_5grams").when(m["boilerplate"] > rules.max_boilerplate, "boilerplate")

    # the words are found once, and only if no rule before needs none
    return failed.otherwise(F.when(c.isNotNull(), T.let(T.words(c), of_words)))


def metadata_rejection(language: Column, script: Column, language_score: Column, quality_score: Column, cluster: Column, rules: MetadataRules = MetadataRules()) -> Column:
    """The first failing metadata rule; a missing value fails its rule."""
    return (
        F.when(~language.eqNullSafe(rules.language), "metadata_language")
        .when(~script.eqNullSafe(rules.script), "metadata_script")
        .when(language_score.isNull() | (language_score < rules.min_language_score), "metadata_language_score")
        .when(quality_score.isNull() | (quality_score < rules.min_quality_score), "metadata_quality_score")
        .when(cluster.isNull() | (cluster > rules.max_cluster), "metadata_cluster_size")
    )
