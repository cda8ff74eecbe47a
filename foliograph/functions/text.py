r"""Text functions as Columns. White space is Unicode's unless a name says otherwise; ``\w`` and ``\d`` are
spelled out, since engines differ on them. Word lists that name things of a trade are parameters."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Code-point ranges of the scripts told apart.
KANA, HAN, HANGUL = r"぀-ヿ", r"㐀-鿿", r"가-힯"
CJK = KANA + HAN + HANGUL
#: Suffixes of company names in charts and in residual texts, standards bodies, material metrics and words beside them,
#: chemical symbols, and words of measured units.
CHART_SUFFIXES = ("co", "corp", "corporation", "inc", "ltd", "limited", "llc", "plc", "gmbh")
COMPANY_SUFFIXES = ("co", "company", "corp", "corporation", "inc", "incorporated", "ltd", "limited", "llc", "plc", "gmbh")
STANDARDS = ("ASTM", "IEC", "IPC", "ISO", "JIS", "UL")
METRICS = ("CTE", "Df", "Dk", "HAST", "MIT", "RTI", "Td", "Tg")
METRIC_WORDS = ("C", "F", "RH", "T", "g", "ppm")
MATERIALS = ("PI", "FCCL", "FPC", "LCP")
CHEMICALS = ("Ag", "Al", "Au", "Cu", "Fe", "Ni", "Pb", "Si", "Sn", "Zn")
UNITS = ("a", "b", "c", "f", "g", "ghz", "hz", "in", "k", "khz", "lb", "mhz", "mil", "mm", "n", "nm", "um")

#: Unicode's white space.
BLANKS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

#: Unicode's line ends.
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Folds A to Z only."""
    return F.translate(text, _UPPER, _LOWER)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def newline_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def lines_of(text: Column) -> Column:
    """Split at every line end that Unicode knows."""
    return F.split(text, f"\r\n|[{LINE_ENDS}]")


def normalize_source(text: Column) -> Column:
    """Spaces and tabs single, lines trimmed, blank lines gone."""
    lines = F.transform(lines_of(text), lambda x: strip(F.regexp_replace(x, r"[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def normalize_cell(text: Column) -> Column:
    lines = F.transform(lines_of(text), lambda x: collapse(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


@F.pandas_udf(StringType())
def decode_all_references(text: pd.Series) -> pd.Series:
    """Every named and numbered HTML reference."""
    import html

    return text.map(lambda x: None if x is None else html.unescape(x))


def decode_references(text: Column) -> Column:
    """Every named and numbered reference; only texts with an ampersand go to Python."""
    held = text.contains("&")
    return F.when(held, decode_all_references(F.when(held, text))).otherwise(text)


def strip_markup(text: Column) -> Column:
    return normalize_source(decode_references(F.regexp_replace(text, r"<[^>]+>", "\n")))


def normalize_translation(text: Column) -> Column:
    return normalize_source(strip_markup(text))


def join_lines(lines: Column) -> Column:
    """Visual lines as running text: bullets and sentence ends before a capital start a new line, ASCII
    neighbours get a space, others touch."""

    def add(text: Column, line: Column) -> Column:
        last, first = F.substring(text, -1, 1), F.substring(line, 1, 1)
        ascii_ = lambda c: c.rlike(r"^[\x00-\x7F]$")
        gap = (
            F.when(first.isin("•", "・", "-", "–"), F.lit("\n"))
            .when(last.rlike(r"[.!?。！？:;]") & first.rlike(r"\p{Lu}"), F.lit("\n"))
            .when(ascii_(last) & ascii_(first), F.lit(" "))
            .otherwise(F.lit(""))
        )
        return F.when(line == "", text).when(text == "", line).otherwise(F.concat(text, gap, line))

    return strip(F.aggregate(F.transform(lines, lambda x: normalize_source(x)), F.lit(""), add))


MODEL_TOKEN = r"(?<![A-Za-z0-9_])(?:[A-Za-z][A-Za-z0-9]*(?:[-_/][A-Za-z0-9]+)+|[A-Z]{2,}[A-Z0-9]*)(?![A-Za-z0-9_])"


def remove_model_tokens(text: Column) -> Column:
    """Compounds with hyphen, underscore or slash, and all-capital words, each to a space."""
    return F.regexp_replace(text, MODEL_TOKEN, " ")


def remove_terms(text: Column, terms: Column) -> Column:
    """Literal removal of each term of an array, in its order."""
    return F.aggregate(terms, text, lambda t, term: F.when(term == "", t).otherwise(F.replace(t, term, F.lit(""))))


def latin_words(text: Column) -> Column:
    """Lower-case runs of A to Z."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[A-Za-z]+"), F.lit(0)), lambda x: ascii_lower(x))


def number_tokens(text: Column) -> Column:
    """The multiset of numbers, as a sorted array: digits with separators and per cent, commas dropped."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?%?"), F.lit(0))
    return F.array_sort(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit(""))))


def safe_error(message: Column, kind: Column) -> Column:
    text = strip(F.coalesce(message, F.lit("")))
    return F.left(F.when(text == "", kind).otherwise(text), F.lit(500))


def json_body(reply: Column) -> Column:
    """A model's reply without code fences; what lies between the first and last brace if it isn't bare."""
    bare = strip(F.regexp_replace(strip(reply), r"^```(?:json)?\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    return F.when(bare.startswith("{") & bare.endswith("}"), bare).when(inner != "", inner).otherwise(bare)


def protected_terms(text: Column) -> Column:
    """Terms set apart by commas (either width) or line feeds."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,，\n]"), lambda x: strip(x)), lambda x: x != "")


def scripts(text: Column) -> Column:
    """Which of kana, hangul, han and latin occur, as a struct of flags."""
    has = lambda r: F.coalesce(text.rlike(f"[{r}]"), F.lit(False))
    return F.struct(has(KANA).alias("kana"), has(HANGUL).alias("hangul"), has(HAN).alias("han"), has("A-Za-z").alias("latin"))


def natural_language(text: Column) -> Column:
    return text.rlike(f"[A-Za-z{CJK}]")


def suffix_pattern(suffixes: Sequence[str]) -> str:
    return r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(suffixes) + r")(?![A-Za-z0-9_])"


def chart_proper_name(text: Column, generic_labels: Sequence[str], generic_phrases: Sequence[str], suffixes: Sequence[str] = CHART_SUFFIXES) -> Column:
    """Latin chart text that names a company or brand, and no generic label."""
    line = collapse(text)
    folded = F.btrim(ascii_lower(line), F.lit(" .,:;()[]"))
    generic = folded.isin(*generic_labels) if generic_labels else F.lit(False)
    for phrase in generic_phrases:
        generic = generic | folded.contains(phrase)
    named = line.rlike(suffix_pattern(suffixes)) | line.rlike(r"[A-Z]{3,}|(?:^|[\s(])[A-Z][a-zA-Z-]{2,}")
    return line.rlike("[A-Za-z]") & ~line.rlike(f"[{CJK}]") & ~generic & named


def lone_company_name(text: Column, generic_words: Sequence[str], suffixes: Sequence[str] = COMPANY_SUFFIXES) -> Column:
    """A residual that is a company name by its own form: a mark, or one capitalised word that isn't generic.
    Null where only other texts can tell (see ``operators.residuals``)."""
    latin = text.rlike(r"^[A-Za-z][A-Za-z .,&'®™/-]*$")
    word = text.rlike(r"^[A-Z][a-zA-Z]{2,}$")
    if generic_words:
        word = word & ~ascii_lower(text).isin(*generic_words)
    return F.when(text.rlike("[®™]"), True).when(~latin | text.rlike(suffix_pattern(suffixes)), False).when(word, True)


def model_or_standard(text: Column) -> Column:
    """A residual to keep as it is: abbreviation, model, standard, material metric, symbol or measure."""
    t = strip(text)
    metric = "|".join(METRICS)
    words = F.regexp_extract_all(t, F.lit("[A-Za-z]+"), F.lit(0))
    allowed = F.array(*map(F.lit, METRICS + METRIC_WORDS))
    units = F.array(*map(F.lit, UNITS))
    capitals = F.length(F.regexp_replace(t, r"\P{Lu}", ""))
    rules = [
        t.rlike(r"^[A-Z](?:[&/][A-Z])+$"),
        t.rlike(rf"^(?:Low|High)\s+(?:{metric})(?:\s+(?:{'|'.join(MATERIALS)}))?$"),
        t.rlike(r"^[A-Z][A-Z0-9]*(?:[-./][A-Z0-9]+)*$"),
        t.contains("-") & t.rlike(r"^[A-Za-z0-9][A-Za-z0-9 ./-]*$") & (capitals >= 2),
        t.rlike(rf"(?<![A-Za-z0-9_])(?:{'|'.join(STANDARDS)})(?![A-Za-z0-9_])") & ~t.rlike(r"[ぁ-ヿ㐀-鿿가-힯]"),
        t.rlike(rf"^\[?\s*(?:{metric})(?![A-Za-z0-9_])") & (F.size(F.array_except(words, allowed)) == 0),
        t.isin(*CHEMICALS),
        t.rlike(r"^[A-Za-z0-9µμΩ°%().,+\-/\s]+$") & t.rlike(r"[0-9]|%|°|/|µ|μ|Ω") & (F.size(words) > 0) & (F.size(F.array_except(latin_words(t), units)) == 0),
    ]
    found = rules[0]
    for r in rules[1:]:
        found = found | r
    return (F.length(t) >= 2) & found


def glossary_candidate(text: Column, occurrences: Column) -> Column:
    """Short, no sentence, and seen twice or marked by a capital or a digit."""
    line = collapse(text)
    sentence = line.rlike(r"[。！？]|\. |! |\? ")
    return F.length(line).between(2, 60) & ~sentence & ((occurrences >= 2) | line.rlike(r"\p{Lu}") | line.rlike(r"\p{Nd}"))


# ------------------------------------------------------------------------------------------ file names

#: Ending of a result's name by target language.
LANGUAGE_SUFFIXES = {"zh-CN": "cn", "en": "en", "ja": "ja", "ko": "ko", "de": "de", "fr": "fr"}


def clean_stem(name: Column) -> Column:
    """A file name's stem with nothing a file system minds. Width forms stay: see ``nfkc``."""
    t = F.btrim(strip(name), F.lit("`'\""))
    t = strip(F.regexp_replace(t, r"(?i)\.pdf$", ""))
    t = F.regexp_replace(t, r"""[<>:"/\\|?*\x00-\x1f]""", "_")
    return F.btrim(F.regexp_replace(t, r"(?U)\s+", " "), F.lit(" ."))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def utf8_cut(most: int):
    """A UDF: at most so many bytes, no code point cut, no blank or separator at the end."""

    @F.pandas_udf(StringType())
    def cut(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for text in parts:
            yield text.map(lambda x: x if x is None or len(x.encode()) <= most else x.encode()[:most].decode(errors="ignore").rstrip(" ._-"))

    return cut


def result_suffix(language: Column) -> Column:
    found = F.lit("localized")
    for code, suffix in LANGUAGE_SUFFIXES.items():
        found = F.when(language == code, F.lit(suffix)).otherwise(found)
    return found


def result_stem(stem: Column, language: Column) -> Column:
    """Without an ending that names the target language already; empty if nothing is left."""
    by = clean_stem(stem)
    out = by
    for code, suffix in [*LANGUAGE_SUFFIXES.items(), (None, "localized")]:
        cut = F.btrim(F.regexp_replace(by, rf"(?i)[\s_-]*(?:{suffix}|中文版|中文)$", ""), F.lit(" ._-"))
        out = F.when((language == code) if code else ~language.isin(*LANGUAGE_SUFFIXES), cut).otherwise(out)
    return out


def result_file_name(stem: Column, language: Column, cut=None) -> Column:
    """``<stem>_<language>.pdf``; null for an empty stem. ``cut``: see ``utf8_cut``; names are at most 255 bytes."""
    name = result_stem(stem, language)
    name = cut(name) if cut is not None else name
    return F.when(name != "", F.concat(name, F.lit("_"), result_suffix(language), F.lit(".pdf")))


def kept_name_tokens(original: Column, translated: Column, terms: Column | None = None) -> Column:
    """The translated stem, followed by the original's numbers, codes and protected terms that it lacks."""
    found = F.regexp_extract_all(original, F.lit(r"[0-9]+(?:[._-][0-9]+)*|[A-Za-z]+(?:[A-Za-z0-9._-]*[A-Za-z0-9])?"), F.lit(0))
    keep = F.filter(found, lambda t: t.rlike("[0-9]") | t.rlike("[-_.]") | (t.rlike("^[A-Z]{2,}$")))
    if terms is not None:
        keep = F.concat(keep, F.filter(terms, lambda t: F.contains(F.lower(original), F.lower(t))))
    missing = F.filter(keep, lambda t: ~F.contains(F.lower(translated), F.lower(t)))
    return F.when(F.size(missing) > 0, F.concat_ws(" ", translated, F.array_join(missing, " "))).otherwise(translated)


def name_in_language(stem: Column, language: Column, simplified: str) -> Column:
    """Whether a stem is in the target language already; ``simplified``: characters that mark simplified Chinese."""
    zh = stem.rlike(f"[{HAN}]") & ~stem.rlike(f"[{KANA}{HANGUL}]") & ~stem.rlike("[A-Za-z]{2,}") & stem.rlike(f"[{simplified}]")
    return (
        F.when(language == "zh-CN", zh)
        .when(language == "ja", stem.rlike(f"[{KANA}]"))
        .when(language == "ko", stem.rlike(f"[{HANGUL}]"))
        .when(language == "en", stem.rlike("[A-Za-z]{2,}") & ~stem.rlike(f"[{CJK}]"))
        .otherwise(False)
    )


def name_or_original(original: Column, translated: Column, language: Column) -> Column:
    """For Chinese, the original again if the translation lost all Han or brought in Latin words."""
    han = lambda c: F.regexp_count(c, F.lit(f"[{HAN}]"))
    latin = lambda c: c.rlike("[A-Za-z]{2,}")
    lost = (han(original) > 0) & (han(translated) == 0)
    brought = (han(original) >= 2) & ~latin(original) & latin(translated)
    return F.when((language == "zh-CN") & (lost | brought), original).otherwise(translated)


def instruction(policy: Column, glossary: Column, labels: dict[str, str]) -> Column:
    """An instruction of one line for each switch of the policy struct that is on, then the glossary pairs
    (an array of source and target). ``labels``: the line for each switch."""
    lines = [F.when(policy[k], F.lit(v)) for k, v in labels.items()]
    pairs = F.array_join(F.transform(glossary, lambda g: F.concat(g["source"], F.lit(" => "), g["target"])), "\n")
    terms = F.when(F.size(policy["protected_terms"]) > 0, F.concat(F.lit("keep: "), F.array_join(policy["protected_terms"], ", ")))
    head = F.concat(policy["source_language"], F.lit(" -> "), policy["target_language"])
    return F.concat_ws("\n", head, *lines, terms, F.nullif(pairs, F.lit("")))
