"""Text functions over columns. Null in, null out, unless a function says otherwise."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

#: Grammatical words that the ranking ignores.
STOPWORDS = tuple(
    "a an and are as at be been being by for from had has have if in into is it its of on or than that the their then "
    "there these this those to was were which while with within".split()
)
#: Fixed value: a ranking token is a run of letters and digits, joined by single dots, slashes or hyphens.
TOKEN = r"[a-z0-9]+(?:[./\-][a-z0-9]+)*"
#: Cells that stand for a missing value.
MISSING_WORDS = ("n/a", "na", "-", "--", "null", "none", "nil", "#n/a")


def normalise_label(c: Column) -> Column:
    """Case folded (by lower), white space collapsed: how labels are compared."""
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def normalise_words(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", " "))


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def fold_name(c: Column) -> Column:
    """Letters and digits only, lower case."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]", "")


def fold_unit(c: Column) -> Column:
    """A unit without case, blanks and the two signs for micro."""
    return F.regexp_replace(F.translate(F.lower(F.trim(c)), "µμ", "uu"), r"\s+", "")


def humanise(c: Column) -> Column:
    """snake_case as a sentence: blanks for underscores, first letter upper."""
    words = F.regexp_replace(F.trim(c), r"[_\s]+", " ")
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1 << 30))


def rank_tokens(c: Column) -> Column:
    """Tokens that ranking counts: lower case, without stop words, in order."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0)), lambda t: ~t.isin(*STOPWORDS))


def name_tokens(c: Column) -> Column:
    """Distinct letter-digit runs of an identifier, lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda t: t != ""))


def mentions(haystack: Column, token: str) -> Column:
    """Whether a token stands in the text with no letter or digit at either side."""
    import re

    return haystack.rlike(r"(?i)(?<![A-Za-z0-9])" + re.escape(token) + r"(?![A-Za-z0-9])")


def null_if_missing_word(c: Column) -> Column:
    """Null for the words that spreadsheets write for nothing."""
    return F.when(F.lower(F.trim(c)).isin(*MISSING_WORDS), None).otherwise(c)


def clean_cell(c: Column) -> Column:
    """A cell as text: a whole number without its point, null as an empty text, trimmed."""
    t = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(t.rlike(r"^[+-]?\d+\.0+$"), F.regexp_replace(t, r"\.0+$", "")).otherwise(t)


def content_sha256(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def estimate_tokens(c: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4).cast("int"))


def in_id_range(table_id: Column, prefix: str) -> Column:
    """14.1 covers 14.1 and 14.1.x, not 14.10."""
    t = F.trim(table_id)
    return F.coalesce((t == prefix) | t.startswith(prefix + "."), F.lit(False))


def section_key(c: Column) -> Column:
    """Sort key of dotted section numbers: 2.10 after 2.9."""
    return F.transform(F.filter(F.split(c, r"\."), lambda p: p.rlike(r"^\d+$")), lambda p: p.cast("int"))


def looks_like_heading(c: Column) -> Column:
    """Numbered, all capitals, or capitalised words; 80 characters at most and no full stop at the end."""
    t = F.trim(c)
    shape = t.rlike(r"^\d+(\.\d+)*\.?\s+\S") | t.rlike(r"^[^a-z]*[A-Z][^a-z]*$") | t.rlike(r"^([A-Z][\w'-]*)(\s+([A-Z][\w'-]*|of|and|the|in|for|to|on|with|a|an))*$")
    return (F.length(t) > 0) & (F.length(t) <= 80) & ~t.endswith(".") & shape


def safe_filename(c: Column, fallback: str = "document") -> Column:
    t = F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]', " "), r"\s+", " "))
    return F.when(F.coalesce(t, F.lit("")) == "", F.lit(fallback)).otherwise(t)


def document_filename(kind: Column, created: Column, ident: Column, language: Column, ext: str) -> Column:
    """type - date - first eight of the id - language.ext"""
    return F.concat(F.concat_ws(" - ", safe_filename(kind), F.date_format(created, "yyyy-MM-dd"), F.substring(ident, 1, 8), language), F.lit("." + ext))


def capped_names(names: Column, limit: int = 6) -> Column:
    """The first names, and how many more there are."""
    more = F.size(names) - limit
    return F.when(more > 0, F.concat(F.array_join(F.slice(names, 1, limit), ", "), F.lit(" and "), more.cast("string"), F.lit(" more"))).otherwise(F.array_join(names, ", "))


def canonical_model(c: Column) -> Column:
    """A model's name without vendor prefix and date suffix: a last part of eight digits, or last parts of four, two and two."""
    parts = F.split(F.element_at(F.split(F.lower(F.trim(c)), "/"), -1), "-")
    sizes = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), F.length(p).cast("string")).otherwise("x")), ",")
    dated = F.when(sizes.rlike(",4,2,2$"), 3).when(sizes.rlike(",8$"), 1).otherwise(0)
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - dated), "-")


def doubled_words(c: Column) -> Column:
    """Words that stand twice in a row, lower case."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?i)\b(\w+)\s+\1\b"), F.lit(1)), F.lower)


def doubled_units(c: Column) -> Column:
    """Units and currency signs that stand twice in a row."""
    return F.regexp_extract_all(c, F.lit(r"(?i)(%\s*%|\$\s*\$|€\s*€|£\s*£|\b(mg|kg|g|ml|l|usd|eur|gbp)\s+\2\b)"), F.lit(1))


def placeholder_residue(c: Column) -> Column:
    """Square-bracket, merge-field and control tokens that were not filled."""
    return F.regexp_extract_all(c, F.lit(r"(\[[A-Z][^\]\[]{0,60}\]|«[^»]{1,60}»|\{\{[^}]{1,60}\}\}|<<[^>]{1,60}>>)"), F.lit(1))


def fill_masks(c: Column) -> Column:
    """Masks of dates to be filled in: xx/xx/xxxx and the year-month-day form."""
    return F.regexp_extract_all(c, F.lit(r"(?i)(x{2,4}年x{1,2}月x{1,2}日|\bxx/xx/xxxx\b|\bxx-xx-xxxx\b)"), F.lit(1))


def instruction_lines(c: Column) -> Column:
    """Lines that tell an author what to do."""
    return F.filter(F.split(c, r"\n"), lambda x: x.rlike(r"(?i)^\s*(note to (author|writer|drafter)|instruction[s]?\s*:|delete (this|if)|insert |select one|to be (completed|filled))"))


def citations(c: Column) -> Column:
    """[S1, p.4] markers: struct of marker and page."""
    found = F.regexp_extract_all(c, F.lit(r"\[(S\d+(?:,\s*p\.\s*\d+)?)\]"), F.lit(1))
    return F.transform(found, lambda m: F.struct(F.regexp_extract(m, r"^(S\d+)", 1).alias("marker"), F.when(m.contains("p."), F.regexp_extract(m, r"p\.\s*(\d+)", 1).try_cast("int")).alias("page")))


def data_needed(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[DATA NEEDED:\s*([^\]]*)\]"), F.lit(1)), lambda x: F.trim(x))


def table_markers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[TABLE:\s*([^\]]*)\]"), F.lit(1)), lambda x: F.trim(x))


def field_value(text: Column, field: str) -> Column:
    """Value of `field: value;` in a record chunk."""
    import re

    found = F.regexp_extract(text, r"(?i)(?:^|;\s*)" + re.escape(field) + r"\s*:\s*([^;\n]*)", 1)
    return F.when(found != "", F.trim(found))


def chunk_fields(text: Column) -> Column:
    """Names before the colons of `k: v; k: v`."""
    return F.array_distinct(F.filter(F.transform(F.filter(F.split(text, ";"), lambda p: p.contains(":")), lambda p: F.trim(F.split(p, ":")[0])), lambda p: p != ""))


def record_text(columns: list[str]) -> Column:
    """`k: v; k: v` of a record, empty values left out."""
    cell = {c: F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in columns}
    parts = [F.when(v != "", F.concat(F.lit(f"{c}: "), v)) for c, v in cell.items()]
    return F.concat_ws("; ", *parts)


def split_cell(c: Column) -> Column:
    """Parts of a list cell, parted by ; , | or /."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,|/]"), lambda x: F.trim(x)), lambda x: x != "")


def numbers_in(c: Column) -> Column:
    """Numbers of a text without grouping commas and trailing zeros."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?<![\w.])(\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:\.\d+)?)(?![\w])"), F.lit(1)), normalise_number)


def normalise_number(c: Column) -> Column:
    t = F.regexp_replace(c, ",", "")
    return F.when(t.contains("."), F.regexp_replace(F.regexp_replace(t, r"0+$", ""), r"\.$", "")).otherwise(t)


def sentences(c: Column) -> Column:
    """Sentences, kept whole over abbreviations, page marks and decimals."""
    return F.filter(F.transform(F.split(c, r"(?<!\b(?:e\.g|i\.e|etc|vs|Dr|Mr|Ms|No|Fig|cf|al|approx|p|pp)\.)(?<=[.!?])\s+(?=[A-Z\[(\"'])"), lambda x: F.trim(x)), lambda s: s != "")


def width_estimate(c: Column, font_half_points: int = 22) -> Column:
    """Width in twentieths of a point: wide characters count a full em, others about half."""
    em = font_half_points * 10
    return F.aggregate(F.split(c, ""), F.lit(0.0), lambda a, x: a + F.when(x == "", 0.0).when(F.ascii(x) > 0x2E7F, 1.0 * em).otherwise(0.5 * em))


@F.pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function does."""
    return s.str.normalize("NFKC")


@F.pandas_udf(DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 for equal texts; for a prefix the share of its length, 0.75 at least from eight characters on; else difflib's ratio."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> float:
        if not x or not y:
            return 0.0
        low, high = sorted((len(x), len(y)))
        if x.startswith(y) or y.startswith(x):
            return max(0.75, low / high) if low >= 8 else low / high
        return SequenceMatcher(None, x, y).ratio()

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(ArrayType(StructType([StructField("op", StringType()), StructField("text", StringType())])))
def word_diff(old: pd.Series, new: pd.Series) -> pd.Series:
    """Runs of words that are equal, deleted or inserted."""
    from difflib import SequenceMatcher

    def one(x: str | None, y: str | None) -> list[dict]:
        a, b = (x or "").split(), (y or "").split()
        out = []
        for tag, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
            if tag == "equal":
                out.append({"op": "equal", "text": " ".join(a[i:j])})
                continue
            if j > i:
                out.append({"op": "delete", "text": " ".join(a[i:j])})
            if m > k:
                out.append({"op": "insert", "text": " ".join(b[k:m])})
        return out

    return pd.Series([one(x, y) for x, y in zip(old, new, strict=True)])


@F.pandas_udf(StringType())
def korean_particles(s: pd.Series) -> pd.Series:
    """Chooses between paired postpositions, written as 을(를), by the final consonant of the syllable before."""
    import re

    #: Forms after a final consonant and after a vowel.
    pairs = {"을(를)": ("을", "를"), "은(는)": ("은", "는"), "이(가)": ("이", "가"), "과(와)": ("과", "와"), "으로(로)": ("으로", "로")}
    shape = re.compile("(.)(" + "|".join(map(re.escape, pairs)) + ")")

    def pick(m: re.Match) -> str:
        code = ord(m[1]) - 0xAC00
        if not 0 <= code < 11172:
            return m[0]
        final = code % 28
        return m[1] + pairs[m[2]][0 if final and not (m[2] == "으로(로)" and final == 8) else 1]

    return s.map(lambda t: shape.sub(pick, t) if isinstance(t, str) else t)


def shared_terms(a: Column, b: Column) -> Column:
    """Terms of both lists, whatever their case, in the order of the first."""
    fold = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), normalise_label)
    return F.array_intersect(fold(a), fold(b))


def lacking_terms(wanted: Column, have: Column) -> Column:
    """Terms of the first list that the second lacks, whatever their case."""
    fold = lambda x: F.transform(F.coalesce(x, F.array().cast("array<string>")), normalise_label)
    return F.array_except(fold(wanted), fold(have))


def in_order(values: Column) -> Column:
    """Different values in the order of their first occurrence, blanks left out."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")))


def json_list(c: Column) -> Column:
    """Members of a JSON list as texts, none for null and for what is no list."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
