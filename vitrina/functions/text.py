"""Text expressions: cleaning, folding, keys, slugs and phone numbers."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, functions as F

# White space as Python's str methods see it: the Unicode property plus the
# four ASCII separators that Java leaves out.
_SPACE = r"(?U)[\s\x1c-\x1f]"

# Letters whose ASCII spelling is not a plain base letter.
_SPELLED = {
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th",
    "ĳ": "ij", "Ĳ": "IJ", "€": "EUR", "™": "tm", "©": "(c)", "®": "(r)", "№": "No",
    "ŋ": "ng", "Ŋ": "NG",
}
# Letters and marks without a Unicode decomposition.
_SINGLE = {
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D",
    "ħ": "h", "Ħ": "H", "ı": "i", "ŧ": "t", "Ŧ": "T",
    "ª": "a", "º": "o", "¹": "1", "²": "2", "³": "3",
    "‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "•": "*",
}


def _base_letters() -> dict[str, str]:
    """Latin letters that decompose into one ASCII letter and accents."""
    table = {}
    for point in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base.isascii() and base != chr(point):
            table[chr(point)] = base
    return table


_BASE = _base_letters()

# ASCII spellings of Greek and Cyrillic letters.
_SCRIPTS = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i",
    "κ": "k", "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "σ": "s",
    "ς": "s", "τ": "t", "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "io", "ж": "zh", "з": "z",
    "и": "i", "й": "i", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r",
    "с": "s", "т": "t", "у": "u", "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh",
    "щ": "shch", "ъ": '"', "ы": "y", "ь": "'", "э": "e", "ю": "iu", "я": "ia",
}


def _script_letters() -> dict[str, str]:
    """The letters above, their capitals, and both with accents."""
    table = dict(_SCRIPTS)
    for point in [*range(0x0386, 0x0460), *range(0x1F00, 0x2000)]:
        letter = chr(point)
        base = unicodedata.normalize("NFD", letter)[0].lower()
        own = _SCRIPTS.get(letter.lower(), _SCRIPTS.get(base))
        if own is not None:
            table[letter] = own.capitalize() if letter != letter.lower() else own
    return table


_LETTERS = _script_letters()
_LONG_LETTERS = {k: v for k, v in _LETTERS.items() if len(v) > 1}
_SHORT_LETTERS = {k: v for k, v in _LETTERS.items() if len(v) == 1}


def text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, however often it is used.

    Without it an expression is computed anew wherever it is named, and inside
    an array function once for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(value: str) -> str:
    """Pattern that matches exactly this text."""
    return "".join(ch if ch.isalnum() or ch == " " else "\\" + ch for ch in value)


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_text(c: Column) -> Column:
    """Drop private-use code points, collapse white space, trim."""
    shown = F.regexp_replace(text(c), "[\\uE000-\\uF8FF]", "")
    return F.trim(F.regexp_replace(shown, _SPACE + "+", " "))


def clean_rating(c: Column) -> Column:
    """One decimal without trailing zeros; anything that is no number gives ''."""
    def shown(number: Column) -> Column:
        one = F.format_string("%.1f", _one_decimal(number))
        return F.when(number.isNull(), "").otherwise(F.regexp_replace(one, r"\.0\z", ""))

    def rating(dotted: Column) -> Column:
        plain = dotted.rlike(r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
        return let(F.when(plain, dotted.try_cast("double")), shown)

    # The number is named many times; without ``let`` its text would be cleaned as often.
    return let(F.replace(clean_text(c), F.lit(","), F.lit(".")), rating)


def _one_decimal(x: Column) -> Column:
    """The nearest number of one decimal to the exact binary value; ties go to the even digit.

    The fraction of a double is a whole number of 2 ** -52 steps (from 1 on), so twenty
    times it fits a long and is compared with the midpoints exactly.
    """
    size = F.abs(x)
    whole = F.floor(size)
    scaled = ((size - whole) * F.lit(float(1 << 52))).cast("long") * 20
    tenths = F.shiftright(scaled, 53)
    rest, half = scaled.bitwiseAND(F.lit((1 << 53) - 1)), F.lit(1 << 52)
    up = (rest > half) | ((rest == half) & (tenths % 2 == 1))
    rounded = (whole * 10 + tenths + up.cast("long")) / 10 * F.signum(x)
    return F.when(size < 1e15, rounded).otherwise(x)


def with_scheme(web: Column) -> Column:
    has_scheme = web.startswith("http://") | web.startswith("https://")
    return F.when((web != "") & ~has_scheme, F.concat(F.lit("https://"), web)).otherwise(web)


def fold(c: Column) -> Column:
    """ASCII spelling of Latin, Greek and Cyrillic text; letters of other scripts are dropped."""
    table = _BASE | _SINGLE | _SHORT_LETTERS
    spelled = text(c)
    other = spelled
    for letter, ascii_form in _LONG_LETTERS.items():
        other = F.replace(other, F.lit(letter), F.lit(ascii_form))
    spelled = F.when(spelled.rlike("[\\u0370-\\u045f\\u1f00-\\u1fff]"), other).otherwise(spelled)
    for letter, ascii_form in _SPELLED.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(ascii_form))
    mapped = F.translate(spelled, "".join(table), "".join(table.values()))
    # Other signs of the basic plane part words; letters and emoji vanish.
    parted = F.regexp_replace(mapped, r"[\u0080-\uFFFF&&[^\p{L}\p{M}\p{Cs}]]", " ")
    plain = F.regexp_replace(parted, r"[^\x00-\x7f]+", "")
    return F.when(text(c).rlike(r"[^\x00-\x7f]"), plain).otherwise(text(c))


def strip_accents(c: Column) -> Column:
    """Base letters only: other non-ASCII characters are dropped, not spelled."""
    mapped = F.translate(text(c), "".join(_BASE), "".join(_BASE.values()))
    return F.regexp_replace(mapped, r"[^\x00-\x7f]+", "")


def slug(c: Column, length: int = 40) -> Column:
    """Lower-case ASCII words joined by '_', cut to a length."""
    runs = F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]+", "_")
    return F.substring(F.regexp_replace(runs, r"\A_+|_+\z", ""), 1, length)


def business_slug(c: Column) -> Column:
    letters = F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", "")
    return let(letters, lambda s: F.when(s == "", "negocio").otherwise(s))


# Fixed value: punctuation that parts the words of a brand.
_BRAND_SIGNS = "-_,.|/&"
_SPACES = "".join(chr(c) for c in range(0x10000) if chr(c).isspace())
_DIGITS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd")


def brand_words(c: Column) -> Column:
    """Lower-case words of a name without bracketed parts and digits."""
    bracketed = F.regexp_replace(c, r"\([^)]*\)", "")
    open_text = F.lower(text(F.when(c.contains("("), bracketed).otherwise(c)))
    # Signs and spaces become ' '; the digits have no counterpart and vanish.
    gaps = _BRAND_SIGNS + _SPACES
    plain = F.translate(open_text, gaps + _DIGITS, " " * len(gaps))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def brand_norm(c: Column) -> Column:
    """Name without bracketed parts, digits and punctuation."""
    return F.array_join(brand_words(c), " ")


def brand_key(name: Column, town: Column) -> Column:
    """Normalised name without the words of the town, unless nothing is left."""

    def shorten(v: Column) -> Column:
        kept = F.filter(v["name"], lambda w: ~F.array_contains(v["town"], w))
        return F.array_join(F.when(F.size(kept) > 0, kept).otherwise(v["name"]), " ")

    return let(F.struct(brand_words(name).alias("name"), brand_words(town).alias("town")), shorten)


def words(c: Column) -> Column:
    """Lower-case ASCII words of a text."""
    return F.filter(F.split(word_text(c), " +"), lambda w: w != "")


def word_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(fold(c)), "[^a-z0-9 ]+", " ")


# Fixed value: the phone pattern.
PHONE = r"\+?\d[\d\s().-]{7,}\d"


def phone_in(c: Column) -> Column:
    """First phone-like run anywhere in a text, cleaned; '' when there is none."""
    return clean_text(F.regexp_extract(text(c), f"(?U)({PHONE})", 1))


def phone_like(c: Column) -> Column:
    """First phone-like run after the first ':' (whole text without one)."""
    whole = text(c)
    return phone_in(clean_text(F.regexp_replace(whole, r"(?s)\A[^:]*:", "")))


def city_label(name: Column, province: Column, country: str = "España") -> Column:
    return F.concat_ws(", ", name, province, F.lit(country))


def search_text(category: Column, place: Column) -> Column:
    return F.concat_ws(" en ", category, place)
