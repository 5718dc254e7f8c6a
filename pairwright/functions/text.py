"""Column builders for text, fragment lists and JSON. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ``strip`` removes: what Python counts as such, of the Basic Latin to General Punctuation blocks.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def str_or_empty(c: Column, nan_words: bool = False) -> Column:
    """Missing text as '', stripped; with ``nan_words`` the text nan in any case is missing too."""
    s = strip(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(F.lower(s) == "nan", F.lit("")).otherwise(s) if nan_words else s


def alias_coalesce(first: Column, second: Column) -> Column:
    """``first`` unless blank, else ``second``, else ''."""
    return F.coalesce(F.nullif(str_or_empty(first), F.lit("")), str_or_empty(second))


def fragment_tokens(c: Column) -> Column:
    """Non-blank, stripped parts between dots; duplicates stay."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.]"), strip), lambda x: x != "")


def fragment_set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(fragment_tokens(c)))


def fragment_count(c: Column) -> Column:
    return F.size(fragment_tokens(c))


def scoring_tokens(c: Column) -> Column:
    """Parts between dots once the text is stripped and all spaces are gone; duplicates stay."""
    return F.filter(F.split(F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit("")), "[.]"), lambda x: x != "")


def fragment_diff(a: Column, b: Column) -> dict[str, Column]:
    """Common and exclusive fragments of two fragment sets, their counts, and whether they differ."""
    common, only_a, only_b = F.array_sort(F.array_intersect(a, b)), F.array_sort(F.array_except(a, b)), F.array_sort(F.array_except(b, a))
    return {"common": common, "only_a": only_a, "only_b": only_b, "n_common": F.size(common), "n_only_a": F.size(only_a), "n_only_b": F.size(only_b), "has_diff": (F.size(only_a) > 0) | (F.size(only_b) > 0)}


def diff_json(only_a: Column, only_b: Column, reason_a: str = "only_toxic", reason_b: str = "only_nontoxic") -> Column:
    """JSON list of {fragment, reason}, the first side before the second, each side sorted."""
    item = lambda reason: lambda x: F.struct(x.alias("fragment"), F.lit(reason).alias("reason"))
    return F.to_json(F.concat(F.transform(F.array_sort(only_a), item(reason_a)), F.transform(F.array_sort(only_b), item(reason_b))))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer (1 at least)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def edit_similar(a: Column, b: Column) -> Column:
    """Similarity of 0.9 or more, in whole numbers: ten times the distance is within the longer length. Stops early beyond it."""
    name = F.greatest(F.length(a), F.length(b))
    near = F.abs(F.length(a) - F.length(b)) * 10 <= name
    return near & (F.call_function("levenshtein", a, b, F.floor(name / 10).cast("int")) >= 0)


def multiset_equal(a: Column, b: Column) -> Column:
    return F.array_sort(a) == F.array_sort(b)


def set_scores(gold: Column, pred: Column) -> dict[str, Column]:
    """Precision, recall and F1 of two token lists taken as sets. Both empty: all 1; no gold: 0, 1, 0; no prediction: all 0."""
    g, p = F.array_distinct(gold), F.array_distinct(pred)
    ng, np_, both = F.size(g), F.size(p), F.size(F.array_intersect(g, p)).cast("double")
    none = (ng == 0) & (np_ == 0)
    precision = F.when(none, 1.0).when((ng == 0) | (np_ == 0), 0.0).otherwise(both / np_)
    recall = F.when(ng == 0, 1.0).when(np_ == 0, 0.0).otherwise(both / ng)
    f1 = F.when(none, 1.0).when((ng == 0) | (np_ == 0) | (both == 0), 0.0).otherwise(2 * both / (ng + np_))
    return {"precision": precision, "recall": recall, "f1": f1}


def char_ngrams(c: Column, n: int) -> Column:
    s = F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    chars = F.split(s, "")
    out = chars
    for k in range(1, n):  # neighbours are joined array by array: a substring would count its way from the start for each gram
        out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.greatest(F.length(s), F.lit(1))), lambda a, b: F.concat(a, b))
    return F.when(F.length(s) < n, F.array().cast("array<string>")).otherwise(F.slice(out, F.lit(1), F.length(s) - n + 1))


def unigram_precision(gold: Column, pred: Column) -> Column:
    """Clipped character precision: each distinct character of ``pred`` counts as often as ``gold`` has it too. 0 where a side is empty."""
    clean = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    g, p = clean(gold), clean(pred)
    times = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    chars = F.array_distinct(char_ngrams(pred, 1))
    shared = F.aggregate(chars, F.lit(0), lambda n, c: n + F.least(times(g, c), times(p, c)))
    return F.when((F.length(g) == 0) | (F.length(p) == 0), 0.0).otherwise(shared / F.length(p))


def fragment_edit_mean(gold: Column, pred: Column) -> Column:
    """Mean over predicted fragments of the distance to the nearest gold fragment; without tokens on a side, the distance of the whole texts."""
    g, p = scoring_tokens(gold), scoring_tokens(pred)
    total = F.aggregate(F.transform(p, lambda x: F.array_min(F.transform(g, lambda y: F.levenshtein(x, y)))), F.lit(0), lambda a, x: a + x)
    whole = F.levenshtein(strip(F.coalesce(gold, F.lit(""))), strip(F.coalesce(pred, F.lit("")))).cast("double")
    return F.when((F.size(g) == 0) | (F.size(p) == 0), whole).otherwise(total / F.size(p))


def lenient_json(c: Column, schema: str) -> Column:
    """Struct parsed from the whole text, or else from its first '{' to its last '}'; null where neither parses."""
    s = strip(F.coalesce(c, F.lit("")))
    found = F.regexp_extract(s, r"(?s)[{].*[}]", 0)
    ok = lambda x: F.try_parse_json(x).isNotNull() & x.startswith("{")
    return F.when(ok(s), F.from_json(s, schema)).when(ok(found), F.from_json(found, schema))


def extract_answer(c: Column) -> Column:
    """The ``answer`` of a JSON object, stripped; any other text as it is, stripped."""
    s = F.coalesce(c, F.lit(""))
    return strip(F.coalesce(lenient_json(s, "answer string")["answer"], s))


#: Characters that a quoted text shows by their number: controls, unassigned ones and all separators but the space.
_HIDDEN = r"[\p{C}\p{Z}&&[^ ]]"


def _escaped(c: Column) -> Column:
    """One hidden character as Python escapes it."""
    code = F.ascii(c)
    digits = lambda n: F.lpad(F.lower(F.hex(code)), n, "0")
    short = F.when(c == "\n", "\\n").when(c == "\r", "\\r").when(c == "\t", "\\t")
    return short.when(code < 0x100, F.concat(F.lit("\\x"), digits(2))).when(code < 0x10000, F.concat(F.lit("\\u"), digits(4))).otherwise(F.concat(F.lit("\\U"), digits(8)))


def python_repr(c: Column) -> Column:
    """Quoted as Python quotes a text: single quotes, double ones if it holds only single ones; hidden characters by their number.

    Line ends, by far the commonest, are replaced at once; only texts with other hidden characters are taken apart.
    """
    s = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    s = F.when(s.rlike(_HIDDEN), F.array_join(F.transform(F.split(s, ""), lambda x: F.when(x.rlike(_HIDDEN), _escaped(x)).otherwise(x)), "")).otherwise(s)
    double = c.contains("'") & ~c.contains('"')
    return F.when(double, F.concat(F.lit('"'), s, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(s, F.lit("'"), F.lit("\\'")), F.lit("'")))


def exact_match(a: Column, b: Column) -> Column:
    return (strip(F.coalesce(a, F.lit(""))) == strip(F.coalesce(b, F.lit("")))).cast("int")


def ring_digits(c: Column) -> Column:
    """Ring labels of a SMILES-like text outside brackets: two digits after a percent sign, or single digits."""
    bare = F.regexp_replace(F.coalesce(c, F.lit("")), r"\[[^\]]*\]", "")
    two = F.transform(F.regexp_extract_all(bare, F.lit(r"%(\d{2})"), F.lit(1)), lambda x: x.cast("int"))
    one = F.transform(F.regexp_extract_all(F.regexp_replace(bare, r"%\d{2}", ""), F.lit(r"(\d)"), F.lit(1)), lambda x: x.cast("int"))
    return F.concat(two, one)


def unpaired_rings(c: Column) -> Column:
    """Ring labels that stand an odd number of times, sorted."""
    d = ring_digits(c)
    return F.array_sort(F.filter(F.array_distinct(d), lambda x: F.size(F.filter(d, lambda y: y == x)) % 2 == 1))


def set_tanimoto_at_least(a: Column, b: Column, tenths: int = 9) -> Column:
    """Tanimoto of two sets at ``tenths`` / 10 or above, in whole numbers; false where a side is missing or both are empty."""
    c = F.size(F.array_intersect(a, b))
    u = F.size(a) + F.size(b) - c
    return F.coalesce((u > 0) & (10 * c >= tenths * u), F.lit(False))


def bitmap_counts(a: Column, b: Column) -> tuple[Column, Column]:
    """Common and united bits of two arrays of words."""
    bits = lambda x: F.aggregate(x, F.lit(0), lambda n, w: n + F.bit_count(w))
    return bits(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y))), bits(F.zip_with(a, b, lambda x, y: x.bitwiseOR(y)))


def bitmap_tanimoto(a: Column, b: Column) -> Column:
    c, u = bitmap_counts(a, b)
    return F.when(u > 0, c / u)


def score_from_distance(x: Column, kind: str = "exponential") -> Column:
    """A distance as a score from 0 to 1: e**-x, max(0, 1 - x) or 1 / (1 + x)."""
    forms = {"exponential": F.exp(-x), "linear": F.greatest(F.lit(0.0), 1 - x), "reciprocal": 1 / (1 + x)}
    if kind not in forms:
        raise ValueError(f"unknown kind {kind!r}; one of {sorted(forms)}")
    return forms[kind]


def prs(a: Column, b: Column, kind: str = "exponential") -> Column:
    """Property-retention score of two property values; 0 where either is missing or not finite."""
    ok = finite(a).isNotNull() & finite(b).isNotNull()
    return F.coalesce(F.when(ok, score_from_distance(F.abs(a - b), kind)), F.lit(0.0))


def finite(c: Column) -> Column:
    """The number, or null where it is missing, NaN or infinite."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)
