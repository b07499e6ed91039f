"""Text as column expressions: normal form, search terms, scripts, direction, cuts. All run inside the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixed

SCRIPTS = ("Latin", "Arabic", "Hebrew", "Cyrillic", "Greek", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")


def nfkc(df: DataFrame, column: str) -> DataFrame:
    """Compatibility normal form; Spark has no built-in. Rows in ASCII pass untouched inside the batch."""
    import unicodedata

    import pyarrow as pa

    names = df.columns

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            new = pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in b[column].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if c == column else b[c] for c in names], names)

    return df.mapInArrow(run, df.schema)


def _folded(c: Column) -> Column:
    """Lower case without format characters and Arabic marks, letters and digits folded."""
    x = F.regexp_replace(F.lower(c), r"[\p{Cf}\x{64B}-\x{65F}\x{670}\x{640}]+", "")
    return F.translate(x, fixed.FOLDED[0] + "'’‘ʼ", fixed.FOLDED[1])


def match_form(c: Column) -> Column:
    """Lower case without format characters and Arabic marks, letters and digits folded, punctuation to spaces, single spaces."""
    return F.trim(F.regexp_replace(_folded(c), r"[\p{P}\p{S}\s]+", " "))


def surface_words(c: Column) -> Column:
    """The words of the match form, cut where it has its spaces."""
    return F.array_remove(F.split(_folded(c), r"[\p{P}\p{S}\s]+"), "")


def light_stem(w: Column) -> Column:
    """An Arabic word without its leading particle and article, if three letters remain."""
    x = F.regexp_replace(w, r"^(?:[وف]?[بكل]?ال|[وف]?لل)", "")
    return F.when((F.length(x) >= 3) & (x != w), x).otherwise(w)


def search_terms(c: Column) -> Column:
    """Distinct words, then stems and pairs of neighbouring CJK characters not yet among them."""
    words = surface_words(c)
    cjk = F.filter(words, lambda w: w.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2}"))
    pairs = F.flatten(F.transform(cjk, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2)))))
    return F.array_distinct(F.concat(words, F.transform(words, light_stem), pairs))


def query_tokens(c: Column) -> Column:
    """Search terms without stopwords and single letters; words with digits stay and also give their parts; 40 at most."""
    stop = F.array(*[F.lit(w) for w in fixed.stopwords()])
    digit = lambda w: w.rlike("[0-9]")
    kept = F.filter(search_terms(c), lambda w: digit(w) | ((F.length(w) >= fixed.LEAST_CHARS) & ~F.array_contains(stop, w)))
    parts = lambda w: F.when(w.rlike(r"^(?:\p{L}+[0-9]+|[0-9]+\p{L}+)$"), F.array(w, F.regexp_extract(w, r"\p{L}+", 0), F.regexp_extract(w, "[0-9]+", 0))).otherwise(F.array(w))
    fine = F.filter(F.flatten(F.transform(kept, parts)), lambda w: digit(w) | (F.length(w) >= fixed.LEAST_CHARS))
    return F.slice(F.array_distinct(fine), 1, fixed.MOST_TOKENS)


def script_count(c: Column, script: str) -> Column:
    return F.regexp_count(c, F.lit(rf"\p{{Is{script}}}"))


def direction(c: Column) -> Column:
    """rtl if half of the letters or more are Arabic or Hebrew."""
    rtl = count_of(c, r"\p{IsArabic}\p{IsHebrew}&&\p{L}")
    letters = count_of(c, r"\p{L}")
    # Letters are counted only where a character may be of those scripts.
    return F.when(c.rlike(r"[^\x00-\x{58F}]") & (letters > 0) & (rtl * 2 >= letters), "rtl").otherwise("ltr")


def dominant_script(c: Column) -> Column:
    """The script with most letters, the first of equals; und without letters, or with fewer than 40 Latin ones."""
    best = F.array_max(F.array(*[F.struct(script_count(c, s).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SCRIPTS)]))
    return F.when((best["n"] == 0) | ((best["s"] == "Latin") & (best["n"] < 40)), "und").otherwise(best["s"])


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, as a lambda's variable, however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


def count_of(c: Column, members: str) -> Column:
    """How many characters of a text are in a class. regexp_count() makes an array of all matches; this only shortens the text by whole runs."""
    return F.char_length(c) - F.char_length(F.regexp_replace(c, f"[{members}]+", ""))


def question_language(c: Column) -> Column:
    """en, fr, es or de by function words and letters; und unless one has two points and leads."""
    cues = sorted({w for plain, strong, _ in fixed.CUES.values() for w in (plain + " " + strong).split()})
    words = lambda lower: F.filter(F.split(lower, r"[^\p{L}'’-]+"), lambda w: w.isin(cues))

    def points(lang: str, lower: Column, said: Column) -> Column:
        plain, strong, letters = fixed.CUES[lang]
        hit = lambda ws, n: F.size(F.filter(said, lambda w: w.isin(ws.split()))) * n
        total = hit(plain, 1) + hit(strong, 2)
        many = lambda ls: count_of(lower, "".join(ls))
        if weak := [x for x, n in letters.items() if n == 1]:
            total = total + F.least(many(weak), F.lit(1))
        if own := [x for x, n in letters.items() if n > 1]:
            total = total + F.least(many(own), F.lit(2)) * max(n for n in letters.values())
        return total

    # What is bound to a lambda's variable is computed once for all languages.
    said = once(F.lower(c), lambda x: F.struct(x.alias("lower"), words(x).alias("words")))
    ranked = once(said, lambda x: F.sort_array(F.array(*[F.struct(points(k, x["lower"], x["words"]).alias("n"), F.lit(k).alias("lang")) for k in fixed.CUES]), asc=False))
    return once(ranked, lambda r: F.when((r[0]["n"] >= 2) & (r[0]["n"] - r[1]["n"] >= 1), r[0]["lang"]).otherwise("und"))


def _last(text: Column, what: str) -> Column:
    """0-based place of the last occurrence, or -1."""
    at = F.instr(F.reverse(text), F.reverse(F.lit(what)))
    return F.when(at == 0, F.lit(-1)).otherwise(F.length(text) - at - len(what) + 1)


def truncate(c: Column, limit: int) -> Column:
    """Cut after a sentence, else before a word, if that keeps more than half; else hard; with an ellipsis."""
    head = F.substring(c, 1, limit)
    sentence = F.greatest(_last(head, ". "), _last(head, "\n"), _last(head, "。"))
    word = _last(head, " ")
    at = F.when(sentence > limit / 2, sentence + 1).when(word > limit / 2, word).otherwise(F.lit(limit))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.regexp_replace(F.substring(head, F.lit(1), at.cast("int")), r"\s+$", ""), F.lit("…")))


def snippet(c: Column) -> Column:
    """One line without invisible characters."""
    line = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\p{Cf}\p{Cc}&&[^\t\n\r]]", ""), r"\s+", " "))
    return truncate(line, fixed.SNIPPET_CHARS)


def extracted(c: Column) -> Column:
    """Each line cleaned, one blank line at most between others, none at the ends."""
    x = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(x, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def joined_lines(c: Column) -> Column:
    """Hyphenation at Latin line ends undone."""
    return F.regexp_replace(c, r"(\p{IsLatin})[-‐]\n(\p{Ll})", "$1$2")


def shingles(words: Column, n: int) -> Column:
    """All runs of n words, repeats included."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))


def hashed_shingles(words: Column, n: int) -> Column:
    """A 64-bit hash of each run of n words, repeats included."""
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))).otherwise(F.array().cast("array<long>"))


def trigger(c: Column) -> Column:
    """The phrase that a message is, exactly or with up to 12 % of typing errors (eight words, twelve characters)."""
    said = match_form(c)
    hits = []
    for t in fixed.TRIGGERS:
        own = match_form(F.lit(t))
        near = (F.size(F.split(said, " ")) <= 8) & (F.length(own) >= 12) & (F.levenshtein(said, own) <= F.floor(F.length(own) * 0.12))
        hits.append(F.when((said == own) | near, F.lit(t)))
    return F.coalesce(*hits)


def scrubbed(c: Column) -> Column:
    """Absolute paths out of error texts."""
    return F.regexp_replace(F.regexp_replace(c, r"[A-Za-z]:\\[^\s'\"]+", "<path>"), r"(^|[\s'\"(])/(?:[^\s/'\"]+/)+[^\s/'\"]*", "$1<path>")


def mirrored(c: Column) -> Column:
    return F.translate(c, "()[]{}<>«»", ")(][}{><»«")


def escaped(c: Column, limit: int = 120) -> Column:
    x = F.substring(c, 1, limit)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def file_name(c: Column, limit: int = 120) -> Column:
    """The last part of a path, without odd characters, cut so that its extension stays."""
    base = F.element_at(F.split(c, r"[/\\]"), -1)
    clean = F.trim(F.regexp_replace(F.regexp_replace(base, r"[\p{Cc}\p{Cf}<>:\"|?*]", ""), r"\s+", " "))
    ext = F.regexp_extract(clean, r"\.[A-Za-z0-9]{1,8}$", 0)
    return F.when(F.length(clean) == 0, "document").when(F.length(clean) <= limit, clean).otherwise(F.concat(F.substring(clean, F.lit(1), limit - F.length(ext)), ext))


def markers(c: Column) -> Column:
    """Numbers of the [S1] marks in a reply, in order of first mention."""
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\[S([0-9]{1,3})\]"), 1), lambda x: x.cast("int")))


def without_markers(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\[S[0-9]{1,3}\]", ""), r"\[S?[0-9]*$", ""))


def signals(c: Column, folded: Column) -> Column:
    """Ids of the rules of instruction-like wording that a text and its match form (between spaces) meet, raw rules first. The rules are told apart only where one is met."""
    any_rule = "|".join(f"(?:{p})" for p in fixed.INJECTION_RULES.values())
    raw = [F.when(c.rlike(p), F.lit(k)) for k, p in fixed.RAW_RULES.items()]
    own = [F.when(folded.rlike(f" (?:{p}) "), F.lit(k)) for k, p in fixed.INJECTION_RULES.items()]
    none = F.array().cast("array<string>")
    return F.concat(F.array_compact(F.array(*raw)), F.when(folded.rlike(f" (?:{any_rule}) "), F.array_compact(F.array(*own))).otherwise(none))


def flagged(df: DataFrame, column: str) -> DataFrame:
    """Adds signals. The match form is made once for each row: projections are not merged across an exploded array of one."""
    once = F.explode(F.array(F.concat(F.lit(" "), match_form(F.col(column)), F.lit(" "))))
    return df.withColumn("_folded", once).withColumn("signals", signals(F.col(column), F.col("_folded"))).drop("_folded")


def refuses(c: Column) -> Column:
    """Whether the first word of a grounding reply is a no."""
    return F.lower(F.regexp_extract(c, r"[\p{L}\p{N}]+", 0)).isin(*fixed.NO_WORDS)
