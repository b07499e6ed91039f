"""Sentences that may stay in a reply without a citation: what the document does not say, about what was asked.

A whole sentence must be one clause of a known form: an opening, the document (or it, with a verb of saying), a denied verb, and a tail. What the tail names must be the
question's own words, so that neither a claim nor an order passes for silence.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed, text

# Share of the tail's words that must be the question's; most words of a sentence and of a bare noun phrase; silences of a reply.
COVERED, WORDS, PHRASE, MOST = 0.6, 35, 8, 2

# Fixed values, by language: openings; the document and what was read of it; verbs of saying; verbs of holding, which need the document as their subject.
_EN_DOC = r"(?:(?:the|this|these|those|uploaded|provided|available) )*(?:documents?|excerpts?|texts?|passages?|pages?|manuscript|file|pdf|sources?|materials?)"
_EN_SAY = r"(?:state|mention|specify|say|indicate|clarify|explain|address|discuss|detail)"
_EN_HOLD = r"(?:provide|offer|include|contain|give|list|cover|describe)"
_OPEN = {
    "en": r"(?:(?:however|note that|unfortunately|also|but|in addition|that said),? )?",
    "fr": r"(?:(?:cependant|toutefois|mais|néanmoins|en revanche),? )?",
    "es": r"(?:(?:sin embargo|no obstante|pero|además),? )?",
    "de": r"(?:(?:allerdings|jedoch|aber),? )?",
    "ar": r"(?:(?:لكن|ولكن|ومع ذلك|غير ان)[،,]? )?",
}
_BODY = {
    "en": (
        rf"{_EN_DOC} (?:do|does|did)(?: not|n't) (?:\w+ly )?(?:{_EN_SAY}|{_EN_HOLD})",
        rf"(?:it|they) (?:do|does|did)(?: not|n't) (?:\w+ly )?{_EN_SAY}",
        r"there (?:is|are|was|were) no (?:\w+ )?(?:information|mention|indication|details?|statement|reference)",
        rf"it is not (?:\w+ly )?(?:stated|mentioned|specified|clear|indicated|explained)(?: in {_EN_DOC})?",
    ),
    "fr": (r"(?:le|les|ce|ces|la) (?:document|texte|extraits?|passages?|pages?|fichier|manuscrit) n(?:e |')(?:précise|mentionne|indique|dit|spécifie|explique|contient|fournit|donne)(?:nt)? pas", r"il n'est pas (?:précisé|mentionné|indiqué)"),
    "es": (r"(?:el|los|la|las|este|estos) (?:documento|texto|archivo|extractos?|pasajes?|páginas?|manuscrito) no (?:menciona|especifica|indica|dice|aclara|explica|contiene|proporciona)n?", r"no se (?:menciona|especifica|indica|aclara)"),
    "de": (r"(?:das|der|die|dieses|dieser|diese) (?:dokument|text|datei|auszüge|auszug|seiten?|manuskript) (?:nennt|erwähnt|sagt|erklärt|enthält|gibt|nennen|erwähnen|sagen|enthalten)(?: dazu)? (?:nicht|keine(?:n)?(?: (?:angaben|informationen|hinweise?))?)",),
    "ar": (r"(?:لا|لم) (?:يذكر|تذكر|يوضح|توضح|يحدد|تحدد|يشير|تشير|ينص|تنص)(?: (?:المستند|الوثيقه|النص|الملف|المقتطفات|الصفحات|المخطوطه))?", r"(?:المستند|الوثيقه|النص|الملف|المقتطفات|المخطوطه) (?:لا|لم) (?:يذكر|تذكر|يوضح|توضح|يحدد|تحدد|يشير|تشير)"),
}
#: What begins a tail that may be long.
_ASKS = r"(?:whether|if|when|where|who|whom|whose|how|why|what|which|si|quand|où|qui|comment|pourquoi|cuándo|dónde|quién|cómo|por qué|ob|wann|wo|wer|wie|warum|ما اذا|هل|متي|اين|كيف|لماذا)"
#: What joins a second clause or makes a claim of it, and what is an order, an address or a second person.
_LINKS = r"(?u)[;:—–]|(?<![\p{L}])(?:but|so|because|which|that|although|while|therefore|mais|donc|parce que|pero|porque|aber|weil|denn|dass|لكن|لذا|لان)(?![\p{L}])"
_ORDERS = r"(?u)(?:https?://|www\.|@|[0-9]{4,})|(?<![\p{L}])(?:you|your|please|must|contact|visit|call|write|click|vous|veuillez|contactez|usted|póngase|contacte|visite|sie|bitte|kontaktieren|عليك|يرجي|تواصلوا|زوروا)(?![\p{L}])"
#: Words of a tail that name nothing.
FILLER = "whether specifically specific explicitly explicit particularly directly clearly exactly even available information info details detail anything something mention reference indication document documents excerpt excerpts text texts passage passages page pages manuscript pdf file source sources any si précisément texte extraits información informacion documento texto ob dokument angaben informationen dazu".split()


def _folded(c: Column) -> Column:
    """Lower case, one blank, straight apostrophes, Arabic letters unified; punctuation stays."""
    x = F.translate(F.lower(c), "’‘ʼأإآٱىةکی", "'''اااايهكي")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def _tail(said: Column) -> Column:
    """What follows the denied verb, null for a sentence of no known form."""
    found = []
    for lang, bodies in _BODY.items():
        for body in bodies:
            form = rf"(?u)^{_OPEN[lang]}{body}(?![\p{{L}}])(.*)$"
            found.append(F.when(said.rlike(form), F.trim(F.regexp_extract(said, form, 1))))
    return F.coalesce(*found)


def _forms(w: Column) -> Column:
    """A word and what is left of it without an English ending."""
    cut = lambda end, least: F.when((F.length(w) > least) & F.endswith(w, F.lit(end)), F.substring(w, F.lit(1), F.length(w) - len(end)))
    return F.array_compact(F.array(w, cut("s", 3), cut("es", 4), cut("ed", 4), cut("ing", 5), text.light_stem(w)))


def is_silence(sentence: Column, question: Column) -> Column:
    """Whether a sentence says only that the document is silent on what the question asks. A null question covers tails that name nothing."""
    said = F.regexp_replace(_folded(sentence), r"[.!؟?\s]+$", "")
    tail = F.regexp_replace(_tail(said), r"^(?:so|this|it)$", "")
    words = F.filter(text.surface_words(F.coalesce(tail, F.lit(""))), lambda w: ((F.length(w) >= 2) | w.rlike("[0-9]")) & ~F.array_contains(F.array(*[F.lit(x) for x in [*fixed.stopwords(), *FILLER]]), w))
    known = F.flatten(F.transform(text.surface_words(F.coalesce(question, F.lit(""))), _forms))
    covered = F.size(F.filter(words, lambda w: F.arrays_overlap(_forms(w), known)))
    whole = F.size(F.split(said, " "))
    rest = F.regexp_replace(tail, r"^(?:about|on|of|for|regarding|concerning|as to|sur|sobre|über|zu|الي|عن|حول) ", "")
    short = F.size(F.split(rest, " ")) <= PHRASE
    fine = (rest == "") | rest.rlike(rf"(?u)^,? ?{_ASKS}(?![\p{{L}}])") | (short & ~F.contains(rest, F.lit(",")))
    return F.coalesce(tail.isNotNull() & fine & (whole <= WORDS) & ~tail.rlike(_LINKS) & ~said.rlike(_ORDERS) & (covered >= F.size(words) * COVERED), F.lit(False))


def kept(sentences: Column, question: Column, cited: Column | None = None) -> Column:
    """The sentences of a reply that stay: those that cite, and after the first of them at most two silences.

    sentences: an array; ``cited`` may be an array of booleans beside it, else a sentence with a marker [S1] cites.
    """
    each = F.transform(sentences, lambda s: F.struct(s.alias("s"), s.rlike(r"\[S[0-9]{1,3}\]").alias("cites"), is_silence(s, question).alias("silent")))
    each = each if cited is None else F.zip_with(each, cited, lambda e, c: F.struct(e["s"].alias("s"), c.alias("cites"), e["silent"].alias("silent")))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("cited"), F.lit(0).alias("n"))

    def step(a: Column, e: Column) -> Column:
        silent = ~e["cites"] & e["silent"] & a["cited"] & (a["n"] < MOST)
        return F.struct(F.when(e["cites"] | silent, F.array_append(a["out"], e["s"])).otherwise(a["out"]).alias("out"), (a["cited"] | e["cites"]).alias("cited"), (a["n"] + silent.cast("int")).alias("n"))

    return F.aggregate(each, start, step, lambda a: a["out"])

