"""Fixed values that define results: word lists, patterns, thresholds."""

# Function words left out of searches, by language.
STOPWORDS = {
    "en": """a an the and or but if then else of to in on at by for with from into onto about as is are was were be been being
        am do does did done have has had having it its this that these those there here he she they them his her their we
        our you your i me my who whom whose what which when where why how can could would should shall will may might must
        not no nor so than too very just also only any some such each every both either neither more most other another
        tell me please explain describe say says said whats whos hows""",
    "fr": """le la les un une des du de et ou mais si donc ni en dans sur sous par pour avec sans chez vers est sont
        ce cet cette ces il ils elles on nous vous je tu me te se lui leur leurs qui que quoi dont quand comment pourquoi
        quel quelle quels quelles ne pas plus tres aussi seulement""",
    "es": """el la los las un una unos unas y o pero si entonces de del al en sobre bajo por para con entre hacia es
        este esta estos estas ese esa esos esas su sus mi mis que quien cual cuando donde como porque no mas muy tambien solo""",
    "de": """der die das den dem des ein eine einen einem einer eines und oder aber wenn dann von zu in im an am auf aus bei
        mit nach vor durch gegen ohne um ist sind war waren sein es er sie wir ihr ich du wer was wo wann warum wie nicht kein auch nur sehr noch schon""",
    "it": """il lo la i gli le un uno una di del dello della dei degli delle a al allo alla ai agli alle da dal dallo dalla in
        nel nello nella con su sul sulla per tra fra e o ma se allora che chi cui come dove quando perche non piu molto
        anche solo sono erano essere stato ha hanno aveva avere questo questa questi queste quello quella lui lei loro noi voi io tu mi ti si""",
    "pt": """o a os as um uma uns umas de do da dos das em no na nos nas por para com sem entre sobre sob e ou mas se entao
        que quem qual quais quando onde como porque nao mais muito tambem so sao eram ser foi ha tinha ter este esta estes estas
        esse essa esses essas isso isto ele ela eles elas voces eu tu me te lhe seu sua seus suas""",
    "tr": """ve veya ama ise de da ki bir bu su o bunlar sunlar onlar ben sen biz siz ne nasil neden nerede kim hangi kac icin
        ile gibi kadar daha cok en mi mu hem hic her olan olarak var yok degil""",
    "ar": """من في على الى عن مع بين عند حتى ثم لكن الا او ان انه انها انهم اذا اذ لو لا لم لن ما ماذا هل هو هي هم هن هذا هذه
        ذلك تلك اولئك هنا هناك كان كانت كانوا يكون تكون كل بعض غير قد لقد كيف متى اين لماذا اي كم الذي التي الذين بعد قبل فوق تحت حول
        خلال منذ نحو عبر له لها لهم لنا لك به بها بهم فيه فيها عليه عليها منه منها عنه عنها ايضا فقط جدا ليس ليست ولا وما وهل وان وقد""",
    "fa": """و در به از که این آن را با برای است بود هست هستند بودند شد شده می هم یا تا چه کی کجا چرا چگونه کدام چند
        نیز اما اگر پس بر روی زیر میان درباره خود او ما شما آنها چیست کسی مورد""",
    "ur": "کا کی کے میں ہے ہیں اور سے کو پر یہ وہ کہ بھی نے تھا تھی تھے کیا کون کب کہاں کیوں کیسے ایک تو ہی لیے ساتھ کس بارے",
}
# Words of a request, which a document need not contain.
TASK_WORDS = "summarize summarise summary overview translate translation read list give show talk tell explain describe say mean contain cover discuss outline display quote paraphrase extract"
# Function words that speak for a language (1 point; strong: 2) and its letters' points.
CUES = {
    "en": ("is are was were whom whose does do did of and or not with for in on at by from this that these those there which can could would should will have has had you your it its be been the", "what who where when why how", {}),
    "fr": ("le la les des du une est sont dans pour avec sur et ou ne pas plus très aussi cette ces ses mes y il elle ils elles nous vous je tu", "qui quoi où quand comment pourquoi quel quelle quels quelles", {"ç": 2, "œ": 2, "ù": 2, "â": 1, "ê": 1, "î": 1, "ô": 1, "û": 1, "è": 1, "à": 1, "ï": 1}),
    "es": ("el los las una unos unas es son por porque para con sobre y o pero también más está están fue esta este estos estas del al su sus mi mis se lo le les", "qué quién cuál cuándo dónde cómo", {"ñ": 3, "¿": 3, "¡": 3, "á": 1, "í": 1, "ó": 1, "ú": 1}),
    "de": ("der die das den dem des ein eine einen einem einer eines ist sind war waren und oder mit für von zu im am auf aus bei nach über unter durch gegen ohne auch nur sehr noch schon hat haben wurde was", "wer wo wann wie warum welche welcher welches nicht", {"ß": 3, "ä": 1, "ö": 1, "ü": 1}),
}
# Phrases that open the memory; approximate matches from 12 characters on.
TRIGGERS = ("But I can show you...", "Show me where you read that.", "Open the memory.", "Turn back the leaves.", "Let the ink remember.", "Take me to that page.", "Show me what is hidden.", "Reveal the secrets.", "Show me what lies within.")
# Refusal sentences.
NOT_FOUND = {
    "en": "I could not find this information in the document. The provided PDF does not appear to cover this topic.",
    "fr": "Je n’ai pas trouvé cette information dans le document. Le PDF fourni ne semble pas couvrir ce sujet.",
    "es": "No pude encontrar esta información en el documento. El PDF proporcionado no parece cubrir este tema.",
    "de": "Ich konnte diese Information im Dokument nicht finden. Das bereitgestellte PDF scheint dieses Thema nicht abzudecken.",
    "it": "Non ho trovato questa informazione nel documento. Il PDF fornito non sembra trattare questo argomento.",
    "pt": "Não encontrei esta informação no documento. O PDF fornecido não parece abordar este tema.",
    "tr": "Bu bilgiyi belgede bulamadım. Sağlanan PDF bu konuyu kapsıyor gibi görünmüyor.",
    "ar": "لم أتمكن من العثور على هذه المعلومة في المستند. يبدو أن ملف PDF المقدَّم لا يغطي هذا الموضوع.",
}
# Instruction-like wording on folded text (words apart by one space).
_GAP = r"(?:\S+ ){0,3}?"
INJECTION_RULES = {
    "en-ignore-instructions": rf"(?:ignore|disregard|forget|override|bypass|skip|neglect) {_GAP}(?:instructions?|prompts?|rules|directions?|guidelines|constraints|directives)",
    "en-system-prompt": r"(?:system|developer|hidden|initial|original) (?:prompt|message|instructions?)",
    "en-you-are-now": r"you are (?:now|no longer)",
    "en-act-as": r"act as",
    "en-pretend": r"pretend (?:to be|you are|that you)",
    "en-mode": r"(?:developer|debug|dan|jailbreak|god|admin|sudo|unrestricted) mode",
    "en-reveal": r"(?:reveal|show|print|output|repeat|display|leak|tell me) (?:me )?(?:your|the) (?:system|hidden|secret|initial|original|instructions?|prompt)",
    "en-from-now-on": r"from now on",
    "en-reply-only": r"(?:reply|respond|answer|output) (?:only|exclusively) with",
    "en-new-instructions": r"new instructions?",
    "en-hide-from-user": r"do not (?:tell|mention|reveal|inform) (?:the )?user",
    "ar-ignore-instructions": rf"(?:تجاهل|تجاهلي|اهمل|انس|انسي|تخط|تخطي|تجاوز) {_GAP}(?:التعليمات|الاوامر|القواعد|التوجيهات|الارشادات|التعليمات\S*)",
    "ar-system-prompt": r"(?:تعليمات|موجه|رسالة|رساله|امر|اوامر) (?:النظام|المطور)",
    "ar-you-are-now": r"انت الان",
    "ar-mode": r"وضع (?:المطور|التصحيح|المبرمج)",
    "ar-reply-only": r"(?:اجب|رد|اكتب|قل) (?:فقط|حصريا) \S*",
    "ar-reveal": rf"(?:اكشف|اظهر|اعرض|اطبع|كرر) (?:لي )?{_GAP}(?:النظام|التعليمات|الموجه)",
    "ar-act-as": r"تصرف (?:كانك|كما لو|ك\S+)",
    "ar-from-now-on": r"من الان فصاعدا",
    "fr-ignore-instructions": rf"(?:ignore[zr]?|oublie[zr]?|neglige[zr]?) {_GAP}(?:instructions?|consignes?|regles?|directives?)",
    "fr-system-prompt": r"(?:prompt|invite|message|instructions?) (?:du )?(?:systeme|developpeur)",
    "fr-you-are-now": r"(?:tu es|vous etes) (?:maintenant|desormais)",
    "fr-mode": r"mode developpeur",
    "fr-reply-only": r"(?:reponds?|repondez) (?:uniquement|seulement) (?:par|avec)",
    "fr-reveal": rf"(?:revele[zr]?|affiche[zr]?|montre[zr]?) {_GAP}(?:instructions|prompt)",
    "fr-from-now-on": r"a partir de maintenant",
    "es-ignore-instructions": rf"(?:ignora|ignore|ignorar|olvida|olvide|omite) {_GAP}(?:instrucciones|reglas|indicaciones|directrices)",
    "es-system-prompt": r"(?:prompt|mensaje|instrucciones) (?:del )?(?:sistema|desarrollador)",
    "es-you-are-now": r"(?:ahora eres|eres ahora|ahora actuas)",
    "es-mode": r"modo (?:desarrollador|programador)",
    "es-reply-only": r"responde (?:solo|unicamente|solamente) con",
    "es-reveal": rf"(?:revela|muestra|imprime) {_GAP}(?:instrucciones|prompt)",
    "es-from-now-on": r"a partir de ahora",
    "de-ignore-instructions": rf"(?:ignoriere|ignorieren|vergiss|missachte|ubergehe|uberspringe) {_GAP}(?:anweisungen|instruktionen|regeln|vorgaben|befehle)",
    "de-system-prompt": r"(?:system ?prompt|systemnachricht|entwicklernachricht)",
    "de-you-are-now": r"(?:du bist|sie sind) (?:jetzt|nun|ab sofort)",
    "de-mode": r"entwicklermodus",
    "de-reply-only": r"(?:antworte|antworten sie) nur mit",
    "de-reveal": rf"(?:verrate|enthulle|zeige) {_GAP}(?:anweisungen|prompt|systemprompt)",
    "de-from-now-on": r"ab jetzt",
}
RAW_RULES = {"chat-template-token": r"(?i)<\|[a-z_]+\|>", "llama-marker": r"(?i)\[\s*/?\s*inst\s*\]|<<\s*/?\s*sys\s*>>", "markdown-role-heading": r"(?im)^[ \t]*#{1,6}[ \t]*(?:system|instructions?)\b"}
# First words of a reply that refuse.
NO_WORDS = ("no", "not", "لا", "ليس", "غير", "لم")
# Hundredths of a token for each letter, Arabic letter, ASCII digit, CJK character, white space, astral character and other character; a run of
# letters or digits is a token at least, and a space before a symbol costs as much as a symbol.
LETTER, ARABIC, DIGIT, CJK, BLANK, ASTRAL, SYMBOL = 34, 42, 55, 85, 10, 150, 100
# Search and evidence.
# Weight of a cover of one word, and how many places of a word count.
COVER, PLACES = 0.1, 255
RRF_K, DROP_RATIO, LEAST_CHUNKS, MOST_TOKENS, LEAST_CHARS = 60, 0.5, 6, 40, 2
TOP_K, CANDIDATES, CONTEXT_CHARS, CUT_LEAST = 6, 24, 16000, 400
FLOOR, SAME_FLOOR, STRONG, CROSS_STRONG, INFORMATIVE, STRONG_COVERAGE = 0.60, 0.57, 0.71, 0.69, 0.45, 0.6
HISTORY_MESSAGES, HISTORY_CHARS, SNIPPET_CHARS = 6, 3000, 400
GUARD_WORDS, GUARD_LEAST, GUARD_SHARE = 8, 8, 0.3
CHUNK_TARGET, CHUNK_MAX, CHUNK_MIN, CHUNK_OVERLAP = 2000, 3000, 400, 200
BUDGETS = {"llm": 300, "embed": 800, "ocr": 100, "aux": 400}
PACIFIC = "America/Los_Angeles"


# Letters and digits that the match form folds, each with what it becomes.
FOLDS = {
    "أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ک": "ك", "ی": "ي", "ې": "ي", "ہ": "ه", "ۀ": "ه", "ە": "ه",
    "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
    "۰": "0", "۱": "1", "۲": "2", "۳": "3", "۴": "4", "۵": "5", "۶": "6", "۷": "7", "۸": "8", "۹": "9",
}
FOLDED = ("".join(FOLDS), "".join(FOLDS.values()))


def stopwords() -> list[str]:
    """All languages' function words in the match form."""
    return sorted({w.translate(str.maketrans(*FOLDED)) for words in STOPWORDS.values() for w in words.split()})
