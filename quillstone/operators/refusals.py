"""Replies that refuse, told while they arrive: an automaton of all mandated sentences, word by word, holds a stream back as long as one of them may still be coming."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed
from . import walks

#: What refuses beside the mandated sentences, in brackets or not.
SENTINELS = ("NO_ANSWER", "NOT_IN_DOCUMENT", "NOT_FOUND")
#: What may stand before a refusal: white space, markdown and quotes.
NOISE = frozenset(" \t\r\n*_>#`\"'“”«»-[(")
_FOLD = str.maketrans({"أ": "ا", "إ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ة": "ه", "ک": "ك", "ی": "ي", "ـ": None})
END = ""


def _letters(c: str) -> str:
    """A character as the automaton reads it: lower case, without marks, Arabic letters unified; nothing for marks and format characters, a blank for what parts words."""
    out = ""
    for x in unicodedata.normalize("NFKD", c.lower()).translate(_FOLD):
        kind = unicodedata.category(x)
        if kind[0] in "LN":
            out += x
        elif kind not in ("Mn", "Cf"):
            out += " "
    return out


def words(text: str) -> list[str]:
    return "".join(_letters(c) for c in text.replace("'", "").replace("’", "")).split()


@cache
def automaton() -> dict:
    """Words to what may follow; END marks a whole sentence."""
    root: dict = {}
    for sentence in (*fixed.NOT_FOUND.values(), *SENTINELS):
        node = root
        for w in words(sentence):
            node = node.setdefault(w, {})
        node[END] = {}
    return root


class Reader:
    """A reply's opening as it arrives: ``said`` is refusal, answer or, while it may become either, None."""

    def __init__(self) -> None:
        self.nodes, self.word, self.said, self.lead = automaton(), "", None, True

    def _close(self) -> None:
        """A word has ended."""
        if not self.word:
            return
        self.nodes = self.nodes.get(self.word)
        self.word = ""
        if self.nodes is None:
            self.said = "answer"
        elif END in self.nodes:
            self.said = "refusal"

    def feed(self, text: str) -> None:
        for c in text:
            if self.said:
                return
            if self.lead and c in NOISE:
                continue
            self.lead = False
            if c in "'’":
                continue
            for x in _letters(c):
                if x == " ":
                    self._close()
                    if self.said:
                        return
                else:
                    self.word += x
            if self.word and not any(w.startswith(self.word) for w in self.nodes):
                self.said = "answer"

    def end(self) -> str:
        """No more comes."""
        if not self.said:
            self._close()
        return self.said or "answer"


def refuses(text: str | None) -> bool:
    reader = Reader()
    reader.feed(text or "")
    return reader.end() == "refusal"


def held(parts: DataFrame, key: list[str], order: str = "seq", text: str = "text") -> DataFrame:
    """parts of streamed replies with ``shown``, what may be shown when the part has arrived, and ``refused``, once that is known.

    Nothing is shown while the reply may still become a refusal; a refusal is never shown; otherwise the parts of a reply show all of it. However it is cut into
    parts, that is what the whole text gives. The state holds the text that is held back: no more than a mandated sentence and what stands before it. A null part
    is empty.
    """
    last = F.lead(F.lit(1)).over(Window.partitionBy(*key).orderBy(order)).isNull()

    def step(s: dict, row: dict) -> dict:
        part = row[text] or ""
        reader = s["reader"]
        before = reader.said
        if before == "answer":
            return {"shown": part, "refused": False}
        if before is None:
            s["held"] += part
            reader.feed(part)
        said = reader.end() if row["_last"] else reader.said
        if said == "answer":
            out, s["held"] = s["held"], ""
            reader.said = "answer"
            return {"shown": out, "refused": False}
        if said == "refusal":
            s["held"] = ""
        return {"shown": "", "refused": said == "refusal"}

    rows = parts.withColumn("_last", last)
    return walks.walked(rows, key, [order], lambda: {"reader": Reader(), "held": ""}, step, "shown string, refused boolean").drop("_last")
