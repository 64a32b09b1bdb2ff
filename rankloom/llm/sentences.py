"""Sentence boundaries across languages and scripts.

Method: statistics learned unsupervised per language over all documents (after Kiss and Strunk, Computational Linguistics
2006), then each period classified with them. One counting pass over the texts sums, per language, how often a word stands at
a sure start (after a blank line or after ! ? and their kin) and how often within a sentence: by log-likelihood ratio this
gives the sentence starters. The same pass counts which words follow each word before a period; joined with the starters
this tells for every such word how often a starter, another capitalised word, a lower-case word, a digit or the end of the
paragraph follows: by log-likelihood ratio against ordinary words this gives the abbreviations, those that hardly ever end
a sentence (titles) apart from those that may (etc.), and the collocations of a number with its period. A second pass cuts
every text whole.

All counts are summed before and after the shuffle in Spark; only words whose behaviour differs significantly from an
ordinary word are kept, the others behave like one. Up to MODEL_LIMIT kept words are broadcast. Beyond that the model stays a
table: each text states the words that it will look up and gets its own entries by a join, with the same result.

Defined results for odd input: null, empty and blank texts give nothing; offsets count Unicode code points of the text as
it stands (no normalisation; combining marks count); repeated rows give repeated units; an unclosed quotation mark or
bracket is taken as if it were not there; line ends may be LF, CR or CRLF; a null or wrong language tag does no harm, the
language is taken from script and function words; a text without a mark is one unit per paragraph; a run of more than
LONG_RUN characters without a space or mark before a period is no word, all of them count as one type. Only the named
columns are read, so extra columns never clash.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.session import materialize

MODEL_LIMIT = 200_000
LONG_RUN = 64
FLUSH = 100_000
#: Least log-likelihood ratio: 1 in 10,000 by chance.
SIGNIFICANT = 15.14

# Frequent function words, only used to tell apart languages that share the Latin script.
FUNCTION_WORDS = {
    "en": "the of and is that to it for with was on as are by than but its not from this which".split(),
    "fr": "le la les des du de et est que un une en pour sur dans avec mais à au par sans notre chaque".split(),
    "es": "el la los las de y es que un una en por para con pero del al sin más cada nuestro".split(),
    "de": "der die das und ist dem den des ein eine im zu mit von auf aber nicht wird bei für jeder".split(),
}
# Marks.
ENDERS = "!?。！？｡．؟।॥‼⁇⁈⁉"
ELLIPSES = "…"
CLOSERS = "\"”’»›」』）)]】》〉}“"
PAIRS = {"(": ")", "[": "]", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "„": "“", "“": "”", "‹": "›", '"': '"'}
CASELESS = ("arabic", "devanagari", "thai", "cjk")
QUOTES = set("「『《〈«„“‹\"")
_PARAGRAPH = re.compile(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:(?:\r\n|\n|\r)[^\S\r\n]*)+")
_LINE = re.compile(r"\r\n|\n|\r")
#: A word up to its first apostrophe or inner period; the rest is passed over.
_HEAD = r"([^\W_][\ẁ-ͯऀ-ःऺ-़ा-ॏ\-]*)"
_WORDS = re.compile(_HEAD + r"(?:['’][\ẁ-ͯऀ-ःऺ-़ा-ॏ'’\-]*)?(?:\.[^\W\d_]+)*")
#: The word behind a sure end of a sentence; behind a period or a bullet, where it tells nothing.
_STARTS = re.compile(rf"[{re.escape(ENDERS)}]\s+" + _HEAD)
_AFTER_PERIOD = re.compile(r"\.(?:(?<![\w'’\-]\.)|(?![^\W\d_]))[\W_]*" + _HEAD)
_AFTER_BULLET = re.compile(r"\n[\W_]*?[-*•·]\s*" + _HEAD)
#: A single period, by lookahead (mark, word that follows, its own period, dash).
_FOLLOWS = re.compile(
    r"\.(?<![.…]\.)(?![.…])(?=\s*([,;:])|(?:\s+|(?=[“\"]))[«“„\"'‘(\[¿¡「『《（]*\s*([^\W_][^\s.!?…,;:»”\"()]*)(\.\s)?|\s+([–—-])|\s|$|[»”\"“)\]])")
#: A mark that may end a sentence, by lookahead the white space behind it and the next character.
_MARK = re.compile(r"([()\[\]（）【】「」『』《》〈〉«»„“”‹›\"!?。！？｡．؟।॥‼⁇⁈⁉…;.])(?=(\s*)(\S?))")
_MARK_OR_THAI_GAP = re.compile(r"([()\[\]（）【】「」『』《》〈〉«»„“”‹›\"!?。！？｡．؟।॥‼⁇⁈⁉…;.]|(?<=[\u0e00-\u0e7f])\s)(?=(\s*)(\S?))")
_SPACE = re.compile(r"\s*")
_THAI = re.compile("[\u0e00-\u0e7f]")
_PAIR = re.compile(r"[()\[\]（）【】「」『』《》〈〉«»„“”‹›\"]")
_BULLET = re.compile(r"[^\S\r\n]*([-*•·‣◦–])[^\S\r\n]+\S")
_NUMBER = re.compile(r"[^\S\r\n]*(?:(\d{1,3})[.)]|\((\d{1,3}|[a-z])\)|([a-z])\))[^\S\r\n]*\S")


# --- small helpers ----------------------------------------------------------------------------------------------------


def script_of(ch: str) -> str:
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "arabic"
    if 0x900 <= o < 0x980:
        return "devanagari"
    if 0xE00 <= o < 0xE80:
        return "thai"
    if 0x3040 <= o < 0x3100 or 0x31F0 <= o < 0x3200 or 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00 or 0xFF66 <= o < 0xFFA0:
        return "cjk"
    return "other"


_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
_EVERY = frozenset().union(*_SETS.values())
_SCRIPTS = ("", "latin", "greek", "cyrillic", "arabic", "devanagari", "thai", "cjk", "other")
_NOT_LATIN = re.compile("[\u0370-\u1dff\u1f00-\u1fff\u3040-\U0010ffff]")
_table: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """Code point -> number of its script, 0 for what is no letter; made once per process."""
    if not _table:
        _table.append(np.fromiter((_SCRIPTS.index(script_of(chr(o))) if chr(o).isalpha() else 0 for o in range(0x30000)), np.uint8, 0x30000))
    return _table[0]


def _language(paragraph: str, letters: np.ndarray | None) -> str:
    if letters is not None and len(letters):
        n = np.bincount(letters, minlength=len(_SCRIPTS))[1:]
        if n.any() and (top := _SCRIPTS[1 + int(n.argmax())]) != "latin":
            return top
    words = Counter(paragraph.lower().split())
    known = words.keys() & _EVERY
    hits = [sum(words[w] for w in known & s) for s in _SETS.values()]
    return list(_SETS)[hits.index(max(hits))] if known else "latin"


def language_of(paragraph: str) -> str:
    """Script of most letters; Latin script is told apart by function words."""
    return next(iter(languages(paragraph, [(0, len(paragraph))])))


def languages(text: str, spans: list[tuple[int, int]]) -> Iterator[str]:
    """The language of each span, by all its letters."""
    codes = None
    if not text.isascii() and _NOT_LATIN.search(text):
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _script_table()[np.minimum(points, 0x2FFFF)]
    for a, b in spans:
        yield _language(text[a:b], None if codes is None else codes[a:b])


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _PARAGRAPH.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def form_of(word: str) -> str:
    """U: capitalised or without case, l: lower case, d: digit."""
    c = word[0]
    return "d" if c.isdigit() else "l" if c.islower() else "U"


_STOPS = frozenset("([{«»„“”\"'‘（「『《¿¡,;:…")


def type_of(word: str, number_before: bool) -> str:
    """The type of a word: lower case; integers are all of one type, decimals too, and so are long runs."""
    if len(word) > LONG_RUN:
        return "##long"
    if not word.isascii():
        word = unicodedata.normalize("NFC", word)
    if word.isdigit():
        return "#.#" if number_before else "#" if len(word) <= 2 else "##"
    return word.lower()


def type_before(text: str, i: int, low: int) -> str:
    """The type of the word that ends just before the period at i."""
    window = text[max(low, i - LONG_RUN - 1) : i]
    if not window or window[-1].isspace():
        return ""
    word = window.rsplit(None, 1)[-1]
    if not word.isalnum():
        k = len(word)
        while k and word[k - 1] not in _STOPS:
            k -= 1
        word = word[k:]
    j = i - len(word)
    return type_of(word, j - 1 > low and text[j - 1] == "," and text[j - 2].isdigit())


_NEXT = re.compile(r"[«“„\"'‘(\[¿¡「『《（]*\s*([^\W_][^\s.!?…,;:»”\"()]*)")


def next_word(text: str, i: int, end: int) -> str:
    m = _NEXT.match(text, i, end)
    return "" if not m else w if (w := m.group(1)).isascii() else unicodedata.normalize("NFC", w)


# --- learning ---------------------------------------------------------------------------------------------------------


def ratio(k1: float, n1: float, k0: float, n0: float) -> float:
    """Log-likelihood ratio of k1 of n1 against k0 of n0."""

    def ll(k: float, n: float, p: float) -> float:
        return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n > k else 0.0)

    if not n1 or not n0:
        return 0.0
    p, p1, p0 = (k1 + k0) / (n1 + n0), k1 / n1, k0 / n0
    if p <= 0 or p >= 1:
        return 0.0
    return 2 * (ll(k1, n1, p1) + ll(k0, n0, p0) - ll(k1, n1, p) - ll(k0, n0, p))


def count_words(text: str, found: dict[tuple[str, str], list]) -> None:
    """Appends to lists by (part, language) what the paragraphs of a text hold. `word`: all runs without a space; `start`:
    words at sure starts; `not`: words after a period or a bullet, which tell nothing; `next`: (type before a period,
    follower or None, form of the follower). The follower is given where it may be a starter, that is unless it carries a
    period itself, as after titles."""
    spans = [(a, b) for a, b in paragraphs(text) if b > a]
    for (a, b), lang in zip(spans, languages(text, spans)):
        if (first := _WORDS.search(text, a, b)) is None:
            continue
        found["word", lang] += text[a:b].split()
        found["start", lang].append(first.group(1))
        found["start", lang] += _STARTS.findall(text, a, b)
        if text.find("\n", a, b) >= 0:
            found["not", lang] += _AFTER_BULLET.findall(text, a, b)
        if text.find(".", a, b) < 0:
            continue
        found["not", lang] += _AFTER_PERIOD.findall(text, a, b)
        follows = found["next", lang]
        for m in _FOLLOWS.finditer(text, a, b):
            if t := type_before(text, m.start(), a):
                mark, word, dotted, dash = m.groups()
                if not word:
                    follows.append((t, None, "mark" if mark or dash else "end"))
                else:
                    word = word if word.isascii() else unicodedata.normalize("NFC", word)
                    follows.append((t, None if dotted else starter_form(word), form_of(word)))


def starter_form(w: str) -> str:
    return w.split("’")[0].split("'")[0].split("-")[0] if not w[:1].isdigit() else w


_COUNTS = pa.schema([("part", pa.string()), ("lang", pa.string()), ("word", pa.string()), ("follower", pa.string()), ("form", pa.string()), ("n", pa.int64())])


def counted(docs: DataFrame) -> DataFrame:
    """(part, lang, word, follower, form, n) of count_words, and part `word` for all words; summed per task as far as
    FLUSH entries go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def flush() -> pa.RecordBatch:
            rows = list(zip(*((*k, n) for k, n in sums.items()))) or [[]] * len(_COUNTS)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, _COUNTS)], schema=_COUNTS)

        for b in batches:
            found: dict[tuple[str, str], list] = defaultdict(list)
            for text in b.column("text").to_pylist():
                if text:
                    count_words(text, found)
            for (part, lang), what in found.items():
                for x, n in Counter(what).items():
                    if part == "next":
                        sums["next", lang, *x] += n
                        continue
                    for w in _WORDS.findall(x) if part == "word" else (x,):
                        sums[part, lang, w if w.isascii() else unicodedata.normalize("NFC", w), None, None] += n
            if len(sums) > FLUSH:
                yield flush()
        yield flush()

    return docs.select("text").where("text is not null").mapInArrow(run, "part string, lang string, word string, follower string, form string, n bigint")


def _llr(k1, n1, k0, n0):
    """ratio() as a column."""
    ll = lambda k, n, p: F.when(k > 0, k * F.ln(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.ln(1 - p)).otherwise(0.0)
    k1, n1, k0, n0 = (c.cast("double") for c in (k1, n1, k0, n0))
    p, p1, p0 = F.try_divide(k1 + k0, n1 + n0), F.try_divide(k1, n1), F.try_divide(k0, n0)
    return F.when((n1 > 0) & (n0 > 0) & (p > 0) & (p < 1), 2 * (ll(k1, n1, p1) + ll(k0, n0, p0) - ll(k1, n1, p) - ll(k0, n0, p))).otherwise(0.0)


def learn_starters(counts: DataFrame) -> DataFrame:
    """(lang, word) of the words that stand at sure starts significantly more often than words do, and there at least as
    often as elsewhere."""
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("n")).otherwise(0))
    per = counts.where("part <> 'next'").groupBy("lang", "word").agg(of("start").alias("s"), (of("word") - of("not")).alias("n"))
    all_ = per.groupBy("lang").agg(F.sum("s").alias("ss"), F.sum("n").alias("nn"))  # a row per language
    good = per.where("s >= 3 and s * 2 >= n").join(F.broadcast(all_), "lang").withColumn("llr", _llr(F.col("s"), F.col("n"), F.col("ss") - F.col("s"), F.col("nn") - F.col("n")))
    return good.where(F.col("llr") >= SIGNIFICANT).select("lang", "word")


KINDS = ("starter", "other", "lower", "digit", "mark", "end")
_FORMS = {"U": "other", "l": "lower", "d": "digit", "mark": "mark", "end": "end"}


def learn_types(counts: DataFrame, starters: DataFrame) -> DataFrame:
    """(lang, word, seen): the types before periods that differ significantly from ordinary words. seen: how often each of
    KINDS follows, and of the language the share of starters among capitalised followers and of paragraph ends."""
    known = starters.select("lang", F.col("word").alias("follower"), F.lit(True).alias("is_starter"))
    kind = F.when(F.col("is_starter"), "starter").otherwise(F.create_map(*[F.lit(x) for kv in _FORMS.items() for x in kv])[F.col("form")])
    seen = counts.where("part = 'next'").groupBy("lang", "word", "follower", "form").agg(F.sum("n").alias("n")).join(known, ["lang", "follower"], "left").withColumn("kind", kind)
    per = seen.groupBy("lang", "word").agg(*[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in KINDS])
    per = per.withColumn("n", sum(F.col(k) for k in KINDS))
    all_ = per.groupBy("lang").agg(*[F.sum(k).alias(f"a_{k}") for k in (*KINDS, "n")])
    j = per.where("n >= 2").join(F.broadcast(all_), "lang")
    cont = F.col("lower") + F.col("digit") + F.col("mark")  # what follows shows that the sentence goes on
    a_cont = F.col("a_lower") + F.col("a_digit") + F.col("a_mark")
    on = _llr(cont, F.col("n"), a_cont - cont, F.col("a_n") - F.col("n")) * F.when(cont * F.col("a_n") > a_cont * F.col("n"), 1).otherwise(0)
    cap, a_cap = F.col("starter") + F.col("other"), F.col("a_starter") + F.col("a_other")
    title = _llr(F.col("other"), cap, F.col("a_other") - F.col("other"), a_cap - cap) * F.when(F.col("other") * a_cap > F.col("a_other") * cap, 1).otherwise(0)
    never = _llr(F.col("end"), F.col("n"), F.col("a_end") - F.col("end"), F.col("a_n") - F.col("n")) * F.when(F.col("end") * F.col("a_n") < 0.2 * F.col("a_end") * F.col("n"), 1).otherwise(0)
    at_least = lambda c: F.greatest(F.lit(1), c)
    base = [F.col("a_starter") / at_least(F.col("a_starter") + F.col("a_other")), F.col("a_end") / at_least(F.col("a_n"))]
    return j.where(F.greatest(on, title, never) >= SIGNIFICANT / 2).select("lang", "word", F.array(*[F.col(k).cast("double") for k in KINDS], *base).alias("seen"))


# --- cutting ----------------------------------------------------------------------------------------------------------


class Cutter:
    """Cuts texts with a learned model."""

    def __init__(self, starters, types) -> None:
        self.starters, self.types = starters, types
        self.told: dict[tuple, bool] = {}

    def ends_sentence(self, lang: str, t: str, follower: str, caseless: bool) -> bool:
        """Whether a period after type t, with the given following word, ends a sentence."""
        key = lang, t, follower, caseless
        if (told := self.told.get(key)) is None:
            if len(self.told) > FLUSH:
                self.told.clear()
            told = self.told[key] = self._ends_sentence(lang, t, follower, caseless)
        return told

    def _ends_sentence(self, lang: str, t: str, follower: str, caseless: bool) -> bool:
        form = form_of(follower)
        starts = (lang, starter_form(follower)) in self.starters
        known = self.types.get((lang, t))
        letters = sum(c.isalpha() or unicodedata.category(c)[0] == "M" for c in t)
        if known is None:  # an ordinary word, or too rare to tell
            if letters == 1 and not t[-1:].isdigit() and script_of(t[-1]) != "cjk":
                return starts and not caseless
            if "." in t and form == "d" and letters:
                return False
            if form != "l" or starts:
                return True
            return letters > 3 and "." not in t
        starter, other, lower, digit, mark, end, base, base_end = known
        n = starter + other + lower + digit + mark + end
        cap = starter + other
        share = (starter + base) / (cap + 1)  # of starters among capitalised followers
        if n >= 10 and t[0] != "#" and (end + base_end) / (n + 1) < 0.2 * base_end and (share < 0.9 * base or not cap):
            return False  # hardly ever at the end of a paragraph
        if form == "d":
            return (digit + 0.1) / (n + 1) < 0.1
        if form == "l":
            return starts and share > 0.5 * base
        if caseless and (end + base_end) / (n + 1) >= 0.3 * base_end:  # ends paragraphs like any other word
            return True
        if t in ("#", "##"):
            return starts or ((other + 0.1) / (cap + 1) < 0.5 and t == "##")
        if share < 0.25 * base:
            return False
        return starts or share >= 0.5 * base

    # one paragraph, without list items; returns ends of sentences
    def cut_run(self, text: str, a: int, b: int, lang: str, out: list[tuple[int, int]]) -> None:
        b = a + len(text[a:b].rstrip())
        start = i = _SPACE.match(text, a, b).end()
        match = _matching(text, a, b) if _PAIR.search(text, a, b) else {}
        for m in (_MARK_OR_THAI_GAP if _THAI.search(text, a, b) else _MARK).finditer(text, a, b):
            at, k = m.span(2)
            at = m.start()
            if at < i:
                continue
            c, n = m.group(1, 3)
            i = at + 1  # the first place that is not decided yet
            if c == "." and n != "." and n != "…":
                if not n:
                    break
                if k > i:
                    if n not in ",;:)]»”–—-،؛":
                        w = next_word(text, k, b)
                        caseless = not text[at - 1].isascii() and script_of(text[at - 1]) in CASELESS if at > a else False
                        if not w or self.ends_sentence(lang, type_before(text, at, a), w, caseless):
                            out.append((start, i))
                            start = k
                else:
                    t = type_before(text, at, a)
                    if self._glued(text, at, b, t, bool(t) and script_of(text[at - 1]) in CASELESS, lang):
                        out.append((start, i))
                        start = k
                continue
            if at in match:  # on to the partner: nothing inside a pair ends a sentence
                j = max(at, match[at])
                i = j + 1
                if j > at and self._closed(text, at, j, start, b, lang):
                    out.append((start, i))
                    start = _SPACE.match(text, i, b).end()
                continue
            if c in ENDERS or (c == ";" and self._greek(text, at, a)):
                while i < b and (text[i] in ENDERS or text[i] == "."):
                    i += 1
                # stray closers right behind the mark
                while i < b and text[i] in CLOSERS and i not in match:
                    i += 1
                if i > at + 1:
                    k = _SPACE.match(text, i, b).end()
                    n = text[k] if k < b else ""
                if not n or c in "。！？｡．।॥؟" or c in "!?" and script_of(text[at - 1] if at > a else "a") == "cjk":
                    go = n == "" or n not in ",，、;:；：،؛–—-"
                elif n in ",;:，、；：،؛–—":
                    go = False
                elif k == i:  # no space
                    go = n.isupper() or (n.isalpha() and not n.islower()) or n in PAIRS or n in "¿¡"
                elif n.islower():
                    go = (lang, starter_form(next_word(text, k, b))) in self.starters
                else:
                    go = True
                if go:
                    out.append((start, i))
                    start = k
            elif c in ELLIPSES or c == "." and n == "." and k == i:
                while i < b and text[i] in "….":
                    i += 1
                k = _SPACE.match(text, i, b).end()
                n = text[k] if k < b else ""
                w = next_word(text, k, b)
                if n and (n.isupper() or n in "¿¡«“„\"(") and script_of(n) != "cjk" and not self._caseless_before(text, at, a):
                    go = not w or form_of(w) != "l"
                else:
                    go = n.islower() and n.isalpha() and (lang, starter_form(w)) in self.starters and w[-1:].isdigit()
                if go:
                    out.append((start, i))
                    start = k
            elif c.isspace() and self._thai_gap(text, at, b):
                out.append((start, at))
                start = i = k
        if start < b:
            out.append((start, b))

    @staticmethod
    def _greek(text: str, i: int, a: int) -> bool:
        return i > a and any(script_of(ch) == "greek" and ch.isalpha() for ch in text[max(a, i - 3) : i])

    @staticmethod
    def _caseless_before(text: str, i: int, a: int) -> bool:
        return i > a and script_of(text[i - 1]) in CASELESS and text[i - 1].isalpha()

    def _glued(self, text: str, i: int, b: int, t: str, caseless: bool, lang: str) -> bool:
        """A period without a following space."""
        n, letters = text[i + 1], sum(ch.isalpha() for ch in t)
        if n in "¿¡" or n in "«“„" and letters > 2:
            return True
        if caseless:
            return letters >= 3 and n.isalpha() and script_of(n) == script_of(t[-1]) and "." not in t
        if "." in t and not t.replace(".", "").replace(",", "").isdigit():
            return False
        word = next_word(text, i + 1, b)
        if not n.isupper() or len(word) < 2 and word not in ("A", "I", "À", "L", "Y", "O", "Ο", "Η", "В", "Я"):
            return False
        if (lang, t) in self.types and self.types[(lang, t)][0] < 0.2 * self.types[(lang, t)][1]:
            return False
        return letters >= 2 or t[-1:].isdigit() and not t[:1] == "v" or t in ("#", "##")

    def _closed(self, text: str, opened: int, closed: int, first: int, b: int, lang: str) -> bool:
        """Whether a sentence ends with the quotation or bracket that closes here at the outer level."""
        k = closed - 1
        while k > opened and (text[k].isspace() or text[k] in CLOSERS):
            k -= 1
        last = text[k]
        if not (last in ENDERS or last in ".…" or last == ";" and self._greek(text, k, opened)):
            return False
        j = closed + 1
        while j < b and text[j].isspace():
            j += 1
        n = text[j] if j < b else ""
        if not n:
            return True
        leads = text[first : opened].strip(" \t\r\n¿¡" + "".join(PAIRS)) == ""
        if n in ",;:.!?。，、；：،؛।؟–—…" or n.islower() and (lang, starter_form(next_word(text, j, b))) not in self.starters:
            return False
        if text[opened] not in QUOTES:
            return leads
        if last == "." and leads and n.isupper() is False and not n.isalpha():
            return True
        before = text[:opened].rstrip()[-1:]
        told = before in (":", "：", ",", "，", "،")
        if n.isalpha() and not n.isupper() and not n.islower():  # no case
            return told and text[opened] not in "「『"
        if leads and script_of(text[k - 1]) in ("cjk", "arabic", "devanagari") and n.isalpha():
            return told
        return True

    def _thai_gap(self, text: str, i: int, b: int) -> bool:
        """A space after a Thai letter ends a sentence if Thai goes on, but not with an abbreviation, or if a word follows
        that starts sentences in a language of Latin script."""
        k = i
        while k < b and text[k].isspace():
            k += 1
        if k >= b:
            return False
        if script_of(text[k]) != "thai":
            w = next_word(text, k, b)
            return w.isalpha() and any((x, starter_form(w)) in self.starters for x in FUNCTION_WORDS)
        m = re.match(r"\S*", text[k:b]).group()
        return not re.match(r"(?:[^\W\d_]{1,2}\.)+", m)

    def cut(self, text: str) -> list[tuple[int, int]]:
        out: list[tuple[int, int]] = []
        spans = [(a, b) for a, b in paragraphs(text) if a < b and not text[a:b].isspace()]
        for (a, b), lang in zip(spans, languages(text, spans)):
            if text.find("\n", a, b) < 0 and text.find("\r", a, b) < 0:
                if any(_list_lines(text, [(a, b)])):
                    out.append((_SPACE.match(text, a, b).end(), a + len(text[a:b].rstrip())))
                else:
                    self.cut_run(text, a, b, lang, out)
                continue
            lines, at = [], a
            for m in _LINE.finditer(text, a, b):
                lines.append((at, m.start()))
                at = m.end()
            lines.append((at, b))
            item = _list_lines(text, lines)
            run = None
            for (s, e), is_item in zip(lines, item):
                if is_item:
                    if run is not None:
                        self.cut_run(text, run, prev, lang, out)
                        run = None
                    s2, e2 = s, e
                    while s2 < e2 and text[s2].isspace():
                        s2 += 1
                    while e2 > s2 and text[e2 - 1].isspace():
                        e2 -= 1
                    if e2 > s2:
                        out.append((s2, e2))
                else:
                    if run is None:
                        run = s
                    prev = e
            if run is not None:
                self.cut_run(text, run, prev, lang, out)
        return out


def _matching(text: str, a: int, b: int) -> dict[int, int]:
    """Places of quotation marks and brackets that have a partner in the paragraph, both ways."""
    stack: list[tuple[str, int]] = []
    got: dict[int, int] = {}
    for m in _PAIR.finditer(text, a, b):
        c, i = m.group(), m.start()
        for d in range(len(stack) - 1, -1, -1):
            if stack[d][0] == c:
                got[stack[d][1]], got[i] = i, stack[d][1]
                del stack[d:]
                break
        else:
            if c in PAIRS:
                stack.append((PAIRS[c], i))
    return got


def _list_lines(text: str, lines: list[tuple[int, int]]) -> list[bool]:
    """Which lines are list items: bullets of one kind on two lines or after a lead-in, or numbers counting from 1 or a."""
    marks: list[tuple[str, int] | None] = []
    for s, e in lines:
        if m := _BULLET.match(text, s, e):
            marks.append((m.group(1), 0))
        elif m := _NUMBER.match(text, s, e):
            n = m.group(1) or m.group(2) or m.group(3)
            style = "1." if m.group(1) else "(1)" if n.isdigit() else "(a)"
            marks.append((style, int(n) if n.isdigit() else ord(n) - 96))
        else:
            marks.append(None)
    item, i = [False] * len(lines), 0
    while i < len(lines):
        if marks[i] is None:
            i += 1
            continue
        j = i + 1
        while j < len(lines) and marks[j] is not None and marks[j][0] == marks[i][0] and (marks[i][1] == 0 or marks[j][1] == marks[j - 1][1] + 1):
            j += 1
        led = i > 0 and text[lines[i - 1][0] : lines[i - 1][1]].rstrip()[-1:] in (":", "：")
        if (marks[i][1] == 0 or marks[i][1] == 1) and (j - i > 1 or led or (i == 0 and len(lines) == 1)):
            item[i:j] = [True] * (j - i)
        i = j
    return item


class Asked:
    """Stands in for the parts of a model and notes what a cutter looks up; which lookups it makes does not depend on answers."""

    def __init__(self) -> None:
        self.keys: set[tuple[str, str]] = set()

    def __contains__(self, key: tuple[str, str]) -> bool:
        self.keys.add(key)
        return False

    def get(self, key: tuple[str, str]) -> None:
        self.keys.add(key)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h1, h2, lang, word) that the texts look up, each once per text."""
    for b in batches:
        rows = []
        for h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("h1", "h2", "text"))):
            asked = Asked()
            Cutter(asked, asked).cut(text)
            rows += [(h1, h2, *k) for k in asked.keys]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["h1", "h2", "lang", "word"])


def sentences(documents: DataFrame, with_text: bool = True, model_limit: int = MODEL_LIMIT) -> DataFrame:
    """(doc_id, start_char, end_char[, sentence]) of every unit of every text; end exclusive, without surrounding white
    space. documents: doc_id, text."""
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null and text <> ''")
    counts = materialize(counted(docs), "sentence-counts")
    starters = materialize(learn_starters(counts), "sentence-starters")
    model = starters.select("lang", "word", F.lit(True).alias("starts"), F.lit(None).cast("array<double>").alias("seen"))
    model = model.unionByName(learn_types(counts, starters).withColumn("starts", F.lit(False)))
    model = materialize(model, "sentence-model")
    if model.count() <= model_limit:
        rows = model.collect()
        known = docs.sparkSession.sparkContext.broadcast((frozenset((r.lang, r.word) for r in rows if r.starts), {(r.lang, r.word): tuple(r.seen) for r in rows if not r.starts}))
        docs = docs.withColumn("own", F.lit(None).cast("array<struct<lang:string,word:string,starts:boolean,seen:array<double>>>"))
    else:
        known, mark = None, [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")]
        asked = docs.select(*mark, "text").mapInArrow(_asked, "h1 bigint, h2 bigint, lang string, word string").distinct()
        own = asked.join(model, ["lang", "word"]).groupBy("h1", "h2").agg(F.collect_list(F.struct("lang", "word", "starts", "seen")).alias("own"))
        docs = docs.select("*", *mark).join(own, ["h1", "h2"], "left").select("doc_id", "text", "own")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "start_char", "end_char", *(["sentence"] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(*known.value) if known else None
        for b in batches:
            at, units, shown = [], [], []
            for k, (text, own) in enumerate(zip(b.column("text").to_pylist(), b.column("own").to_pylist())):
                if not known:
                    cutter = Cutter({(r["lang"], r["word"]) for r in own or () if r["starts"]}, {(r["lang"], r["word"]): tuple(r["seen"]) for r in own or () if not r["starts"]})
                got = cutter.cut(text)
                at += [k] * len(got)
                units += got
                if with_text:
                    shown += [text[s:e] for s, e in got]
            places = np.array(units, np.int64).reshape(-1, 2)
            cols = [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(places[:, 0]), pa.array(places[:, 1]), *([pa.array(shown, pa.string())] if with_text else [])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, f"doc_id {id_type}, start_char bigint, end_char bigint{', sentence string' if with_text else ''}")
