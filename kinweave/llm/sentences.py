"""Sentences of texts in many languages and scripts, by cascading tables of break and no-break rules.

A text is cut at blank lines and before list marks. Inside such a block every place where a sentence could end meets the
rules of the block's language, then those for all languages; the first rule whose two patterns match (text before, text
after) decides. Places inside quotations and brackets are no candidates.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame

# Abbreviations after which no sentence ends, by language, and for all languages.
ABBREVIATIONS = {
    "en": "Mr Mrs Ms Messrs Dr Prof Rev Hon St Mt Gen Col Capt Lt Sgt Gov Sen Rep vs approx no nos p pp fig ch sec vol ed eds cf e.g i.e al dept est ext tel re",
    "de": "Hr Hrn Fr Frl Dr Prof Mag Dipl Ing Nr Abs Art Bd Kap S z d u o ca bzw vgl Mio Mrd Tsd Std Min evtl ggf inkl exkl zzgl z.B d.h u.a Str Tel St",
    "fr": "M MM Mme Mmes Mlle Dr Pr Me St Ste p pp art env cf ex p.ex n no vol chap fig éd tél av bd",
    "es": "Sr Sra Srta Sres Dr Dra D Dña Prof Profa pág págs p pp núm núms aprox art cap vol fig tel EE Ud Uds Vd av avda ej p.ej",
    "hi": "डॉ श्री प्रो सु कु पं",
    "ar": "د أ م ص ج",
    "": "Mr Mrs Ms Dr Prof Mag St Hr Sr Sra Srta Dra Mme M vs approx cf p pp no Nr art aprox env ca Abs Mio Mrd z d EE núm pág págs bzw e.g i.e",
}
# Months whose abbreviation stands before a day.
MONTH_ABBREVIATIONS = "Jan Feb Mar Apr Jun Jul Aug Sept Sep Oct Nov Dec Jän Mrz Okt Dez janv févr avr juil sept oct nov déc ene feb mar abr may jun jul ago dic"
# Frequent words by which the language of a block is told.
FREQUENT = {
    "en": "the of and to in is was for with on at by from that this it he she we they will had has have asked not then since before up about",
    "de": "der die das und ist war mit von für bei den dem des ein eine nicht wir sich auf am im bis zum zur sind kommt hat wer wie laut siehe aus als wegen",
    "fr": "le la les des du de et est une un au aux avec pour sur nous vous dans que qui en par pas ce cette encore a à",
    "es": "el la los las del de y es una un con por para sobre en que se no al lo este esta antes quién ha sin",
}

OPENING = {"(": ")", "[": "]", "（": "）", "［": "］", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»", "“": "”", "„": "“”", "‹": "›", '"': '"'}
_CLOSERS = r"[\"”“»’)\]）］」』】》›]"
_END = r"[.!?…。！？।॥؟۔｡]"
_CJK = r"぀-ヿ㐀-鿿豈-﫿"

_BLANK_LINE = re.compile(r"\n[^\S\n]*(?:\n[^\S\n]*)+|\r[^\S\r\n]*\r(?!\n)[^\S\n]*")
_LIST_MARK = re.compile(r"(?:[-*•‣·▪–—+]|\(?\d{1,3}[.)]|[a-zA-Z]\))(?=[^\S\n]+\S)")
# an end to which the next sentence was joined without a blank: "the pilot.Their office", but neither "v1.2" nor "a.Name@x.org"
_JOINED = rf"(?:(?<=[^\W\d_A-ZÀ-Þ]|[\d)%”»])\.|(?<![!?])[!?]++|[।؟]){_CLOSERS}*+(?=[\"“„«(¿¡]*[A-ZÀ-ÞĀ-Ž\u0900-\u097f\u0600-\u06ff][^\W_]*(?:[\s,’'-]|$))"
# runs are taken whole and only from their start, so that a text of nothing but stops or blanks is read once
_CANDIDATE = rf"(?<!{_END}){_END}++(?:[^\S\n]?(?=[»]))?{_CLOSERS}*+(?=\s|$)|[。！？｡]++{_CLOSERS}*+|(?<![!?…])[!?…]++{_CLOSERS}*+(?=[{_CJK}])|{_JOINED}"
_ENDS, _PLACES = re.compile(_END), re.compile(_CANDIDATE)
#: Where sentences are divided by blanks alone, these are places too.
_PLACES_AND_BLANKS = re.compile(rf"{_CANDIDATE}|\s++(?=\S)")
_RUN = frozenset(".!?…。！？।॥؟۔｡\"”“»’)]）］」』】》›-*•‣·▪–—+# \t\r\u00a0\u3000")
#: The longest abbreviation or number that a rule asks for before a place, with the sign in front of it.
_REACH = 24


def _words(text: str) -> str:
    return "|".join(re.escape(w) for w in sorted(text.split(), key=len, reverse=True))


def _rule(breaks: bool, before: str, after: str) -> tuple[bool, re.Pattern, re.Pattern]:
    return breaks, re.compile(rf"(?:{before})\Z"), re.compile(after)


def _abbreviated(lang: str) -> tuple[bool, re.Pattern, re.Pattern]:
    return _rule(False, rf"(?<![^\W_])(?:{_words(ABBREVIATIONS[lang])})\.", r"\s")


_MONTH_DAY = _rule(False, rf"(?<![^\W_])(?:{_words(MONTH_ABBREVIATIONS)})\.", r"\s+\d")
#: Rules of each language, in order; COMMON follows them.
RULES = {
    "en": [_abbreviated("en"), _MONTH_DAY],
    "de": [_abbreviated("de"), _rule(False, r"(?:^|[\s(„“])\d{1,2}\.", r"\s+[^\W\d_]"), _MONTH_DAY],
    "fr": [_abbreviated("fr"), _MONTH_DAY],
    "es": [_abbreviated("es"), _MONTH_DAY],
    "hi": [_abbreviated("hi")],
    "ar": [_abbreviated("ar")],
    # a closing quote or bracket goes on with what follows; a double ellipsis is a pause
    "zh": [_rule(False, rf"{_END}{_CLOSERS}++", r"\s*\S"), _rule(False, "…", r"\S"), _rule(True, "[。！？｡!?]", "")],
    "ja": [_rule(False, rf"{_END}{_CLOSERS}++", r"\s*\S"), _rule(False, "…", r"\S"), _rule(True, "[。！？｡!?]", "")],
    # only blanks divide, and not beside a digit, a Latin letter, a sign of repetition or a mark at the start of a line
    "th": [
        _rule(False, r"[0-9๐-๙A-Za-zÀ-ɏๆ]", r"\s"),
        _rule(False, r"", r"\s+[0-9๐-๙A-Za-zÀ-ɏๆ]"),
        _rule(False, r"(?:^|\n)[^\S\n]*(?:[-*•‣·▪–—+#]++|\(?\d{1,3}[.)])", r"\s"),
        _rule(True, r"\S", r"\s"),
    ],
}
COMMON = [
    _rule(False, r"[^.!?…。！？।॥؟۔｡\"”“»’)\]）］」』】》›]", r"\s"),
    _rule(False, r"(?:\.|…)[\"”“»’)\]]*", r"\s+[\"“«„(]?\s?[a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľńņňōőœŕřśşšťūůűųźżž]"),
    _rule(False, rf"{_END}[^\S\n]?{_CLOSERS}++", r"\s+[a-zß-öø-ÿāăąćčďđēėęěğģīįıķĺļľńņňōőœŕřśşšťūůűųźżž]"),
    _rule(False, r"(?<![^\W_])[^\W\d_a-zа-я]\.", r"\s+[^\W\d_]"),
    _abbreviated(""),
    _MONTH_DAY,
    _rule(True, rf"{_END}[^\S\n]?{_CLOSERS}*+", r"\s|$|[\"“„«(¿¡]*[^\W\d_]"),
]

_SCRIPTS = [("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[㐀-鿿]"))]
_ANY_SCRIPT = re.compile("[฀-๿ऀ-ॿ؀-ۿ぀-ヿ㐀-鿿]")
_LANGUAGES_OF = {w: [lang for lang, words in FREQUENT.items() if w in words.split()] for words in FREQUENT.values() for w in words.split()}
_LETTER, _WORD = re.compile(r"[^\W\d_]"), re.compile(r"[^\W\d_]+")


def language_of(block: str, named: str) -> str:
    """The language of a block: by script, else by its frequent words, else what the document is named."""
    if not block.isascii() and _ANY_SCRIPT.search(block):
        counts = [(len(p.findall(block)), lang) for lang, p in _SCRIPTS]
        best, lang = max(counts)
        kana = counts[3][0]
        if best and best * 5 >= len(_LETTER.findall(block)) - best or best >= 12:
            return "ja" if lang in ("zh", "ja") and (kana * 8 >= best or (kana == 0 and named == "ja")) else lang
    score = dict.fromkeys(FREQUENT, 0)
    for w in _WORD.findall(block.lower()):
        for lang in _LANGUAGES_OF.get(w, ()):
            score[lang] += 1
    best, _, lang = max((n, lang == named, lang) for lang, n in score.items())
    return lang if best else named


_MARKS = re.compile("[" + re.escape("".join(OPENING) + "".join(OPENING.values())) + "]")


def _protected(block: str) -> list[tuple[int, int]]:
    """Spans of quotations and brackets, outermost ones, in order; an opening mark that is never closed opens nothing.

    Brackets close by depth of their own kind, quotations at the next closing mark. One pass finds where each closes.
    """
    places: dict[str, list[int]] = {}
    marks = [(m.start(), m.group()) for m in _MARKS.finditer(block)]
    open_at: dict[str, list[int]] = {mark: [] for mark in "([（［"}
    closed_at: dict[int, int] = {}
    closing = {OPENING[mark]: mark for mark in open_at}
    for at, mark in marks:
        places.setdefault(mark, []).append(at)
        if mark in open_at:
            open_at[mark].append(at)
        elif mark in closing and open_at[closing[mark]]:
            closed_at[open_at[closing[mark]].pop()] = at
    spans, past = [], 0
    for at, mark in marks:
        if at < past or mark not in OPENING:
            continue
        if mark in open_at:
            end = closed_at.get(at, -1)
        else:
            found = [p[k] for c in OPENING[mark] if (p := places.get(c)) and (k := bisect_left(p, at + 1)) < len(p)]
            end = min(found, default=-1)
        if end >= 0:
            spans.append((at, end + 1))
            past = end + 1
    return spans


def _blocks(text: str) -> list[tuple[int, int]]:
    """Spans between blank lines, cut before each line that opens with a list mark."""
    out, edges = [], [0]
    for m in _BLANK_LINE.finditer(text):
        edges += [m.start(), m.end()]
    edges.append(len(text))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        start, line, item = a, a, None
        while line < b:
            end = text.find("\n", line, b)
            end = b if end < 0 else end
            lead = len(text[line:end]) - len(text[line:end].lstrip())
            if m := _LIST_MARK.match(text, line + lead, end):
                number = re.search(r"\d+", m.group())
                number = int(number.group()) if number else None
                back = line - 1
                while back >= a and text[back].isspace():
                    back -= 1
                ended = back < a or text[back] in ".:!?…;。：！？।"
                # a number at the start of a wrapped line goes on with the sentence
                if line == a or number is None or item == number - 1 or (number == 1 and ended):
                    if line > start:
                        out.append((start, line))
                    start, item = line, number if number is not None else item
            line = end + 1
        out.append((start, b))
    return out


def _places(block: str, first: int, last: int):
    """Matches of _PLACES: each begins with a sign that can end a sentence, which is looked for first."""
    while m := _ENDS.search(block, first, last):
        if found := _PLACES.match(block, m.start(), last):
            yield found
        first = found.end() if found else m.end()


def sentence_spans(text: str, named: str = "") -> list[tuple[int, int]]:
    """(start, end) of each sentence in code points, end exclusive, without outer white space."""
    out = []
    for a, b in _blocks(text):
        block = text[a:b]
        if not block.strip():
            continue
        lang = language_of(block, named)
        rules = RULES.get(lang, []) + COMMON
        spans = _protected(block)
        begin = len(block) - len(block.lstrip())
        mark = _LIST_MARK.match(block, begin)
        start, k, first = 0, 0, mark.end() if mark else begin
        last = max(first, len(block.rstrip()))
        for m in _PLACES_AND_BLANKS.finditer(block, first, last) if lang == "th" else _places(block, first, last):
            pos = m.start() if m.group().isspace() else m.end()
            while k < len(spans) and spans[k][1] < pos:
                k += 1
            if k < len(spans) and spans[k][0] < pos < spans[k][1]:
                continue
            run = pos
            while run > 0 and block[run - 1] in _RUN:
                run -= 1
            before = block[max(0, run - _REACH) : pos]
            for breaks, left, right in rules:
                if right.match(block, pos) and left.search(before):
                    if breaks:
                        out.append((a + start, a + pos))
                        start = pos
                    break
        out.append((a + start, b))
    trimmed = []
    for x, y in out:
        piece = text[x:y]
        body = piece.strip()
        if body:
            lead = len(piece) - len(piece.lstrip())
            trimmed.append((x + lead, x + lead + len(body)))
    return trimmed


def document_sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, sent_start, sent_end): one row per sentence of each document with a text; offsets in code points.

    Null, empty and blank texts have no sentences; repeated documents each have theirs. The language named (lang, in any
    case, with or without a region) only helps where script and words do not tell; columns other than doc_id, text and
    lang are ignored.
    """

    def cut(batches):
        for batch in batches:
            rows = []
            for doc, text, lang in zip(batch["doc_id"], batch["text"], batch["lang"], strict=True):
                rows += [(doc, x, y) for x, y in sentence_spans(text, (lang or "").strip().lower()[:2])]
            yield pd.DataFrame(rows, columns=["doc_id", "sent_start", "sent_end"]).astype("int64")

    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    return rows.mapInPandas(cut, "doc_id long, sent_start long, sent_end long")
