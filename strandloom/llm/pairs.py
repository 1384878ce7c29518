"""Defective question-answer pairs: noisy labelling functions per defect, combined by an EM label model.

Each labelling function votes yes, no or nothing on one defect of one pair. Two of them need statistics of the whole corpus
of answers (whether its language breaks off where this answer does, whether its last word is a word), which are counted
with map-side combining and joined back. For each defect the votes of all pairs are reduced to counts of vote patterns, of
which there are at most three to the number of functions whatever the data's size; expectation maximisation over them
estimates each function's rates and the defect's share, and gives every pattern a posterior. A pair keeps every label whose
posterior exceeds the defect's cutoff.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

YES, NO, NONE = 1, 0, -1

#: Frequent function words by language.
FUNCTION_WORDS = {
    "en": "the of and in is was were are it its that this which who whom by with from for to has have had not be been as at on an a there their they both yes no according since although but so into through does do did what where when how i you",
    "fr": "le la les l du des d un une et est a été sont était il elle ce cet cette qui que qu dans pour par avec sur au aux se s ne pas n après depuis selon son sa ses leur où quand oui non mais donc y en c dont tous deux je vous nous quel quelle quels quelles année t",
    "de": "der die das den dem des ein eine einen einem einer und ist war wurde sind waren es er sie nicht im in von vom zu zum zur mit auf für nach bei aus als dass daß doch aber ja nein heute beide über durch wird hat dieses dieser diese am an ich darauf keine kein wer was wo wohin wann man muss welche welcher welches welchem welchen",
    "es": "el la los las un una y es fue son era está de del al que en por con para se no su sus lo le según entre esa ese esta este sí pero cuyo después desde ambos ha han sido a como dónde cuándo hay yo ninguno ninguna quién quiénes cuál cuáles qué año",
    "it": "il lo la i gli le un uno una e è fu sono era del della dello dei degli delle di da dal dalla nel nella che si non per con su al alla questo questa entrambi sì no ma dopo secondo suo sua stato stata ha anno chi quale quali dove quando",
    "pt": "o a os as um uma e é foi são era do da dos das de em no na nos nas que se não por com para ao à seu sua este esta ambos sim mas depois segundo pelo pela quem qual quais onde quando",
    "nl": "de het een en is was werd zijn van in op met voor door niet dat die dit deze er ook maar naar bij uit beide ja nee na volgens wordt heeft",
    "pl": "i w na z ze jest był była było to nie do się od po przez oraz który która oba tak ale",
}
#: Words that alone answer a yes-or-no question.
YES_WORDS = {"en": {"yes"}, "fr": {"oui"}, "de": {"ja"}, "es": {"sí", "si"}, "it": {"sì"}, "pt": {"sim"}, "ru": {"да"}}
NO_WORDS = {"no", "non", "nein", "нет", "não", "nee"}
#: Labels that stand before an answer.
LABEL = r"(?:final\s+answer|short\s+answer|answer|response|reply|réponse(?:\s+finale)?|antwort|respuesta(?:\s+final)?|risposta|ответ|output|result|a)"

_FENCE = re.compile(r"```[\w-]*\s*|~~~[\w-]*\s*")
_TAG = re.compile(r"<[^<>]{0,40}>")
_LABEL = re.compile(rf"^[\W_]*{LABEL}\s*[:：=][\s*_]*", re.I)
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"|\([^()]*\)|\[[^\[\]]*\]")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")

_REFUSAL = re.compile(
    r"insufficient|not enough (?:information|context|evidence)|no (?:information|answer|evidence|mention)\b|(?:does|do|did) not (?:contain|mention|provide|say|state|give|include|specify|answer|allow|permit)|doesn't|don't (?:know|have)|do not know"
    r"|can(?:not|'t|’t| not) (?:be (?:determined|answered|established|found|fully)|answer|help|determine|say|tell|respond|discuss|provide|assist|share|comment|find)|(?:unable|not able) to|(?:must|have to) decline|decline to|not (?:mentioned|specified|stated|given|provided|available)|outside what|beyond what|silent on|nothing in the (?:passage|context|text|material)|language model|no access to|(?:could|would) not (?:find|determine)|unanswerable|unknown|rather not|prefer not|not speculate|not in a position|no way to (?:know|tell|say)|impossible to|will not (?:answer|discuss)|won't (?:answer|be able)|not allowed to|lacks? (?:the|any) (?:information|detail|answer)"
    r"|ne (?:contient|contiennent|mentionne|mentionnent|permet|permettent|précise|dit|sait|sais|peux|peut|donne)|n'(?:apporte|apportent|ai pas|est pas (?:possible|mentionné|précisé|indiqué))|n’(?:apporte|ai)|je ne (?:sais|peux)|aucun(?:e)? (?:information|réponse|passage|des passages)|information(?:s)? (?:insuffisante|manquante)|impossible de|dépasse ce dont|désolé|pas pu|contexte insuffisant|je n['’]ai pas|pas en mesure|ne figure|ne suis pas|il n['’]y a (?:pas|aucun)|préfère ne pas|sans réponse"
    r"|(?:nicht|keine|kein|schweigen|unzureichend|leider).{0,40}(?:antwort|information|angabe|beantwort|helfen|bekannt|ermitteln|sagen|genannt|erwähnt|hervor|finden|bestimmen|weiß)|weiß ich nicht|(?:antwort|information|angabe|hinweis)\w* .{0,20}(?:nicht|keine|fehl)|schweigen|gibt darauf keine|geht .{0,40}nicht hervor|konnten .{0,60}nicht|unzureichend|keine antwort|nicht möglich|unmöglich|lieber nicht|darf ich nicht|ist unbekannt"
    r"|no (?:contiene|contienen|menciona|mencionan|dice|dicen|permite|permiten|puedo|sé|se sabe|se puede|se indica|hay|tengo|pudieron|da|dan)|ningun[oa]? .{0,30}(?:respuesta|información|pasaje)|información insuficiente|insuficiente|lo siento|supera lo que|ninguno de los|no dispongo|no es posible|no consta|no figura|no est[áo]|desconozco|prefiero no|imposible|sin (?:datos|información)"
    r"|non (?:contiene|so|posso|è possibile|menziona)|informazioni insufficienti|не (?:содерж|знаю|могу|упомина)|недостаточно",
    re.I,
)
_POLITE = re.compile(r"\b(?:sorry|unfortunately|afraid|thank you for asking|thanks for asking|anything else|consult|apologi[sz]e|as an? (?:ai|language|assistant)|could you (?:provide|please)|désolé|malheureusement|merci|leider|tut mir leid|bedaure|lo siento|lamentablemente|desgraciadamente|gracias por|mi dispiace|purtroppo|к сожалению)\b", re.I)
_TURN = re.compile(r"(?:\bbut\b|\bso\b|\bhowever\b|\byet\b|\balthough\b|\bmais\b|\bdonc\b|\baber\b|\bdoch\b|\bsodass\b|\bpero\b|\baunque\b|\bma\b|[;:])", re.I)
_COURTESY = re.compile(r"could you (?:please )?provide[^?]*\?|is there anything else[^?]*\?|please consult[^.]*\.", re.I)
_ASKED = re.compile(r"(?:your question|the question|you asked|question|votre question|la question|vous avez demandé|ihre frage|die frage|sie fragten|du fragst|su pregunta|la pregunta|usted preguntó|preguntaste|pregunta|frage|q)\b[^\w«“\"¿]*(?:is|was|est|ist|es|lautet|:)?", re.I)


def unwrap(answer: str | None) -> str:
    """The content of an answer: without code fences, tags, JSON wrapper and label; empty if there is none."""
    if answer is None:
        return ""
    t = _FENCE.sub("", answer).strip().strip("​﻿")
    for _ in range(3):
        if t[:1] in "{[\"" and t:
            try:
                t = _flat(json.loads(t))
            except (ValueError, RecursionError):
                m = re.match(r"^\{\s*\"[^\"]{0,40}\"\s*:\s*\"?", t)  # a wrapper that breaks off
                t = t[m.end() :] if m else t
                break
        else:
            break
    if t.strip() in ("null", "None"):
        return ""
    t = _LABEL.sub("", _TAG.sub(" ", t)).strip()
    return t if any(c.isalnum() for c in t) else ""


def _flat(x) -> str:
    if isinstance(x, dict):
        return " ".join(filter(None, map(_flat, x.values())))
    if isinstance(x, list):
        return " ".join(filter(None, map(_flat, x)))
    return "" if x is None else str(x)


_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in FUNCTION_WORDS.items():
    for _w in set(_words.split()):
        _BY_WORD.setdefault(_w, []).append(_lang)


def language(text: str) -> tuple[str | None, float]:
    """The language of the function words outside quotes and brackets, and its lead; None where names leave nothing to tell."""
    t = _QUOTED.sub(" ", text)
    letters = [c for c in t if c.isalpha()]
    if letters and sum("Ѐ" <= c <= "ӿ" for c in letters) > 0.4 * len(letters):
        return "ru", 9.0
    score: dict[str, float] = {}
    for s in _SENTENCE.split(t):
        for k, w in enumerate(x for part in _WORD.findall(s) for x in re.split(r"['’]", part)):
            if w[:1].isupper() and k and not w.isupper():
                continue
            langs = _BY_WORD.get(w.lower(), ())
            for lang in langs:
                score[lang] = score.get(lang, 0) + 1 / len(langs)
    if "¿" in t or "¡" in t:
        score["es"] = score.get("es", 0) + 3
    if not score:
        return None, 0.0
    (best, top), *rest = sorted(score.items(), key=lambda kv: (-kv[1], kv[0]))
    return best, top - (rest[0][1] if rest else 0)


_SPECIAL = {"de": "ßäöü", "fr": "èêàçùœûîô", "es": "ñ¿¡íóú", "it": "ìò", "pl": "łąęśżź"}


def _diacritics(text: str) -> str | None:
    low = "".join(w for w in _WORD.findall(_QUOTED.sub(" ", text)) if w[:1].islower())
    found = {lang: sum(low.count(c) for c in chars) for lang, chars in _SPECIAL.items()}
    best = max(found, key=found.get)
    return best if found[best] and sum(v == found[best] for v in found.values()) == 1 else None


def _key(text: str) -> list[str]:
    return [w.casefold() for w in _WORD.findall(text)]


def _masked(sentence: str) -> list[str]:
    """Words with names as N and numbers as 9; neighbouring names are one."""
    out = ["<s>"]
    for k, w in enumerate(_WORD.findall(sentence)):
        m = "9" if w[0].isdigit() else "N" if w[0].isupper() and (k or w.casefold() not in _BY_WORD) else w.casefold()
        if not (m == "N" and out[-1] == "N"):
            out.append(m)
    return out


_ANSWERS = {w for s in YES_WORDS.values() for w in s} | NO_WORDS
#: Words after which a statement goes on: the function words but those that may end one.
_OPEN_WORDS = ({w for lang in ("en", "fr", "de", "es", "it") for w in FUNCTION_WORDS[lang].split()} | set("whose into moreover dessen deren cuyo cuya cuyos cui sowie und unter près chez sous sobre hacia presso".split())) - _ANSWERS - set("not so there i you it lo le la both deux beide ambos entrambi heute do does did anno hat ist war wird waren sind wurde was e lui sie es er il he they been done".split()) | set("la le".split())


def votes(query: str, context: str, answer: str | None) -> dict[str, list[int]]:
    """The local votes on each defect; the two functions that need corpus statistics come later."""
    raw, q, c = answer or "", query or "", context or ""
    text = unwrap(answer)
    qk, ak = _key(q), _key(text)
    qs, cs = set(qk), set(_key(c))
    # Tokens that could be an answer: names and numbers of the answer that the question lacks, or a yes.
    extra = [w for s in _SENTENCE.split(text) for n, ws in [(0, _WORD.findall(s))] for n, w in enumerate(ws) if w.casefold() not in qs and (n or len(ws) <= 3 or ws[1][:1].isupper() or w[0].isdigit() or len(w) < 4)]
    yes = {w for s in YES_WORDS.values() for w in s}
    content = [w for w in extra if (w[0].isdigit() or (w[0].isupper() and w.casefold() in cs and w.casefold() not in _BY_WORD)) or w.casefold() in yes]

    # Each function looks at something else: what is left of the answer, and whether it speaks of the same things.
    empty = [YES if not text else NO, NO if any(w in qs or w in cs for w in ak) else NONE]

    # The wording, what the answer names, its manners, how it ends, and its length.
    clause = _TURN.split(text)[-1]
    refusal = [
        YES if _REFUSAL.search(text) else NO,
        NO if content else YES if len(ak) > 2 else NONE,
        YES if _POLITE.search(text) else NONE,
        NO if clause != text and re.search(r"[A-ZÀ-Þ0-9]", clause.strip()[1:]) and not _REFUSAL.search(clause) else NONE,
        NO if 0 < len(ak) <= 3 else NONE,
    ]

    bare = _ASKED.sub(" ", _COURTESY.sub(" ", text))
    bk = _key(bare)
    inside = sum(w in qs for w in bk) / len(bk) if bk else 0.0
    cover = len(qs & set(ak)) / len(qs) if qs else 0.0
    grams = lambda ws: {" ".join(ws)[i : i + 4] for i in range(max(1, len(" ".join(ws)) - 3))}
    qg, bg = grams(qk), grams(bk)
    alike = len(qg & bg) / max(1, len(bg)) if bk else 0.0
    again = len(qg & bg) / max(1, len(qg)) if bk else 0.0
    # What the answer adds to the question: a name of the context, a number, a yes or no.
    said = _WORD.findall(re.sub(r"^\s*\d+[.)]\s+", "", bare))
    fresh = [w.casefold() not in qs and w[0].isupper() and w.casefold() not in _BY_WORD for w in said]
    adds = any(w.casefold() not in qs and (w[0].isdigit() or w.casefold() in yes | NO_WORDS or (f and w.casefold() in cs)) for w, f in zip(said, fresh))
    adds = adds or any(a and b for a, b in zip(fresh, fresh[1:]))  # a name of two words, wherever it is from
    tail = text.rstrip().rstrip("»”\"').").rstrip()
    copied = [
        YES if cover >= 0.7 and inside >= 0.7 and again >= 0.5 and not adds else NO,
        YES if again >= 0.65 and alike >= 0.65 and not adds else NO if again < 0.4 or adds else NONE,
        NO if adds else NONE,
        YES if tail.endswith("?") and cover >= 0.5 and not adds else NONE,
    ]

    ql, sure = language(q)
    ql = ql if sure > 0 else None
    al, lead = language(text)
    special = _diacritics(text)
    short_yes = next((lang for lang, s in YES_WORDS.items() if ak and ak[0] in s), None)
    other = [
        NONE if al is None or ql is None or lead <= 0 else NO if al == ql else YES if lead >= 1 else NONE,
        NONE if ql is None or special is None or al is None else NO if special == ql else YES if al != ql else NONE,
        NONE if al is None or ql is None else YES if al != ql and lead >= 2 else NO if al == ql and lead >= 1 else NONE,
        NONE if short_yes is None or ql is None else NO if short_yes == ql else YES if len(ak) == 1 or al == short_yes else NONE,
        NO if not ak or al is None and special is None and short_yes is None else NONE,
    ]

    end = raw.rstrip().rstrip("*_ \n")
    words = _WORD.findall(text)
    last = words[-1] if words else ""
    opened = sum(end.count(a) - end.count(b) for a, b in (("(", ")"), ("[", "]"), ("{", "}"), ("«", "»"), ("“", "”"))) > 0 or end.count('"') % 2 == 1 or raw.count("```") % 2 == 1
    listed = bool(re.search(r"\n\s*\d{1,2}[.)]$", end))  # an item of a list that has only its number
    stop = not listed and bool(re.search(r"[.!?…。][\"'”’»)\]}*]*$", end))
    follow = NONE
    if last[:1].isupper() and last not in ("",):
        seen = re.findall(rf"(?<!\w){re.escape(last)}(?!\w)(\s+[^\W\d_a-zß-öø-ÿ]?)?", c) if last in c else []
        if seen:
            follow = YES if all(x and x.strip() for x in seen) else NO
    prefix = NONE
    if last and not last[0].isdigit():
        known = last.casefold() in cs or last.casefold() in qs
        prefix = NO if known else YES if any(w.startswith(last.casefold()) for w in cs | qs) and last.casefold() not in _BY_WORD else NONE
    truncated = [
        YES if opened or listed else NONE,
        YES if words and not stop and (re.search(r"[,;:\-–—/&(«“]$", end) or (len(words) > 1 and last.casefold() in _OPEN_WORDS)) else NONE,
        NO if stop and not opened else NONE,
        NONE if stop else follow,
        NO if not words else NONE,
        NONE if stop or last.casefold() in _BY_WORD else prefix,  # not a vote yet: see label_pairs
    ]
    return {"empty": empty, "refusal": refusal, "copied_question": copied, "other_language": other, "truncated": truncated}


def _number(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def grams_of(answer: str | None) -> tuple[list[int], list[bool], int | None, int | None, bool]:
    """(keys of every n-gram and every word, which of them end a sentence; the keys of the last n-gram and the last word, if
    there are any; whether the last word begins with a digit). Keys are 64-bit hashes, whatever the length of a word."""
    text = unwrap(answer)
    keys, ends, last_gram, last_word, numeral = [], [], None, None, False
    parts = [s for s in _SENTENCE.split(text) if _WORD.search(s)]
    for n, s in enumerate(parts):
        m = _masked(s)
        final = n == len(parts) - 1
        for i in range(1, len(m)):
            keys.append(_number("g " + " ".join(m[max(0, i - 2) : i + 1])))
            ends.append(i == len(m) - 1)
        if final and len(m) > 1:
            last_gram = keys[-1]
        words = [w.casefold() for w in _WORD.findall(s)]
        for w in words[:-1] if final else words:
            keys.append(_number("w " + w))
            ends.append(False)
        if final:
            last_word, numeral = _number("w " + words[-1]), words[-1][0].isdigit()
    return keys, ends, last_gram, last_word, numeral


DEFECTS = ("empty", "refusal", "copied_question", "other_language", "truncated")
#: Posteriors above which a label is kept; validated on the planted fixture of the tests.
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copied_question": 0.5, "other_language": 0.5, "truncated": 0.4}


#: (P(yes | defect), P(no | defect), P(yes | no defect)) that a function is believed to have at first; DEFAULT_TRUST where
#: not given. Each sign of a break covers only some breaks; few refusals are polite, and other answers name nothing either.
TRUST = {"refusal": {1: (0.7, 0.05, 0.2), 2: (0.3, 0.02, 0.01), 3: (0.05, 0.05, 0.02), 4: (0.05, 0.05, 0.02)}, "truncated": {0: (0.35, 0.05, 0.002), 1: (0.35, 0.05, 0.002), 2: (0.05, 0.02, 0.02), 3: (0.3, 0.25, 0.05), 4: (0.1, 0.02, 0.02), 5: (0.35, 0.2, 0.12), 6: (0.35, 0.05, 0.004)}}
DEFAULT_TRUST = (0.75, 0.05, 0.02)


def em(patterns: Sequence[Sequence[int]], counts: Sequence[int], trust: dict[int, tuple[float, float, float]] | None = None, *, steps: int = 200, belief: float = 0.1) -> tuple[np.ndarray, dict]:
    """The posterior of each vote pattern, and the estimates, by EM of independent functions given the defect.

    Each function's rates start from its being right in most of its votes, and that belief keeps the weight of ``belief``
    times all pairs, so that a defect that is rare or absent in the data cannot swap its meaning.
    """
    v, n = np.asarray(patterns, int), np.asarray(counts, float)
    if not len(v):
        return np.zeros(0), {}
    m = v.shape[1]
    believed = np.empty((2, m, 3))  # P(none), P(no), P(yes) of each function, with the defect and without
    for f in range(m):
        hit, miss, false = (trust or {}).get(f, DEFAULT_TRUST)
        believed[0, f] = 1 - hit - miss, miss, hit
        believed[1, f] = 0.6 - false, 0.4, false
    strength = max(20.0, belief * n.sum())
    used = np.stack([(v == k) for k in (NONE, NO, YES)], axis=2)  # pattern x function x vote
    for j in range(m):  # a vote that a function never gives says nothing
        for k in range(3):
            if not (used[:, j, k] * n).sum():
                believed[:, j, k] = 1e-3
    believed /= believed.sum(axis=2, keepdims=True)
    rate, share = believed.copy(), 0.05
    post = np.zeros(len(v))
    for _ in range(steps):
        logs = [np.log(np.maximum(rate[y][None] * used, 1e-300).max(axis=2)).sum(axis=1) for y in range(2)]
        yes, no = logs[0] + np.log(share), logs[1] + np.log(1 - share)
        new = 1 / (1 + np.exp(np.clip(no - yes, -500, 500)))
        done = np.abs(new - post).max() < 1e-9
        post = new
        for y, w in enumerate((post * n, (1 - post) * n)):
            seen = (w[:, None, None] * used).sum(axis=0) + strength * believed[y]
            rate[y] = seen / seen.sum(axis=1, keepdims=True)
        share = float(np.clip((post @ n + 1) / (n.sum() + 20), 1e-4, 0.5))
        if done:
            break
    return post, {"share": share, "rate": rate}


def look_up(rows: DataFrame, key: str, stats: DataFrame, count: str, spread: Sequence[str], most: int = 512) -> DataFrame:
    """``rows`` with the columns that ``stats`` (key, a count, and others) has for their ``key``, null where it has none.

    Keys that hold more than a ``most``-th of all counted, of which there are fewer than ``most``, are broadcast. Only rows
    of other keys meet theirs in a shuffle; rows that need none are spread by the columns ``spread``.
    """
    names = [c for c in stats.columns if c != "key"]
    total = stats.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    hot = stats.where(F.col(count) * most > total).select(F.col("key").alias(key), *(F.col(c).alias(f"__{c}") for c in names))
    r = rows.join(F.broadcast(hot), key, "left")
    settled = F.col(key).isNull() | F.col(f"__{count}").isNotNull()
    r = r.withColumn("__kind", F.when(settled, 0).otherwise(1)).withColumn("__at", F.when(settled, F.xxhash64(*spread)).otherwise(F.col(key)))
    cold = stats.where(F.col(count) * most <= total).select(F.lit(1).alias("__kind"), F.col("key").alias("__at"), *names)
    out = r.join(cold, ["__kind", "__at"], "left")
    return out.select(*rows.columns, *(F.coalesce(c, f"__{c}").alias(c) for c in names))


def label_pairs(pairs: DataFrame, keys: Sequence[str], *, query: str = "query", context: str = "context", answer: str = "answer", cutoffs: dict[str, float] | None = None) -> DataFrame:
    """(keys, defect, posterior) of every label of every pair whose posterior exceeds its cutoff.

    One row of ``pairs`` is a pair; repeated rows are labelled alike. Null questions and contexts count as empty texts, a
    null answer is an empty answer. Other columns are ignored.
    """
    spark = pairs.sparkSession
    fields = [pairs.schema[k] for k in keys]
    vote_type = T.ArrayType(T.ByteType())
    more = [T.StructField("grams", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.BooleanType())), T.StructField("last_gram", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("numeral", T.BooleanType()), T.StructField("stopped", T.BooleanType())]
    schema = T.StructType([*fields, *(T.StructField(f"v_{d}", vote_type) for d in DEFECTS), *more])
    k = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(votes(q, c, a), grams_of(a)) for q, c, a in zip(*(b.column(k + i).to_pylist() for i in range(3)))]
            out = [b.column(i) for i in range(k)]
            out += [pa.array([v[d] for v, _ in rows], pa.list_(pa.int8())) for d in DEFECTS]
            kinds = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.int64(), pa.int64(), pa.bool_())
            out += [pa.array([g[i] for _, g in rows], kind) for i, kind in enumerate(kinds)]
            out += [pa.array([v["truncated"][2] == NO for v, _ in rows])]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    voted = materialize(pairs.select(*keys, F.col(query), F.col(context), F.col(answer)).mapInArrow(run, schema), "pair-votes")
    marks = voted.select(F.explode(F.arrays_zip("grams", "ends")).alias("g")).select(F.col("g.grams").alias("key"), F.col("g.ends").cast("int").alias("end"))
    stats = materialize(marks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("ends")), "pair-grams")
    with_gram = look_up(voted.drop("grams", "ends"), "last_gram", stats.select("key", F.col("n").alias("gn"), "ends"), "gn", keys)
    both = look_up(with_gram, "last_word", stats.select("key", F.col("n").alias("wn")), "wn", keys)
    gn, ends, wn = F.coalesce("gn", F.lit(0)), F.coalesce("ends", F.lit(0)), F.coalesce("wn", F.lit(0))
    ratio = ends / F.greatest(gn, F.lit(1))
    byte = lambda x: F.lit(x).cast("byte")
    # These count the answer itself once, so a lone ending says nothing.
    ending = F.when(F.col("stopped") | F.col("last_gram").isNull(), byte(NONE)).when((gn >= 8) & (ratio < 0.25), byte(YES)).when((gn >= 4) & (ratio > 0.5), byte(NO)).otherwise(byte(NONE))
    known, prefix = F.get("v_truncated", F.lit(5)) == NO, F.get("v_truncated", F.lit(5)) == YES
    unsure = F.col("stopped") | F.col("last_word").isNull() | F.col("numeral") | known
    wordless = F.when(unsure, byte(NONE)).when((wn == 0) | (prefix & (wn < 3)), byte(YES)).otherwise(byte(NONE))
    full = both.withColumn("v_truncated", F.concat(F.slice("v_truncated", 1, 5), F.array(ending, wordless)))
    full = materialize(full.select(*keys, *(f"v_{d}" for d in DEFECTS)), "pair-votes-all")

    cutoffs = CUTOFFS | (cutoffs or {})
    tall = full.select(*keys, F.explode(F.array(*(F.struct(F.lit(d).alias("defect"), F.col(f"v_{d}").alias("votes")) for d in DEFECTS))).alias("x")).select(*keys, "x.*")
    counted = tall.groupBy("defect", "votes").count().collect()  # at most 3^7 patterns a defect
    rows = []
    for d in DEFECTS:
        mine = [(list(r["votes"]), r["count"]) for r in counted if r["defect"] == d]
        post, _ = em([p for p, _ in mine], [c for _, c in mine], TRUST.get(d))
        rows += [(d, p, float(x)) for (p, _), x in zip(mine, post) if x > cutoffs[d]]
    kept = spark.createDataFrame(rows, T.StructType([T.StructField("defect", T.StringType()), T.StructField("votes", vote_type), T.StructField("posterior", T.DoubleType())]))
    return tall.join(F.broadcast(kept), ["defect", "votes"]).select(*keys, "defect", "posterior")
