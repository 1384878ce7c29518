"""Scalar text functions as column expressions; only NFKC, entity decoding and case folding need an Arrow function."""

from __future__ import annotations

import hashlib
import html
import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that mark an abstention; matched in lower case anywhere in the extracted answer.
ABSTENTIONS = (
    "insufficient evidence", "insufficient information", "i do not know", "i don't know", "do not know", "cannot be determined",
    "cannot determine", "unable to determine", "not determinable", "not provided in the context", "not specified in the context",
    "not stated in the context", "not mentioned in the context", "no information", "the context does not contain",
    "the context does not mention", "the context does not include", "the context does not provide", "context provides no",
    "context lacks", "unable to find relevant information", "unable to find", "no relevant information",
)
#: Keys that wrap a JSON answer.
WRAPPERS = ("answer", "final_answer", "response", "result", "output", "text")
#: Fixed value: where a benchmark's output instruction begins.
FORMAT_MARKER = "[Benchmark Output Format]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once: inside a lambda or a branch the planner would repeat it at every mention."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def u_trim(c: Column) -> Column:
    """Without white space of any kind at the ends (``trim`` drops spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def u_collapse(c: Column) -> Column:
    return u_trim(F.regexp_replace(c, r"(?U)\s+", " "))


def normalise_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces; null counts as empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[!-/:-@\[-`{-~]", "")
    return u_collapse(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def tokens(c: Column) -> Column:
    """The words of a text between white space; an empty text has none."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


#: What marks a final answer, and what in scraped articles is newsletter and navigation furniture.
BOXED = r"\\boxed\{([^{}]+(?:\{[^{}]*\}[^{}]*)*)\}"
LABELLED = r"(?imsd)(?:(?:final\s+answer|@@ANSWER)\s*:|^[ \t]*answer[ \t]*:)[ \t]*(.+?)(?=\n[ \t]*\n|\z)"
BOILERPLATE = (
    r"(?s)^.*?\{\{ /verifyErrors \}\}.*?\{\{ /verifyErrors \}\}\s*",
    r"(?s)skip past newsletter promotion.*?after newsletter promotion\s*",
    r"(?md)^CLICK HERE TO .*\n?",
    r"(?md)^APP USERS CLICK HERE\s*\n?",
    r"(?md)^(?:WEEK \d+ [A-Z ]+|MORE [A-Z0-9 '/.-]+):.*\n(?:[^\n]*\|[^\n]*\n)?",
)


def final_answer(c: Column) -> Column:
    """The last boxed span, else the last labelled one, else the whole, trimmed."""
    text = F.coalesce(c, F.lit(""))
    boxed = F.regexp_extract_all(text, F.lit(BOXED), F.lit(1))
    labelled = F.regexp_extract_all(text, F.lit(LABELLED), F.lit(1))
    last = lambda a: F.element_at(a, -1)
    return u_trim(F.when(F.size(boxed) > 0, last(boxed)).when(F.size(labelled) > 0, last(labelled)).otherwise(text))


def abstains(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for p in ABSTENTIONS:
        out = out | F.contains(low, F.lit(p))
    return out


def compact(c: Column) -> Column:
    """Without spaces and line feeds, nothing else changed: the form in which facts are looked for."""
    return F.translate(F.coalesce(c, F.lit("")), " \n", "")


def fact_in(fact: Column, text: Column) -> Column:
    """Exact matching rule: the compact fact is in the compact text; an empty fact never is."""
    return (compact(fact) != "") & F.contains(compact(text), compact(fact))


def near(f: Column, t: Column, f_words: Column, t_words: Column, coverage: float = 0.6) -> Column:
    """Diagnostic rule on normalised texts and their words: either holds the other, or enough of the fact's distinct words occur."""
    share = F.size(F.array_intersect(f_words, t_words)) / F.greatest(F.size(f_words), F.lit(1))
    return (f != "") & (t != "") & (F.contains(t, f) | F.contains(f, t) | (share >= coverage))


def fact_near(fact: Column, text: Column, coverage: float = 0.6) -> Column:
    """The diagnostic rule on plain texts."""
    f, t = normalise_answer(fact), normalise_answer(text)
    return near(f, t, F.array_distinct(tokens(f)), tokens(t), coverage)


def shares_token(a: Column, b: Column) -> Column:
    """Any lower-case word in common."""
    low = lambda c: tokens(F.lower(F.coalesce(c, F.lit(""))))
    return F.arrays_overlap(low(a), low(b))


def document_key(c: Column) -> Column:
    """The form in which titles are compared."""
    k = F.regexp_replace(u_trim(F.lower(F.coalesce(c, F.lit("")))), r"\.(pdf|txt|md|json)$", "")
    return F.regexp_replace(F.replace(F.replace(k, F.lit("10-k"), F.lit("10k")), F.lit("10-q"), F.lit("10q")), r"[^a-z0-9]+", "")


def strip_format(c: Column) -> Column:
    return F.trim(F.substring_index(c, FORMAT_MARKER, 1))


def strip_thinking(c: Column) -> Column:
    return u_trim(F.replace(F.substring_index(c, "</think>", -1), F.lit("<end>"), F.lit("")))


def strip_boilerplate(c: Column) -> Column:
    """Newsletter and navigation furniture of scraped articles."""
    for pattern in BOILERPLATE:
        c = F.regexp_replace(c, pattern, "")
    return u_trim(c)


def safe_filename(c: Column) -> Column:
    n = F.substring(F.regexp_replace(u_trim(F.regexp_replace(c, r'[\\/*?:"<>|]', "_")), r"(?U)\s+", "_"), 1, 150)
    return F.when(n == "", F.lit("untitled")).otherwise(n)


def unwrap_json(c: Column, depth: int = 3) -> Column:
    """The text inside up to ``depth`` nested JSON objects with one of the wrapper keys; other texts stay."""
    for _ in range(depth):
        inner = F.coalesce(*(F.get_json_object(c, f"$.{k}") for k in WRAPPERS))
        c = F.coalesce(F.when(F.ltrim(c).startswith("{"), inner), c)
    return c


def node_identity(id_: Column, title: Column, source: Column, page: Column, sent_id: Column) -> Column:
    """The trimmed id, or where there is none title:source:page:sentence."""
    s = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    given = u_trim(F.coalesce(id_, F.lit("")))
    return F.when(given != "", given).otherwise(F.concat_ws(":", s(title), s(source), s(page), s(sent_id)))


def chunk_id(source: Column, title: Column, sent_id: Column) -> Column:
    return F.md5(F.concat_ws("-", source, title, sent_id.cast("string")))


def question_id(chunk: Column, channel: Column, ordinal: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("|", chunk, channel, ordinal.cast("string"), text), 256)


def baseline_chunk_id(namespace: Column, filename: Column, title: Column, sent_id: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit("naive"), namespace, filename, title, sent_id.cast("string")))


def document_text(title: Column, text: Column) -> Column:
    """What a document embedding is made of: the title line and the text."""
    return u_trim(F.concat(F.lit("Document title: "), F.coalesce(title, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit(""))))


def candidate_label(rank0: Column) -> Column:
    return F.format_string("C%03d", rank0)


def context_block(title: Column, page: Column, sent_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[["), title, F.lit(", Page "), F.coalesce(page, F.lit(0)).cast("string"), F.lit(", Chunk "), sent_id.cast("string"), F.lit("]]\n"), text)


def approximate_tokens(c: Column) -> Column:
    """Token count where no tokenizer is given: a quarter of the characters."""
    return F.floor(F.length(F.coalesce(c, F.lit(""))) / 4)


def rank_of_score(score: Column) -> Column:
    """The 0-based rank behind a reciprocal score, null unless the score is 1/(rank+1)."""
    r = F.bround(1 / score, 0)
    return F.when((score > 0) & (F.abs(1 / r - score) < 1e-9), (r - 1).cast("int"))


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def unescape(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "" if t is None else html.unescape(t.strip()))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def entity_term(c: Column) -> Column:
    """Terms in one form: NFKC, lower case, ``_`` and ``-`` as spaces, single spaces."""
    return u_collapse(F.regexp_replace(F.lower(nfkc(c)), r"[_-]+", " "))


def fulltext_query(c: Column) -> Column:
    """A query without the operators of full-text syntax, at most 512 characters; the plain term where nothing is left."""
    clean = F.substring(u_collapse(F.regexp_replace(nfkc(c), r'[+\-!(){}\[\]^"~*?:\\/&|]', " ")), 1, 512)
    return F.when(clean != "", clean).otherwise(F.coalesce(F.nullif(entity_term(c), F.lit("")), c))


def namespace_token(name: str, limit: int = 48) -> str:
    """A namespace as an identifier; with a digest if that lost anything."""
    token = re.sub(r"[^A-Za-z0-9_]+", "_", name).strip("_") or "default"
    if token == name and len(token) <= limit:
        return token
    return f"{token[:limit]}_{hashlib.sha256(name.encode()).hexdigest()[:8]}"


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


#: Fixed value: the label that marks where a prediction's answer begins.
ANSWER_PREFIX = "@@ANSWER:"


def mark_answer(c: Column) -> Column:
    """A prediction with an answer label: its own if it has one, else one before the whole of it."""
    t = u_trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike(r"(?im)(?:final\s+answer|@@ANSWER)\s*:|^[ \t]*answer[ \t]*:"), t).otherwise(F.concat(F.lit(ANSWER_PREFIX + " "), t))


def strict_boolean(c: Column) -> Column:
    """true, false, 1, 0, yes, no, on and off in any case; anything else fails the job, null stays null."""
    t = F.lower(u_trim(c))
    return F.when(t.isin("true", "1", "yes", "on"), True).when(t.isin("false", "0", "no", "off"), False).when(c.isNotNull(), F.raise_error(F.lit("not a boolean")).cast("boolean"))


def safe_double(c: Column, default: float | None = None) -> Column:
    """The number of a text, or ``default`` where there is none or it is not finite."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(F.lit(default).cast("double"))


def seeds(text: str) -> list[int]:
    """A list of seeds, each once in its order, from numbers parted by commas or blanks; none is an error."""
    found = list(dict.fromkeys(int(x) for x in re.split(r"[,\s]+", text.strip()) if x))
    if not found:
        raise ValueError("no seed given")
    return found


def source_title(c: Column) -> Column:
    """The title of a saved source, which is an object with doc, title or source, or a plain text."""
    named = F.coalesce(*(F.nullif(u_trim(F.get_json_object(c, f"$.{k}")), F.lit("")) for k in ("doc", "title", "source")))
    return F.when(F.ltrim(c).startswith("{"), named).otherwise(F.nullif(u_trim(c), F.lit("")))


def source_text(c: Column) -> Column:
    """The text of a saved source: of an object its text or content, of a list its parts, else the text itself."""
    return F.when(F.ltrim(c).startswith("{"), F.coalesce(F.get_json_object(c, "$.text"), F.get_json_object(c, "$.content"), F.lit(""))).when(F.ltrim(c).startswith("["), F.array_join(F.from_json(c, "array<string>"), "\n")).otherwise(F.coalesce(c, F.lit("")))


def query_for_embedding(c: Column, instruction: str, template: str = "Instruct: {instruction}\nQuery: {query}") -> Column:
    """A query as a model wants it for its query side; documents are embedded without an instruction."""
    before, after = template.replace("{instruction}", instruction).split("{query}")
    return F.concat(F.lit(before), c, F.lit(after))


def payload_bytes(c: Column, kind: T.DataType) -> Column:
    """The logical size of a value: its bytes as text or binary, eight for a number or a flag, its parts and eight for a
    list, names and parts for an object, nothing for null."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        n = F.octet_length(c).cast("long")
    elif isinstance(kind, T.ArrayType):
        n = F.aggregate(c, F.lit(8).cast("long"), lambda s, x: s + payload_bytes(x, kind.elementType))
    elif isinstance(kind, T.StructType):
        n = sum((payload_bytes(c[f.name], f.dataType) + len(f.name.encode()) for f in kind.fields), F.lit(0).cast("long"))
    elif isinstance(kind, T.MapType):
        n = payload_bytes(F.map_keys(c), T.ArrayType(kind.keyType)) + payload_bytes(F.map_values(c), T.ArrayType(kind.valueType)) - 16
    else:
        n = F.lit(8).cast("long")
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(n)


def character_counts(c: Column) -> Column:
    """Counts of a raw answer by kind of character: what is told of an answer that could not be read."""
    without = lambda pattern: F.length(c) - F.length(F.regexp_replace(c, pattern, ""))
    return F.struct(
        F.length(c).alias("characters"), F.octet_length(c).alias("utf8_bytes"), F.sha2(c, 256).alias("sha256"), without(r"[\x00-\x7f]").alias("ascii"), without(r"[^\x00-\x7f]").alias("non_ascii"),
        without(r"[\x00-\x1f]").alias("control"), without(r"(?U)\s").alias("whitespace"), without("\ufeff").alias("bom"), without("\n").alias("newlines"),
    )


@F.pandas_udf(T.StringType())
def json_fault(texts: pd.Series) -> pd.Series:
    """Why a text is no JSON, in a few words with underscores; null where it is."""
    def why(t: object) -> str | None:
        if t is None:
            return "no_text"
        try:
            json.loads(t)
        except json.JSONDecodeError as e:
            return re.sub(r"[^a-z]+", "_", e.msg.split(":")[0].lower()).strip("_")
        except RecursionError:
            return "too_deep"
        return None

    return texts.map(why)


def signature(**parts: object) -> str:
    """The key of a cache: a digest of everything its values depend on, whatever the order of the parts."""
    return digest(parts)


def request_identity(messages: Column, model: Column, settings: dict) -> Column:
    """The digest of a reader's request: identical messages, model and settings are one request."""
    return F.sha2(F.concat_ws("\u0001", messages, model, F.lit(canonical_json(settings))), 256)


def ranking_schema(k: int) -> T.StructType:
    """What a ranker returns: an array of labels; :func:`ranking_ok` holds it to ``k`` distinct ones of those shown."""
    return T.StructType([T.StructField("ranking", T.ArrayType(T.StringType(), False), False)])


def ranking_ok(ranking: Column, shown: Column, k: int) -> Column:
    """Exactly as many labels as were asked for and can be had, each once and each among those shown."""
    want = F.least(F.lit(k), F.size(shown))
    return (F.size(ranking) == want) & (F.size(F.array_distinct(ranking)) == want) & (F.size(F.array_except(ranking, shown)) == 0)


def sized(vector: Column, dim: int) -> Column:
    """The vector, which must have ``dim`` elements and no null; another one fails the job, null stays null."""
    ok = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull())
    return F.when(vector.isNull() | ok, vector).otherwise(F.raise_error(F.lit(f"a vector that has not {dim} elements")).cast("array<double>"))
