"""Records identical but for formatting, collapsed to one each with the number of copies.

Canonical form, all in the JVM: case folding (upper, then lower, sharp s as ss), format characters dropped, and only letters and digits
kept; a card (labelled fields) becomes its sorted ``label=value`` list. Texts with characters outside the common alphabets
pass through NFKC first, in an Arrow function that gets null for every other row. The form is hashed to 128 bits with an
independent 64-bit check and the length; all three are the grouping key, so texts whose hashes collide stay apart. Counts
are combined before the shuffle; what follows joins only keys, never texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.session import materialize

#: A set with more than this share of all rows is hot; there can be at most HOT_SHARE of them, so they may be broadcast.
HOT_SHARE = 512


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\p{L}\p{N}]+", "")


def with_canonical(df: DataFrame, text: str, labels: Sequence[str], out: str) -> DataFrame:
    """``df`` with the form in which copies agree; empty where the text has no letter or digit, null for null.

    ``p:`` and ``c:`` tell prose from cards. A text is a card if nothing but punctuation comes before its first
    ``label:``; fields end where the next label follows a semicolon, bar, comma, brace or line end. A JSON object whose keys
    are all labels is read as JSON, so escapes in it count as what they mean. The steps are separate projections, so that
    each regular expression runs once a row, and those for cards only on cards.
    """
    either = "|".join(x.lower().replace(" ", r"\s+") for x in labels) or r"(?!)"
    raw = F.col(text)
    df = df.withColumn("__t", F.coalesce(_nfkc(F.when(raw.rlike(r"[^\x00-\u024F\u0370-\u04FF\u2010-\u203A\u20AC]"), raw)), raw))
    df = df.withColumn("__t", F.lower(F.upper(F.regexp_replace("__t", r"\p{Cf}+", ""))))
    df = df.withColumn("__t", F.replace(F.translate("__t", "\u03c2", "\u03c3"), F.lit("\u00df"), F.lit("ss")))
    t = F.col("__t")
    df = df.withColumn("__kind", F.when(t.rlike(rf"^[^\p{{L}}\p{{N}}]*(?:{either})[^\p{{L}}\p{{N}}:=]*[:=]"), F.when(t.rlike(r"^\s*\{"), 2).otherwise(1)).otherwise(0))
    df = df.withColumn("__json", F.map_entries(F.from_json(F.when(F.col("__kind") == 2, t), "map<string,string>")))
    fields = F.split(F.concat(F.lit(";"), t), rf"[{{;|,\n\r][^\p{{L}}\p{{N}};|\n\r]*(?=(?:{either})[\s\"'*_]*[:=])")
    df = df.withColumn("__card", F.when(F.col("__kind") > 0, F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0)))))
    known = F.lit([_squeeze(x) for x in labels]) if labels else F.array().cast("array<string>")
    is_json = (F.size("__json") > 0) & F.forall("__json", lambda e: F.array_contains(known, _strip(e["key"])))
    as_json = F.transform("__json", lambda e: F.concat(_strip(e["key"]), F.lit("="), _strip(F.coalesce(e["value"], F.lit("")))))
    as_card = F.transform("__card", lambda f: F.concat(_strip(F.regexp_extract(f, rf"^({either})", 1)), F.lit("="), _strip(F.regexp_replace(f, rf"^(?:{either})[^:=]*[:=]", ""))))
    card = lambda f: F.concat(F.lit("c:"), F.array_join(F.sort_array(f), ";"))
    prose = _strip(t)
    form = F.when(is_json, card(as_json)).when(F.size("__card") > 0, card(as_card)).otherwise(F.when(prose == "", F.lit("")).otherwise(F.concat(F.lit("p:"), prose)))
    return df.withColumn(out, form).drop("__t", "__kind", "__json", "__card")


def _squeeze(label: str) -> str:
    return "".join(ch for ch in label.lower() if ch.isalnum())


def copy_keys(df: DataFrame, key: str, text: str, labels: Sequence[str]) -> DataFrame:
    """(``key``, h128, check64, length) of every row that has a letter or digit; written to the shared folder."""
    form = with_canonical(df.select(key, text), text, labels, "__form").withColumn("__form", F.nullif("__form", F.lit("")))
    keyed = form.select(key, F.unhex(F.md5("__form")).alias("h128"), F.xxhash64("__form").alias("check64"), F.length("__form").alias("length"))
    return materialize(keyed, "copy-keys").where("h128 is not null")  # a filter before the write would compute every form twice


def copy_sets(keyed: DataFrame, key: str) -> DataFrame:
    """One row per set: (h128, check64, length, kept, copies); ``kept`` is the smallest key, ``copies`` counts every row."""
    return keyed.groupBy("h128", "check64", "length").agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))


def copies(df: DataFrame, key: str, text: str, labels: Sequence[str] = ()) -> DataFrame:
    """(kept, copy) for every row that is not the first of its set.

    Null and blank texts, and texts without a letter or digit, take no part. ``key`` should be unique; rows that repeat
    the kept key are not reported. Extra columns are ignored; an empty table gives an empty table.
    """
    on = ["h128", "check64", "length"]
    keyed = copy_keys(df, key, text, labels)
    sets = materialize(copy_sets(keyed, key).where("copies > 1"), "copy-sets")
    bound = max(1, keyed.count() // HOT_SHARE)
    hot = sets.where(F.col("copies") > bound).select(*on, "kept")
    if hot.isEmpty():
        joined = keyed.join(sets.select(*on, "kept"), on)
    else:  # fewer than HOT_SHARE rows, as each stands for more than a HOT_SHARE-th of all
        by_hot = keyed.join(F.broadcast(hot), on)
        rest = keyed.join(F.broadcast(hot.select(*on)), on, "left_anti")
        joined = by_hot.unionByName(rest.join(sets.where(F.col("copies") <= bound).select(*on, "kept"), on))
    return joined.where(F.col(key) != F.col("kept")).select("kept", F.col(key).alias("copy"))
