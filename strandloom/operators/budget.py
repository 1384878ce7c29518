"""Prompts and their exact sizes: token counters, rendering, the prefix of a ranking that fits, ceilings and stage recall."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.functions.vectors import rank_within

Counter = Callable[[Sequence[str]], list[int]]
#: Tokens that a message has beside its content, and that a reply is primed with.
PER_MESSAGE, PRIMED = 4, 2


def quarter_counter() -> Counter:
    """A quarter of the characters, where there is no tokenizer."""
    return lambda texts: [len(t) // 4 for t in texts]


def file_counter(path: str) -> Counter:
    """Token counts of a vocabulary file: ``.json`` of tokenizers, ``.tiktoken`` ranks, ``.model`` of sentencepiece."""
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(list(texts), add_special_tokens=False)]
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken
        from tiktoken_ext.openai_public import r50k_pat_str

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        e = tiktoken.Encoding("file", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    if path.endswith(".model"):
        import sentencepiece

        s = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in s.encode(list(texts), num_threads=1)]
    raise ValueError(f"no tokenizer for {path}")


def token_counts(text: Column, counter: Callable[[], Counter]) -> Column:
    """The tokens of each text, null for null; the counter is made once a task and gets batches."""
    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter()
        for b in batches:
            n = pd.Series(c([t or "" for t in b]), index=b.index, dtype="Int32")
            yield n.mask(b.isna())

    return count(text)


def message_tokens(contents: Sequence[Column], counter: Callable[[], Counter]) -> Column:
    """The size of a chat request of these message contents."""
    return sum((F.coalesce(token_counts(c, counter), F.lit(0)) + PER_MESSAGE for c in contents), F.lit(PRIMED))


def truncated(text: Column, tokens: int, counter: Callable[[], Counter]) -> Column:
    """The longest beginning of whole characters that has at most ``tokens`` tokens, by halving; counts must not fall as a
    text grows."""
    @F.pandas_udf(T.StringType())
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter()
        for b in batches:
            out = []
            for t in b:
                if t is None or c([t])[0] <= tokens:
                    out.append(t)
                    continue
                low, high = 0, len(t)
                while high - low > 1:
                    mid = (low + high) // 2
                    low, high = (mid, high) if c([t[:mid]])[0] <= tokens else (low, mid)
                out.append(t[:low])
            yield pd.Series(out, index=b.index, dtype=object)

    return cut(text)


def candidate_line(label: Column, title: Column, metadata: Column, text: Column) -> Column:
    """One candidate as a ranker reads it: label, title, metadata if there is any, text."""
    meta = F.when(F.coalesce(metadata, F.lit("")) != "", F.concat(F.lit(" | "), metadata)).otherwise(F.lit(""))
    return F.concat(label, F.lit(" | "), F.coalesce(title, F.lit("")), meta, F.lit(" | "), F.coalesce(text, F.lit("")))


def rendered(template: Column | str, **parts: Column) -> Column:
    """A template with its ``{name}`` places filled; text that looks like a place is not filled again."""
    c = F.lit(template) if isinstance(template, str) else template
    pieces, out = [], str(template)
    while True:
        at = min(((out.index("{" + n + "}"), n) for n in parts if "{" + n + "}" in out), default=None)
        if at is None:
            break
        pieces += [F.lit(out[: at[0]]), F.coalesce(parts[at[1]], F.lit(""))]
        out = out[at[0] + len(at[1]) + 2 :]
    return F.concat(*pieces, F.lit(out)) if pieces else c


def exact_prefix(ranked: DataFrame, queries: DataFrame, limit: int, counter: Callable[[], Counter], render: Callable[[str, list[str]], str]) -> DataFrame:
    """(query_id, id, rank, prompt_tokens): the longest prefix of each ranking whose whole rendered prompt fits ``limit``.

    ``ranked``: query_id, id, rank, block (a passage as it is shown); ``queries``: query_id, query. The size of a prompt is
    not the sum of its passages, so prompts are rendered and counted as passages are added; a query ends at its first
    overflow. Every passage takes a token at least, so ranks beyond ``limit`` cannot fit and leave before the shuffle; a task
    streams its queries and holds the passages that one of them has admitted.
    """
    kind = ranked.schema["id"].dataType
    schema = T.StructType([ranked.schema["query_id"], T.StructField("id", kind), T.StructField("rank", T.IntegerType()), T.StructField("prompt_tokens", T.IntegerType())])
    rows = ranked.where(F.col("rank") <= limit).join(queries.select("query_id", "query"), "query_id")
    rows = rows.select("query_id", "id", F.col("rank").cast("int").alias("rank"), F.coalesce("block", F.lit("")).alias("block"), F.coalesce("query", F.lit("")).alias("query"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, now, held, full = counter(), None, [], False
        for b in batches:
            keep, sizes = [], []
            for i, (q, block, query) in enumerate(zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())):
                if q != now:
                    now, held, full = q, [], False
                if full:
                    continue
                n = count([render(query, [*held, block])])[0] + PER_MESSAGE + PRIMED
                if n > limit:
                    full = True
                    continue
                held.append(block)
                keep.append(i)
                sizes.append(n)
            if keep:
                some = b.take(pa.array(keep))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(2), pa.array(sizes, pa.int32())], names=schema.names)

    return rows.where("query_id is not null").repartition("query_id").sortWithinPartitions("query_id", "rank", "id").mapInArrow(run, schema)


def ceilings(sizes: DataFrame, shares: Sequence[float] = (0.25, 0.5, 1.0)) -> DataFrame:
    """(query_id, share, ceiling): the size of the initial passages and a share of what the full prompt adds, rounded down.

    ``sizes``: query_id, initial (T0), full (T1).
    """
    s = sizes.withColumn("share", F.explode(F.lit([float(x) for x in shares])))
    return s.select("query_id", "share", (F.col("initial") + F.floor(F.col("share") * (F.col("full") - F.col("initial")))).cast("long").alias("ceiling"))


def stage_recall(stages: dict[str, DataFrame], hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(stage, queries, recall, complete): evidence at each stage (query_id, id), averaged over the questions with units.

    ``hits``: query_id, id, unit; ``gold``: query_id, units. A question that a stage has nothing for counts as zero.
    """
    g = gold.where("units > 0")
    out = None
    for name, d in stages.items():
        found = d.select("query_id", "id").distinct().join(hits, ["query_id", "id"]).groupBy("query_id").agg(F.count_distinct("unit").alias("k"))
        j = g.join(found, "query_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
        one = j.agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("k") / F.col("units")).alias("recall"), F.avg((F.col("k") == F.col("units")).cast("double")).alias("complete")).select(F.lit(name).alias("stage"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def count_matched(pools: dict[str, DataFrame], starts: DataFrame) -> DataFrame:
    """(pool, query_id, id, rank): all pools cut to one common number of passages from what all of them hold.

    A pool has query_id, id, semantic_score and representation_score. Starts stay in any case; the others of the intersection
    are ranked by fusion of the pool's own scores, and as many are kept as the smallest pool has others, at most the
    intersection's.
    """
    from strandloom.operators.retrieval import rank_fusion

    s = starts.select("query_id", "id").distinct().withColumn("__start", F.lit(True))
    others = {n: d.join(s, ["query_id", "id"], "left_anti") for n, d in pools.items()}
    common, least = None, None
    for d in others.values():
        ids = d.select("query_id", "id").distinct()
        common = ids if common is None else common.join(ids, ["query_id", "id"], "left_semi")
        n = ids.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
        least = n if least is None else least.unionByName(n)
    bound = least.groupBy("query_id").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("seen")).where(F.col("seen") == len(pools))
    out = None
    for name, d in pools.items():
        shared = d.join(common.unionByName(s.select("query_id", "id")).distinct(), ["query_id", "id"], "left_semi")
        ranked = rank_fusion(shared.withColumnRenamed("semantic_score", "final_score"), None).select("query_id", "id", "rank")
        rest = rank_within(ranked.join(s, ["query_id", "id"], "left_anti").withColumnRenamed("rank", "__r"), ["query_id"], [F.col("__r").asc()]).drop("__r")
        rest = rest.join(bound, "query_id").where(F.col("rank") <= F.col("n")).select("query_id", "id", "rank")
        first = ranked.join(s, ["query_id", "id"], "left_semi").select("query_id", "id", F.lit(0).alias("rank"))
        one = first.unionByName(rest).select(F.lit(name).alias("pool"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def source_reach(pool: DataFrame, owners: DataFrame, hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, passages, sources, oracle): units that the pool holds, how many sources it reaches, and units that all
    passages of these sources hold: what choosing passages better within the same sources could give at most.

    ``owners``: id, source.
    """
    p = pool.select("query_id", "id").distinct()
    reach = p.join(owners, "id").select("query_id", "source").distinct()
    units = lambda d, n: d.groupBy("query_id").agg(F.count_distinct("unit").alias(n))
    inside = units(p.join(hits, ["query_id", "id"]), "passages")
    oracle = units(hits.join(owners, "id").join(reach, ["query_id", "source"], "left_semi"), "oracle")
    n = reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("sources"))
    j = gold.select("query_id").join(inside, "query_id", "left").join(n, "query_id", "left").join(oracle, "query_id", "left")
    return j.na.fill(0, ["passages", "sources", "oracle"]).select("query_id", "passages", "sources", "oracle")


def fused_terms(semantic_rank: Column, representation_rank: Column, representation: Column, *, offset: float = 0.0, weight: float | None = None) -> Column:
    """Rank terms 1 / (rank + offset) of both ranks, the second only for a positive score; ``weight`` w mixes w and 1 - w."""
    a = 1.0 / (semantic_rank + offset)
    b = F.when(F.coalesce(representation, F.lit(0.0)) > 0, 1.0 / (representation_rank + offset)).otherwise(0.0)
    return a + b if weight is None else weight * a + (1 - weight) * b
