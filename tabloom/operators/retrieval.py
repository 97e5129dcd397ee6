"""Ranking, vectors, fusion, chunks.

The tenant and type filters come before anything is scored. Terms and weights are plain aggregations, so a corpus of any size
is scored by joins on terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

from tabloom.functions.scores import cosine
from tabloom.functions.text import rank_tokens
from tabloom.operators.joins import small, stored

#: Weights of fusion.
LEXICAL, VECTOR, AGREEMENT, RANGE_BOOST = 0.45, 0.55, 0.10, 0.15


def tfidf_scores(docs: DataFrame, query: str, ident: str, text: str, max_features: int | None = None, stop: tuple[str, ...] = ()) -> DataFrame:
    """Cosine of each document and a query with idf = ln((1 + N) / (1 + df)) + 1 over the documents themselves. Words in `stop`
    do not count; with max_features only so many terms do, the most frequent of the corpus, ties by term."""
    spark = docs.sparkSession
    terms = docs.select(F.col(ident).alias("id"), F.explode(rank_tokens(F.col(text))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    if stop:
        terms = terms.where(~F.col("term").isin(*stop))
    if max_features is not None:
        top = stored(terms.groupBy("term").agg(F.sum("tf").alias("total")).orderBy(F.desc("total"), "term").limit(max_features).select("term"), "terms")
        terms = terms.join(small(top), "term", "left_semi")
    n = docs.agg(F.count("*").alias("n")).withColumn("_k", F.lit(1))
    df = terms.groupBy("term").agg(F.count("*").alias("df")).withColumn("_k", F.lit(1)).join(F.broadcast(n), "_k")
    idf = df.select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    q = spark.range(1).select(F.explode(rank_tokens(F.lit(query))).alias("term")).groupBy("term").agg(F.count("*").alias("qtf"))
    # The query is a given text; its terms are few whatever the corpus.
    weights = idf.join(F.broadcast(q), "term", "left").select("term", "idf", (F.col("qtf") * F.col("idf")).alias("qw"))
    qn = weights.agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn")).withColumn("_k", F.lit(1))
    # Norm and dot product come from one aggregation over the terms of each document. The counted terms are shuffled once for
    # the document frequencies and for this join, which adaptive execution broadcasts where the vocabulary is small.
    w = terms.join(weights, "term").withColumn("w", F.col("tf") * F.col("idf"))
    sums = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum(F.col("w") * F.col("qw")).alias("dot"))
    return sums.where("dot is not null").withColumn("_k", F.lit(1)).join(F.broadcast(qn), "_k").select("id", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))


def top_k(scores: DataFrame, k: int, score: str = "score", ident: str = "id") -> DataFrame:
    return scores.orderBy(F.desc(score), ident).limit(k)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, ident: str, vector: str, least: float | None = None) -> DataFrame:
    """The k nearest by cosine in doubles; ties by id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    s = vectors.select(F.col(ident).alias("id"), cosine(F.col(vector), q).alias("score")).where(F.col("score").isNotNull())
    return top_k(s if least is None else s.where(F.col("score") > least), k)


def cosine_top_k_each(queries: DataFrame, vectors: DataFrame, k: int, ident: str, vector: str) -> DataFrame:
    """The k nearest of each stated query, itself left out.

    Queries go out in blocks of a bounded size; a task keeps the best k of each query over its vectors as it reads them, so
    only k rows a query and task are ranked at the end."""
    q = queries.select(F.col(ident).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("qv")).where("qv is not null")
    elements = q.agg(F.coalesce(F.sum(F.size("qv")), F.lit(0))).first()[0]
    blocks = max(1, -(-elements // QUERY_ELEMENTS))
    parts = []
    for block in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).collect()
        if rows:
            asked = np.array([r["q"] for r in rows]), np.array([r["qv"] for r in rows])
            parts.append(vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(_best(*asked, k), "q long, id long, score double"))
    if not parts:
        return vectors.sparkSession.createDataFrame([], "q long, id long, score double, rank int")
    s = parts[0]
    for p in parts[1:]:
        s = s.unionByName(p)
    return s.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


#: Numbers of a block of queries: some 16 MB.
QUERY_ELEMENTS = 2_000_000


def _best(ids: np.ndarray, asked: np.ndarray, k: int):
    """The k nearest vectors of a task to each query, by cosine in doubles; ties by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norm = np.sqrt((asked * asked).sum(axis=1))
        held_i, held_s = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for b in batches:
            v = b.column("v")
            if not b.num_rows:
                continue
            every, names = v.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1), b.column("id").to_numpy()
            step = max(1, QUERY_ELEMENTS // len(ids))
            for at in range(0, b.num_rows, step):
                x = every[at : at + step]
                size = np.sqrt((x * x).sum(axis=1))
                with np.errstate(divide="ignore", invalid="ignore"):
                    s = np.clip((asked @ x.T) / (norm[:, None] * size[None, :]), -1.0, 1.0)
                i = np.broadcast_to(names[at : at + step], s.shape)
                s = np.where(np.isfinite(s) & (i != ids[:, None]), s, -np.inf)
                held_i, held_s = np.concatenate([held_i, i], axis=1), np.concatenate([held_s, s], axis=1)
                order = np.lexsort((held_i, -held_s), axis=1)[:, :k]
                held_i, held_s = np.take_along_axis(held_i, order, axis=1), np.take_along_axis(held_s, order, axis=1)
        some = np.isfinite(held_s)
        yield pa.RecordBatch.from_pydict({"q": np.broadcast_to(ids[:, None], some.shape)[some], "id": held_i[some], "score": held_s[some]})

    return run


def fuse(lexical: DataFrame, vector: DataFrame, k: int) -> DataFrame:
    """Lexical and vector hits by id: 0.45 of the lexical score over its ceiling, 0.55 of the vector score, 0.1 for both."""
    ceiling = lexical.agg(F.greatest(F.lit(1.0), F.coalesce(F.max("score"), F.lit(1.0))).alias("top")).withColumn("_k", F.lit(1))
    j = lexical.select("id", F.col("score").alias("lex")).join(vector.select("id", F.col("score").alias("vec")), "id", "full").withColumn("_k", F.lit(1)).join(F.broadcast(ceiling), "_k")
    base = LEXICAL * F.coalesce(F.col("lex") / F.col("top"), F.lit(0.0)) + VECTOR * F.greatest(F.lit(0.0), F.coalesce("vec", F.lit(0.0)))
    both = F.col("lex").isNotNull() & F.col("vec").isNotNull()
    out = j.select("id", F.bround(F.when(both, F.least(F.lit(1.0), base + AGREEMENT)).otherwise(base), 4).alias("score"), F.concat_ws(",", F.when(F.col("lex").isNotNull(), "lexical"), F.when(F.col("vec").isNotNull(), "vector")).alias("found_by"))
    return top_k(out, k)


def range_boost(score: Column, in_range: Column) -> Column:
    return score + F.when(in_range, RANGE_BOOST).otherwise(0.0)


def numbered_extracts(chunks: DataFrame, order: list, text: str, by: list[str] | None = None) -> DataFrame:
    """[S1], [S2], ... in order, for each prompt. The extracts of one prompt are a page or two; without `by` all rows are one
    prompt's."""
    return chunks.withColumn("marker", F.concat(F.lit("S"), F.row_number().over(W.partitionBy(*(by or [F.lit(0)])).orderBy(*order)).cast("string"))).withColumn("extract", F.concat(F.lit("["), F.col("marker"), F.lit("] "), F.trim(text)))


def embedder(dimensions: int = 1024, widths: tuple[int, ...] = (3, 4)):
    """A column function text -> unit vector: signed hashing of words and character n-grams with blake2b, 1 + ln(count)."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def embed(s: pd.Series) -> pd.Series:
        import hashlib
        import re
        from functools import lru_cache

        import numpy as np

        @lru_cache(maxsize=200_000)
        def place(feature: str) -> int:
            return int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "big")

        def one(t: str | None):
            words = re.sub(r"[\W_]+", " ", (t or "").casefold()).strip()
            if not words:
                return None
            counts: dict[str, int] = {}
            padded = f" {words} "
            for f in [f"w:{w}" for w in words.split()] + [f"c{n}:{padded[i : i + n]}" for n in widths for i in range(len(padded) - n + 1)]:
                counts[f] = counts.get(f, 0) + 1
            v = np.zeros(dimensions)
            for f, c in counts.items():
                h = place(f)
                v[h % dimensions] += (1 + np.log(c)) * (1.0 if (h >> 63) & 1 else -1.0)
            n = np.sqrt((v * v).sum())
            return (v / n if n else v).tolist()

        return s.map(one)

    return embed


def _split_sentences(text: str, most: int) -> list[str]:
    out, held = [], ""
    for piece in text.split(". "):
        joined = f"{held}. {piece}" if held else piece
        if held and len(joined) > most:
            out.append(held)
            held = piece
        else:
            held = joined
    return [*out, held] if held else out


@F.udtf(returnType=StructType([StructField("part", IntegerType()), StructField("text", StringType())]))
class SentenceChunks:
    """Paragraphs cut at sentence ends to at most so many characters (a longer sentence stays whole)."""

    def eval(self, text: str, most: int):
        n = 0
        for paragraph in (text or "").split("\n\n"):
            for part in _split_sentences(paragraph.strip(), most):
                if part.strip():
                    yield n, part.strip()
                    n += 1


@F.udtf(returnType=StructType([StructField("part", IntegerType()), StructField("text", StringType())]))
class ParagraphChunks:
    """Runs of paragraphs under a budget of characters; each run repeats the last paragraphs of the one before."""

    def eval(self, text: str, budget: int, overlap: int):
        paragraphs = [p.strip() for p in (text or "").split("\n") if p.strip()]
        start = n = 0
        while start < len(paragraphs):
            end, size = start, 0
            while end < len(paragraphs) and (end == start or size + len(paragraphs[end]) <= budget):
                size += len(paragraphs[end])
                end += 1
            yield n, "\n".join(paragraphs[start:end])
            n += 1
            if end == len(paragraphs):
                return
            start = max(end - overlap, start + 1)


@F.udtf(returnType=StructType([StructField("part", IntegerType()), StructField("of", IntegerType()), StructField("text", StringType())]))
class TableChunks:
    """Rows of a table (one line each) in parts that repeat the header."""

    def eval(self, text: str, budget: int):
        lines = [x for x in (text or "").split("\n") if x.strip()]
        if not lines:
            return
        parts, held, size = [], [], len(lines[0])
        for x in lines[1:]:
            if held and size + len(x) > budget:
                parts.append(held)
                held, size = [], len(lines[0])
            held.append(x)
            size += len(x)
        parts.append(held)
        for i, p in enumerate(parts, 1):
            yield i, len(parts), "\n".join([lines[0], *p])


def section_query(number: Column, title: Column, guidance: Column, metadata: list[Column]) -> Column:
    """What a section is matched against: its number and title, its guidance, and the scalar values of a study."""
    parts = [number, title, guidance, *[m.cast("string") for m in metadata]]
    return F.concat_ws(" ", *[F.when(F.coalesce(p, F.lit("")) != "", p) for p in parts])


def retrieve_section(chunks: DataFrame, query: str, org: str, types: list[str], range_prefix: str | None, k: int = 16) -> DataFrame:
    """The k best chunks of a tenant for a section: tenant and types come first, then cosine of terms, a boost for tables of
    the section's range; nothing without a shared term. Ties go to tables, then by id."""
    from tabloom.functions.text import in_id_range
    from tabloom.operators.usage import tenant_scope

    c = tenant_scope(chunks, org)
    c = c.where(F.col("doc_type").isin(*types)) if types else c
    s = c.join(tfidf_scores(c, query, "id", "text"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    table = F.col("table_id").isNotNull()
    s = s.withColumn("score", range_boost(F.col("score"), table & in_id_range(F.col("table_id"), range_prefix)) if range_prefix else F.col("score"))
    return s.where("score > 0").orderBy(F.desc("score"), ~table, "id").limit(k)


def field_evidence(memory: DataFrame, evidence: DataFrame, target: str = "target") -> DataFrame:
    """target, prior (remembered mappings in order) and evidence (hits in order): two retrievals, kept apart."""
    prior = memory.groupBy(target).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "column", "score"))), lambda x: F.struct(x["column"].alias("column"), x["score"].alias("score"))).alias("prior"))
    hits = evidence.groupBy(target).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))), lambda x: F.struct(x["id"].alias("id"), x["score"].alias("score"))).alias("evidence"))
    return prior.join(hits, target, "full")


def read_vector(c: Column, dimensions: int) -> Column:
    """A vector from JSON text, null where it is no list of so many finite numbers."""
    v = F.from_json(c, "array<double>")
    return F.when((F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), v)


def write_vector(c: Column) -> Column:
    return F.to_json(c)


class ProviderMismatch(ValueError):
    """Vectors of one index come from one embedding model."""


def same_provider(vectors: DataFrame, provider: str, column: str = "provider") -> DataFrame:
    """vectors, if all of them come from the provider that embeds the query; else an error, for their distances mean nothing."""
    other = vectors.where(~F.col(column).eqNullSafe(F.lit(provider))).select(column).limit(1).collect()
    if other:
        raise ProviderMismatch(f"the index holds vectors of {other[0][0]!r}, the query is of {provider!r}")
    return vectors


@F.udtf(returnType=StructType([StructField("part", IntegerType()), StructField("text", StringType()), StructField("tokens", IntegerType())]))
class NarrativeChunks:
    """Paragraphs (parted by blank lines) in chunks of about `target` tokens; each begins with the last `overlap` tokens of
    the one before, cut at a word. A token is four characters."""

    def eval(self, text: str, target: int, overlap: int):
        held: list[str] = []
        size, carry, n = 0, "", 0
        for p in [x.strip() for x in (text or "").split("\n\n") if x.strip()] + [None]:
            if held and (p is None or (size + 2 + len(p)) // 4 > target):
                own = "\n\n".join(held)
                whole = f"{carry}\n\n{own}" if carry else own
                yield n, whole, max(1, len(whole) // 4)
                tail = own[-overlap * 4 :] if overlap else ""
                if len(tail) < len(own) and " " in tail:
                    tail = tail[tail.index(" ") + 1 :]
                carry, held, size, n = tail, [], 0, n + 1
            if p is not None:
                size += len(p) + (2 if held else 0)
                held.append(p)
