"""Phrase collocations from generalised suffix automata.

Texts are cut into pieces and words. Each task turns its words, some millions at a time, into a generalised suffix automaton of
bounded depth: states are classes of word strings that end at the same places (endpos), with their longest and shortest member,
the number of those places, and the suffix link to the next shorter class. The link tree of that automaton is the suffix tree of
the reversed text, so it is read off the sorted reversed contexts of all places. The strings of each class are enumerated with
their endpos counts and the counts are added over all shards.

A string that occurs often enough consists of words and shorter strings that do, so passes follow each other: words, pairs, strings
of three, and longer ones. The automata of a pass hold only strings whose parts are frequent. The passes hand each other bit sets
of a fixed size: a false hit costs a little work, and no string that is frequent is ever left out, so all counts are exact. Counts
travel under 96 bits of hash. A shard sends the text of a string only if it has its share of the occurrences that make a string
frequent (as large as the shard's share of all words): of each frequent string, one shard at least has that many.

Subsumption follows the suffix link of each counted string, to the string less its first word, and the mirrored link, to the string
less its last one. Links of one word suffice: whatever lies between a phrase and a longer one around it is as frequent as the latter.

Null and edge cases: a null text has no words; a null language is `und` and joins that language's own rows; words are whole,
however long; repeated rows count each time; an empty table, or one without frequent phrases, gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, small, table
from .shingles import U, mix

#: Words of one automaton; a longer text is a shard of its own.
SHARD_WORDS = 4_000_000
#: Bits of the sets of frequent words and of longer frequent strings: 1 MB and 8 MB each at every size of the input.
WORD_BITS, STRING_BITS = 1 << 23, 1 << 26
#: Languages whose numbers of words are known to all tasks: those with the most words. In others all texts of strings are sent.
KNOWN_LANGUAGES = 10_000
#: Parts of a language that are ranked on their own before its best phrases meet.
RANK_PARTS = 32
#: Word of a boundary between pieces. It is no word, since pieces end there.
STOP = "\n"


def words_of(texts: pa.Array) -> pa.StringArray:
    """The words of all texts in a row, A-Z lower-cased, with STOP after each piece."""
    t = pc.ascii_lower(pc.fill_null(texts, ""))
    t = pc.replace_substring(pc.replace_substring_regex(t, r"[.,;:!?\x0A-\x0D]", f" {STOP} "), "\t", " ")
    words = pc.list_flatten(pc.split_pattern(pc.binary_join_element_wise(t, STOP, " "), " "))
    return words.filter(pc.greater(pc.binary_length(words), 0))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, pa.StringArray]]:
    """(lang, ids, dictionary): some millions of words of one language at a time; id 0 is a boundary, id k word k - 1."""
    held: dict[str, list[pa.StringArray]] = {}
    size: dict[str, int] = {}

    def shard(lang: str) -> tuple[str, np.ndarray, pa.StringArray]:
        del size[lang]
        codes = pa.chunked_array(held.pop(lang)).combine_chunks().dictionary_encode()
        names = codes.dictionary
        stop = pc.index(names, STOP).as_py()
        ids = codes.indices.to_numpy()
        rank = np.arange(1, len(names) + 1, dtype=np.int32)
        rank[stop:] -= 1
        rank[stop] = 0
        return lang, rank[ids], pa.concat_arrays([names[:stop], names[stop + 1 :]])

    for batch in batches:
        for lang in pc.unique(batch.column("lang")).to_pylist():
            words = words_of(batch.filter(pc.equal(batch.column("lang"), lang)).column("text"))
            held.setdefault(lang, []).append(words)
            size[lang] = size.get(lang, 0) + len(words)
            # What is held over all languages is bounded, however many there are.
            while sum(size.values()) >= SHARD_WORDS:
                yield shard(max(size, key=size.get))
    for lang in list(held):
        yield shard(lang)


def word_hash(lang: str, words: pa.StringArray) -> np.ndarray:
    """64-bit hashes of words of a language."""
    own = pd.util.hash_array(np.array([lang], object), categorize=False)
    return mix(pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) ^ mix(own)) if len(words) else np.zeros(0, U)


class BitSet:
    """Set of 64-bit hashes by their remainder: holds all that were put in, and a few others."""

    def __init__(self, blocks: np.ndarray, values: np.ndarray, bits: int):
        self.bits, self.data = bits, np.zeros(bits // 64, U)
        self.data[blocks] = values.view(U)

    @staticmethod
    def gather(hashes: DataFrame, bits: int) -> BitSet:
        """From a table with a column h. The driver gets at most bits / 64 numbers, whatever the size of the table."""
        at = F.col("h").bitwiseAND(F.lit(bits - 1))
        bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
        blocks = hashes.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("block")).agg(F.bit_or(bit).alias("value")).toArrow()
        return BitSet(*(blocks.column(c).to_numpy() for c in ("block", "value")), bits)

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h & U(self.bits - 1)
        return ((self.data[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1)).astype(bool)


@dataclass
class SuffixAutomaton:
    """States of a generalised suffix automaton over the strings of up to `depth` words. State s holds the strings of
    shortest[s] to longest[s] words that end at place end[s]; all end at the same count[s] places. link[s] is the state of
    the string that is one word shorter than its shortest, -1 where that is empty."""

    longest: np.ndarray
    shortest: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray

    @staticmethod
    def build(words: np.ndarray, depth: int, reach: np.ndarray | None = None, least: int = 1) -> SuffixAutomaton:
        """words: ids from 1, with 0 at boundaries that no string spans. reach: words of the longest string that counts at each
        place, if not all count. least: strings of fewer words are not asked for, and places where only such ones end are
        left out."""
        places = np.flatnonzero(words if reach is None else reach >= least)
        n = len(places)
        context = np.zeros((depth, n), words.dtype)
        if n:
            context[0] = words[places]
        for d in range(1, depth):
            before = places - d
            within = (before >= 0) & (context[d - 1] != 0) if reach is None else reach[places] > d
            context[d] = np.where(within, words[np.maximum(before, 0)], 0)
        order = np.lexsort(context[::-1])
        context, places = context[:, order], places[order]
        # groups[k]: at the first row of each string of k words, the number of its places; 0 elsewhere.
        new = np.zeros(n, bool)
        new[:1] = True
        groups = [np.zeros(n, np.int32)]
        groups[0][:1] = n
        for d in range(depth):
            new[1:] |= context[d, 1:] != context[d, :-1]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, n))
            g = np.zeros(n, np.int32)
            g[starts] = np.where(context[d, starts] != 0, sizes, 0)
            groups.append(g)
        groups.append(np.zeros(n, np.int32))
        del context
        rows, longest = [], []
        for k in range(1, depth + 1):
            # A string is its class's longest one if no longer string has the same places.
            top = np.flatnonzero((groups[k] > 0) & (groups[k + 1] != groups[k]))
            rows.append(top)
            longest.append(np.full(len(top), k))
        row, longest = np.concatenate(rows), np.concatenate(longest)
        count = np.concatenate([groups[k][top] for k, top in enumerate(rows, 1)]).astype(np.int64)
        shortest = longest.copy()
        for k in range(depth - 1, 0, -1):
            shortest = np.where((shortest == k + 1) & (groups[k][row] == count), k, shortest)
        # The link's class starts where its group of rows does.
        own = row * (n + 1) + count
        by_key = np.argsort(own, kind="stable")
        link = np.full(len(row), -1)
        for k in range(1, depth):
            mine = np.flatnonzero(shortest == k + 1)
            starts = np.flatnonzero(groups[k] > 0)
            first = starts[np.searchsorted(starts, row[mine], "right") - 1]
            link[mine] = by_key[np.searchsorted(own[by_key], first * (n + 1) + groups[k][first])]
        return SuffixAutomaton(longest, shortest, count, places[row], link)

    def strings(self, least: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, ends, counts) of all strings by their number of words."""
        for k in range(least, most + 1):
            has = (self.shortest <= k) & (k <= self.longest)
            yield k, self.end[has], self.count[has]


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, ids, names in shards(batches):
        n = np.bincount(ids, minlength=len(names) + 1)[1:]
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(names), pa.string()), "phrase": names, "n": n.astype(np.int64)})


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lang in pc.unique(b.column("lang")).to_pylist():
            words = b.filter(pc.equal(b.column("lang"), lang)).column("phrase")
            yield pa.RecordBatch.from_pydict({"h": word_hash(lang, words).view(np.int64)})


def string_hashes(words: np.ndarray, most: int) -> list[np.ndarray]:
    """[k]: hashes of the k words that end at each place, from hashes of words."""
    out = [words, words]
    for k in range(2, most + 1):
        h = np.zeros_like(words)
        h[1:] = mix(out[-1][:-1] + mix(words[1:] ^ U(k)))
        out.append(h)
    return out


def _string_counts(sets, totals: dict[str, int], least: int, shortest: int, longest: int):
    """Counts of the strings of so many words all of whose parts pass. sets: of frequent strings of 1, 2, ... words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, names in shards(batches):
            h = string_hashes(np.concatenate([np.zeros(1, U), word_hash(lang, names)])[ids], longest)
            reach = ((ids > 0) & sets[0].value.holds(h[1])).astype(np.int8)
            for k in range(2, longest + 1):
                ok = (reach[1:] == k - 1) & (reach[:-1] >= k - 1)
                if k < shortest:
                    ok &= sets[k - 1].value.holds(h[k][1:])
                reach[1:] += ok
            share = least * int((ids > 0).sum()) / totals[lang] * (1 - 1e-9) if lang in totals else 0  # rounding must not lose a text
            for k, ends, counts in SuffixAutomaton.build(ids, longest, reach, shortest).strings(shortest, longest):
                told = np.flatnonzero(counts >= share)
                parts = [names.take(pa.array(ids[ends[told] - j] - 1)) for j in range(k - 1, -1, -1)]
                phrases = np.full(len(ends), None, object)
                phrases[told] = pc.binary_join_element_wise(*parts, " ").to_numpy(zero_copy_only=False)
                said = np.full(len(ends), None, object)
                said[told] = lang
                key = h[k][ends]
                check = (mix(key ^ mix(h[k - 1][ends])) >> U(33)).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"h": key.view(np.int64), "c": check, "n": counts.astype(np.int32), "lang": pa.array(said, pa.string()), "phrase": pa.array(phrases, pa.string())})

    return run


class Collocations:
    """Phrases of 2 to `most` words that occur at least `least` times in a language and more often than their parts suggest."""

    def __init__(self, docs: DataFrame, text: str = "text", lang: str = "lang", most: int = 5, least: int = 100, share: int = 100):
        """share: a phrase goes if a longer one around it is at least so many per cent as frequent."""
        if most < 2 or least < 1:
            raise ValueError("phrases have two words and one occurrence at least")
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "collocations")
        self.docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
        self.most, self.least, self.share = most, least, share

    def counts(self) -> tuple[DataFrame, DataFrame]:
        """(lang, phrase, k, n) of all frequent strings of 1 to `most` words, and (lang, n) of all words."""
        s, sc = self.scratch, self.spark.sparkContext
        enough = F.col("n") >= self.least
        words = s.save(self.docs.mapInArrow(_word_counts, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "words")
        totals = s.save(words.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
        known = {r["lang"]: r["n"] for r in totals.orderBy(F.desc("n"), "lang").limit(KNOWN_LANGUAGES).collect()}
        phrases = words.where(enough).select("lang", "phrase", F.lit(1).alias("k"), "n")
        sets = [sc.broadcast(BitSet.gather(phrases.mapInArrow(_hashes, "h long"), WORD_BITS))]
        for shortest, longest in ((2, 2), (3, 3), (4, self.most)):
            longest = min(longest, self.most)
            if shortest > longest:
                break
            found = self.docs.mapInArrow(_string_counts(sets, known, self.least, shortest, longest), "h long, c int, n int, lang string, phrase string")
            found = found.groupBy("h", "c").agg(F.sum("n").alias("n"), F.max("lang").alias("lang"), F.max("phrase").alias("phrase")).where(enough)
            found = s.save(found, f"strings-{shortest}")
            sets.append(sc.broadcast(BitSet.gather(found, STRING_BITS)))
            phrases = phrases.unionByName(found.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("k"), "n"))
        for x in sets:
            x.unpersist()
        return phrases, totals

    def maximal(self, phrases: DataFrame) -> DataFrame:
        """The phrases of two words or more that no longer one subsumes: along the suffix link and its mirror image."""
        w = F.split("phrase", " ")
        inner = F.array(F.array_join(F.slice(w, F.lit(2), F.col("k") - 1), " "), F.array_join(F.slice(w, F.lit(1), F.col("k") - 1), " "))
        around = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("around"))
        kept = phrases.where("k > 1").join(around, ["lang", "phrase"], "left")
        # n times 100 could pass 64 bits only beyond 9e16 occurrences.
        return kept.where(F.col("around").isNull() | (100 * F.col("around") < self.share * F.col("n"))).select("lang", "phrase", "k", "n")

    def scored(self) -> DataFrame:
        """lang, phrase, a, l, r, n, score of the phrases that stay; the lowest-scoring cut counts, of equal ones the earliest."""
        phrases, totals = self.counts()
        w = F.split("phrase", " ")
        cuts = self.maximal(phrases).select("lang", "phrase", F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
        cuts = cuts.withColumn("first", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ")).withColumn("rest", F.array_join(F.slice(w, F.col("cut") + 1, F.col("k") - F.col("cut")), " "))
        known = phrases.select("lang", "phrase", "n")
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
        cuts = cuts.join(known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
        cuts = cuts.join(small(totals, count=self.scratch.rows["totals"]), "lang")
        # Products of two decimals of 18 digits are exact in 38; counts reach 1e15.
        whole = lambda c: f"cast({c} as decimal(18,0))"
        score = F.expr(f"({whole('1000 * a')} * {whole('n')}) div ({whole('l')} * {whole('r')})").cast("long")
        best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x"))
        return best.select("lang", "phrase", "a", "x.l", "x.r", "n", "x.score")

    def run(self, top: int = 2000) -> DataFrame:
        """The first `top` phrases of each language with their rank. A language is ranked in parts first, so no task sorts more
        of it than its share, and then RANK_PARTS times `top` rows at most."""
        order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        best = self.scored().withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        out = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
        return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

    def close(self) -> None:
        """Drops the tables that the results read."""
        self.scratch.drop()


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Collocations(table(spark, sf_dir, "documents")).run()


OP12_SQL = """
with p as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i : i + k - 1], ' '))) as phrase from w, range(1, 6) as t(k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as n from g group by all),
c as (select * from f where k > 1 and n >= 100),
m as (
  select * from c
  where not exists (select 1 from c as d where d.lang = c.lang and d.k > c.k and contains(' ' || d.phrase || ' ', ' ' || c.phrase || ' ') and 100 * d.n >= 100 * c.n)),
cuts as (
  select m.lang, m.phrase, m.n as a, t.cut, array_to_string(string_split(m.phrase, ' ')[: t.cut], ' ') as first, array_to_string(string_split(m.phrase, ' ')[t.cut + 1 :], ' ') as rest
  from m, range(1, 5) as t(cut) where t.cut < m.k),
s as (
  select cuts.*, fl.n as l, fr.n as r, (select sum(n) from f where f.k = 1 and f.lang = cuts.lang) as n
  from cuts join f as fl on fl.lang = cuts.lang and fl.phrase = cuts.first and fl.k = cuts.cut
  join f as fr on fr.lang = cuts.lang and fr.phrase = cuts.rest),
b as (
  select *, ((1000::hugeint * a * n) // (l::hugeint * r))::bigint as score,
    row_number() over (partition by lang, phrase order by (1000::hugeint * a * n) // (l::hugeint * r), cut) as best
  from s),
k as (select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n::bigint as n, score from b where best = 1)
select * from k where rank <= 2000
"""
