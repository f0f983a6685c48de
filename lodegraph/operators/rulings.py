"""Evidence paths: ingredient, source, ruling; verdicts, conflicts and links from products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import clean
from lodegraph.operators.packed import packed_values
from lodegraph.session import cut

# Rulings from the most to the least severe.
SEVERITY = ("haram", "mashbooh", "halal")


def severity(ruling: Column) -> Column:
    """Rank of a ruling, 0 the most severe; NULL for an unknown one."""
    out = None
    for i, r in enumerate(SEVERITY):
        out = F.when(ruling == r, i) if out is None else out.when(ruling == r, i)
    return out


def verdicts(rulings: DataFrame, entity: str, ruling: str) -> DataFrame:
    """Per entity the most severe of its rulings, the number of different ones and whether they conflict."""
    s = severity(F.col(ruling))
    return rulings.filter(s.isNotNull() & F.col(entity).isNotNull()).groupBy(entity).agg(F.min_by(ruling, s).alias("verdict"), F.countDistinct(ruling).alias("n_rulings"), (F.countDistinct(ruling) > 1).alias("conflict"))


def ruling_paths(rulings: DataFrame, limit: int | None = 60) -> DataFrame:
    """Distinct chains ingredient -> source -> ruling in a total order; at most ``limit`` of them (a top-k)."""
    rows = rulings.select("ingredient", "source", "source_type", "ruling").filter("ingredient IS NOT NULL AND source IS NOT NULL AND ruling IS NOT NULL").distinct()
    rows = rows.withColumn("chain", F.concat_ws(" -> ", "ingredient", "source", "ruling")).orderBy("ingredient", "source", "ruling", "source_type")
    return rows.limit(limit) if limit else rows


def clean_rulings(df: DataFrame) -> DataFrame:
    """The curated table with missing values as NULL: (row_id, ingredient, source, source_type, ruling, basis)."""
    return df.select("row_id", clean("ingredient_th").alias("ingredient"), clean("source_th").alias("source"), clean("source_type").alias("source_type"), F.lower(clean("ruling")).alias("ruling"), clean("basis_th").alias("basis"))


# Fixed value: shorter aliases are too generic to be looked for.
LEAST_ALIAS = 3


def _aliases_of(values: DataFrame) -> DataFrame:
    """(ingredient, alias): the values of LEAST_ALIAS letters or more, one spelling where only case differs."""
    named = values.filter(F.col("ingredient").isNotNull() & (F.length("alias") >= LEAST_ALIAS))
    return named.groupBy("ingredient", F.lower("alias").alias("__low")).agg(F.min("alias").alias("alias")).select("ingredient", "alias")


def ingredient_aliases(df: DataFrame) -> DataFrame:
    """(ingredient, alias): the values packed in the aliases of all rows of an ingredient, distinct by lower case."""
    return _aliases_of(df.select(clean("ingredient_th").alias("ingredient"), F.explode(packed_values("aliases")).alias("alias")))


def name_terms(df: DataFrame) -> DataFrame:
    """(ingredient, alias): an ingredient's whole name, its English names and its E numbers, of all its rows."""
    i = clean("ingredient_th").alias("ingredient")
    return _aliases_of(df.select(i, F.explode(F.array(clean("ingredient_th"), clean("ingredient_en"), clean("e_number"))).alias("alias")).filter("alias IS NOT NULL"))


def ingredient_terms(df: DataFrame) -> DataFrame:
    """(ingredient, alias): all that an ingredient may be called in a text: its whole name, its English names, its E
    numbers and its aliases, of all its rows."""
    return _aliases_of(name_terms(df).unionByName(ingredient_aliases(df)))


def invalid_rulings(df: DataFrame, required: tuple[str, ...] = ("ingredient_th", "source_th", "ruling")) -> DataFrame:
    """Rows that break the table's rules, one per broken rule: a required field missing, a ruling outside the domain."""
    rules = [F.when(clean(c).isNull(), F.lit(f"missing {c}")) for c in required]
    rules.append(F.when(clean("ruling").isNotNull() & severity(F.lower(clean("ruling"))).isNull(), F.lit("unknown ruling")))
    return df.select("row_id", F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("problem"))


#: Lengths of the runs of letters by which terms are looked up: a term goes by the longest that it holds.
RUNS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64)


def runs_of(text: Column, n: int) -> Column:
    """The runs of ``n`` letters of a text, in one linear pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


#: Terms up to which their automaton is broadcast to the texts; beyond that texts and terms meet by shuffled runs.
MOST_BROADCAST = 100_000


def find_terms(texts: DataFrame, terms: DataFrame, text_id: str, text: str, term_id: str, term: str, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(text_id, term_id, term): every term that occurs in a text, case ignored, once.

    No nested loop. Up to ``most_broadcast`` terms go to all tasks, which read every text once, letter by letter, with an
    automaton of all terms. More terms are met by their rarest runs of letters, see _terms_by_runs. Both give the same. Null
    and empty texts and terms match nothing; of rows with one id, any may hold the term. The driver holds the words of the
    automaton, or a presence filter of the runs, and no more: owners of terms are joined as a table.
    """
    t = cut(terms.select(F.col(term_id).alias("term_id"), F.lower(F.col(term)).alias("term")).filter("term <> ''").distinct())
    d = texts.select(F.col(text_id).alias("text_id"), F.lower(F.col(text)).alias("txt")).filter("text_id IS NOT NULL AND txt <> ''")
    words = t.select("term").distinct()
    small = words.count() <= most_broadcast
    found = _terms_by_automaton(d, words.toArrow().column(0).to_pylist()) if small else _terms_by_runs(d, words)
    return found.distinct().join(t, "term").select("text_id", "term_id", "term")


def _terms_by_automaton(d: DataFrame, words: list[str]) -> DataFrame:
    shared = d.sparkSession.sparkContext.broadcast(words)
    kind = d.schema["text_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(shared.value):
            automaton.add_word(w, i)
        if len(automaton):
            automaton.make_automaton()
        for b in batches:
            hits = [{i for _, i in automaton.iter(x)} if len(automaton) else () for x in b.column(1).to_pylist()]
            at = pa.array([k for k, own in enumerate(hits) for _ in own], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array([shared.value[i] for own in hits for i in own], pa.string())], ["text_id", "term"])

    return d.mapInArrow(read, f"text_id {kind}, term string")


#: Runs known up to which a presence filter of them is made: 32 bits for each, so 16 MB at most.
MOST_PRESENT = 1 << 22


def _terms_by_runs(d: DataFrame, words: DataFrame, most_present: int = MOST_PRESENT) -> DataFrame:
    """A term is known by its rarest run of letters, rarest among the terms, as long as RUNS has it. Texts are cut into runs
    of those lengths, as hashes, which meet the terms by an equi-join without the texts; the pairs that share a run meet the
    text again, by its id, and are compared in full, so equal hashes of other runs do no harm. So a beginning that many terms
    share costs nothing, and what moves is linear in the texts. Runs that no term is known by are kept from the shuffle by a
    presence filter; where more than ``most_present`` runs are known, there is none and all runs are shuffled."""
    sizes = sorted(r["n"] for r in words.select(_longest_run_within(F.length("term")).alias("n")).distinct().collect())
    # a term has one length of runs
    length = _longest_run_within(F.length("term"))
    own = F.array().cast("array<string>")
    for n in sizes:
        own = F.when(length == n, runs_of(F.col("term"), n)).otherwise(own)
    # the regular expression also begins within a letter of two UTF-16 units; what it finds there is no run of the term
    held = words.select("term", F.explode(own).alias("run")).distinct().filter(F.contains("term", "run"))
    shared = held.groupBy("run").agg(F.count("*").alias("n"))
    known = held.join(shared, "run").groupBy("term").agg(F.min(F.struct("n", "run"))["run"].alias("run"))
    known = cut(known.mapInArrow(_hashed, "term string, h long"))
    keys = known.select("h").distinct()
    count = keys.count()
    bits, present = 0, None
    if 0 < count <= most_present:
        bits = max(16, (32 * count - 1).bit_length())
        at = keys.select(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("at")).distinct().toArrow().column(0).to_numpy()
        present = np.zeros(1 << (bits - 3), np.uint8)
        np.bitwise_or.at(present, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    cuts = d.mapInArrow(_cutter(d.sparkSession.sparkContext.broadcast((bits, present)), sizes), f"text_id {d.schema['text_id'].dataType.simpleString()}, h long")
    met = cuts.join(known, "h").select("text_id", "term").distinct()
    return met.join(d, "text_id").filter(F.contains("txt", "term")).select("text_id", "term")


# how the hash of a run is put together of those of shorter ones: RUNS has the sum of each pair
_PARTS = {2: (1, 1), 3: (2, 1), 4: (2, 2), 6: (4, 2), 8: (4, 4), 12: (8, 4), 16: (8, 8), 24: (16, 8), 32: (16, 16), 48: (32, 16), 64: (32, 32)}
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Bytes of text that are hashed at once; a longer text is a piece of its own.
_LETTERS = 1 << 18


def _letters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after another, and the number of each text's."""
    parts = [np.frombuffer(x.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4") for x in texts]
    return np.concatenate(parts).astype(np.uint64), np.array([len(x) for x in parts], np.int64)


def _run_hashes(letters: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the runs of n letters from every letter on that has as many after it), by length."""
    raw = {1: letters}
    for n in RUNS[: RUNS.index(max(sizes)) + 1] if sizes else ():
        if n > len(letters):
            return
        if n > 1:
            a, b = _PARTS[n]
            size = len(letters) - n + 1
            raw[n] = raw[a][:size] + np.uint64(pow(_BASE, a, 1 << 64)) * raw[b][a : a + size]
        if n in sizes:
            h = (raw[n] + np.uint64(n)) * np.uint64(_MIX)
            h = (h ^ (h >> np.uint64(32))) * np.uint64(_BASE)
            yield n, h ^ (h >> np.uint64(29))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, run) with the run's hash; the length of a run is one of RUNS."""
    for b in batches:
        runs = b.column(1).cast(pa.binary()).to_pylist()
        out = np.empty(len(runs), np.uint64)
        by: dict[int, list[int]] = {}
        for i, x in enumerate(runs):
            by.setdefault(len(x.decode("utf-8", "surrogateescape")), []).append(i)
        for n, own in by.items():
            letters, _ = _letters([runs[i] for i in own])
            out[own] = next(h for _, h in _run_hashes(letters, [n]))[::n]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out.view(np.int64))], ["term", "h"])


def _cutter(shared, sizes: list[int]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, present = shared.value
        for b in batches:
            texts, first = b.column(1).cast(pa.binary()).to_pylist(), 0
            while first < len(texts):
                end, size = first + 1, len(texts[first])
                while end < len(texts) and size + len(texts[end]) <= _LETTERS:
                    size += len(texts[end])
                    end += 1
                letters, lengths = _letters(texts[first:end])
                text = np.repeat(np.arange(first, end), lengths)
                left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(letters))
                for n, h in _run_hashes(letters, sizes):
                    if present is None:
                        at = np.arange(len(h))
                    else:
                        k = h >> np.uint64(64 - bits)
                        at = np.flatnonzero(present[k >> np.uint64(3)] >> (k & np.uint64(7)).astype(np.uint8) & 1)
                    # a run ends in the text that it begins in
                    at = at[left[at] >= n]
                    if len(at):
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text[at])), pa.array(h[at].view(np.int64))], ["text_id", "h"])
                first = end

    return read


def _longest_run_within(length: Column) -> Column:
    out = F.lit(None).cast("int")
    for n in RUNS:
        out = F.when(length >= n, n).otherwise(out)
    return out


def longest_term(found: DataFrame) -> DataFrame:
    """One hit per text and term owner: the longest term, ties by the term."""
    w = Window.partitionBy("text_id", "term_id").orderBy(F.desc(F.length("term")), "term")
    return found.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")
