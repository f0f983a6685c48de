"""Evaluation passages that occur, whole or in part, in the documents of a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.llm.grams import chosen, chunks, hashes, kept, winnow
from lodegraph.session import cut

STRETCH = 50
SHARE = 0.3
GRAM = 40
_WINDOW = STRETCH - GRAM + 1

#: The presence filter over the passages' terms: bits per term aimed at, and its size bounds as powers of two (16 MB).
_BITS_PER_TERM, _LEAST_BITS, _MOST_BITS = 16, 16, 27
#: Share of a passage's letters that its most frequent terms may cover and yet be left out of the candidate search.
_SPARE = 0.15
#: Postings of a term that one task meets.
_HOT = 50_000
#: A term in fewer documents than this is not worth leaving out.
_RARE = 20

_U = np.uint64


def _bits(h: np.ndarray, log2: int) -> tuple[np.ndarray, np.ndarray]:
    mask = _U((1 << log2) - 1)
    return h & mask, (h >> _U(30)) & mask


def _present(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8)) & 1 == 1


def _passage_terms(passages: DataFrame, passage_id: str, text: str) -> DataFrame:
    """Positional postings of the passages: (h, passage_id, pos, prev, next, n), n being the letters of the passage and
    prev and next the neighbouring postings' positions."""

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for pid, t in zip(b["passage_id"], b["text"]):
                x = kept(t)
                if len(x) < STRETCH:
                    continue
                h = hashes(x, GRAM)
                pos = winnow(h, _WINDOW)
                last = len(x) - GRAM + 1
                out.append(pd.DataFrame({"h": h[pos].view(np.int64), "passage_id": pid, "pos": pos, "prev": np.r_[-1, pos[:-1]], "next": np.r_[pos[1:], last], "n": len(x)}))
            if out:
                yield pd.concat(out)

    present = passages.select(F.col(passage_id).cast("long").alias("passage_id"), F.col(text).alias("text")).filter("passage_id IS NOT NULL AND text IS NOT NULL")
    return present.mapInPandas(terms, "h long, passage_id long, pos int, prev int, next int, n int")


def _presence_filter(terms: DataFrame, log2: int) -> np.ndarray:
    """A bitmap of the terms' hashes, two bits each. Tasks send the blocks of it that they touch, blocks are united by
    shuffle, and the whole, of fixed size, comes to the driver."""
    block_bits = 15
    block_bytes = 1 << (block_bits - 3)

    def touch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << log2, dtype=bool)
        for b in batches:
            for at in _bits(b["h"].to_numpy().view(_U), log2):
                own[at.astype(np.int64)] = True
        packed = np.packbits(own, bitorder="little").reshape(-1, min(block_bytes, len(own) // 8))
        some = np.flatnonzero(packed.any(axis=1))
        for s in np.array_split(some, max(1, len(some) // 256)):
            if len(s):
                yield pd.DataFrame({"block": s, "bits": [packed[i].tobytes() for i in s]})

    def unite(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in pdf["bits"]])
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "bits": [bits.tobytes()]})

    rows = terms.select("h").distinct().mapInPandas(touch, "block long, bits binary").groupBy("block").applyInPandas(unite, "block long, bits binary").collect()
    whole = np.zeros(max(1, (1 << log2) // 8), dtype=np.uint8).reshape(-1, min(block_bytes, (1 << log2) // 8))
    for r in rows:
        whole[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return whole.reshape(-1)


def _corpus_postings(docs: DataFrame, doc_id: str, text: str, bitmap: np.ndarray, log2: int) -> DataFrame:
    """Positional postings of the corpus, (h, doc_id, pos), of all terms that the presence filter lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bm = shared.value
        for b in batches:
            out = []
            for ids, parts in chunks(b["doc_id"].tolist(), b["text"].tolist()):
                doc, pos, h = chosen(parts, GRAM, _WINDOW)
                for which in (0, 1):
                    hit = _present(bm, _bits(h, log2)[which])
                    doc, pos, h = doc[hit], pos[hit], h[hit]
                if len(h):
                    out.append(pd.DataFrame({"h": h.view(np.int64), "doc_id": np.array(ids, dtype=np.int64)[doc], "pos": pos}))
            if out:
                yield pd.concat(out)

    present = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter(f"doc_id IS NOT NULL AND length(text) >= {STRETCH}")
    return present.mapInPandas(postings, "h long, doc_id long, pos int")


def _rare_terms(terms: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Terms without each passage's most frequent ones, as far as those can cover no more than ``_SPARE`` of it; with
    ``spared``, the letters that they can cover."""
    joined = terms.join(frequencies, "h", "left").select("h", "passage_id", "pos", "prev", "next", "n", F.coalesce("df", F.lit(0)).alias("df"))
    # only passages with a frequent term need to be looked at as a whole; a passage is as long as its text
    frequent = F.max("df").over(Window.partitionBy("passage_id")) >= _RARE
    marked = joined.withColumn("frequent", frequent)

    def spare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable").reset_index(drop=True)
        pos, df, n = pdf["pos"].to_numpy(), pdf["df"].to_numpy(), int(pdf["n"].iloc[0])
        out = np.zeros(len(pdf), dtype=bool)

        def reach(mask: np.ndarray) -> int:
            """Letters of the stretches that hold none but left-out terms."""
            total, i = 0, 0
            while i < len(mask):
                if mask[i]:
                    j = i
                    while j + 1 < len(mask) and mask[j + 1]:
                        j += 1
                    total += min(n, pos[j] + GRAM + _WINDOW - 1) - max(0, pos[i] - _WINDOW + 1)
                    i = j
                i += 1
            return total

        spared = 0
        for v in np.unique(df[df >= _RARE])[::-1]:
            more = out | (df == v)
            r = reach(more)
            if r > _SPARE * n:
                break
            out, spared = more, r
        pdf["spared"] = spared
        return pdf.loc[~out, ["h", "passage_id", "pos", "prev", "next", "n", "spared"]]

    kept_terms = marked.filter("frequent").drop("frequent").groupBy("passage_id").applyInPandas(spare, "h long, passage_id long, pos int, prev int, next int, n int, spared int")
    return marked.filter("NOT frequent").select("h", "passage_id", "pos", "prev", "next", "n", F.lit(0).alias("spared")).unionByName(kept_terms)


def _stretches(doc: np.ndarray, passage: np.ndarray) -> list[tuple[int, int, int]]:
    """(position in the passage, position in the document, letters) of the stretches of at least STRETCH letters that both
    hold, compared exactly; of several places in the document the first."""
    hp, hd = hashes(passage, STRETCH), hashes(doc, STRETCH)
    if not len(hp) or not len(hd):
        return []
    order = np.argsort(hd, kind="stable")
    at = np.searchsorted(hd[order], hp)
    some = np.flatnonzero((at < len(hd)) & (hd[order][np.minimum(at, len(hd) - 1)] == hp))
    out: list[tuple[int, int, int]] = []
    for p in some.tolist():
        d = int(order[at[p]])
        if np.array_equal(doc[d : d + STRETCH], passage[p : p + STRETCH]):
            if out and p - out[-1][0] == d - out[-1][1] and p <= out[-1][0] + out[-1][2] - STRETCH + 1:
                out[-1] = (out[-1][0], out[-1][1], p + STRETCH - out[-1][0])
            else:
                out.append((p, d, STRETCH))
    return out


def _covered(stretches: list[tuple[int, int, int]]) -> int:
    """Letters of the passage that the stretches cover, each once."""
    total, end = 0, 0
    for p, _, n in sorted(stretches):
        total += max(0, p + n - max(p, end))
        end = max(end, p + n)
    return total


def _candidates(docs: DataFrame, terms: DataFrame, n: int, doc_id: str, doc_text: str) -> DataFrame:
    """(doc_id, passage_id) of the pairs that may reach the share, for a block of the passages' terms."""
    log2 = int(np.clip(np.ceil(np.log2(max(1, n) * _BITS_PER_TERM)), _LEAST_BITS, _MOST_BITS))
    bitmap = _presence_filter(terms, log2)
    postings = cut(_corpus_postings(docs, doc_id, doc_text, bitmap, log2))
    frequencies = postings.groupBy("h").agg(F.count("*").alias("df"))
    p = _rare_terms(terms, frequencies).select("h", "passage_id", F.col("pos").alias("p_pos"), "prev", "next", "n", "spared")
    keys = ["h"]
    # a term of very many documents is met in parts of them; there is at most one such term for so many postings
    hot = cut(frequencies.filter(F.col("df") > _HOT).select("h", F.ceil(F.col("df") / _HOT).cast("int").alias("parts")))
    if not hot.isEmpty():
        keys = ["h", "part"]
        parts = F.coalesce("parts", F.lit(1))
        p = p.join(F.broadcast(hot), "h", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
        postings = postings.join(F.broadcast(hot), "h", "left").withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int")).drop("parts")
    hits = postings.join(p, keys).select("doc_id", "passage_id", (F.col("pos") - F.col("p_pos")).alias("offset"), "p_pos", "prev", "next", "n", "spared")
    line = Window.partitionBy("doc_id", "passage_id", "offset").orderBy("p_pos")
    # a stretch begins and ends no more than _WINDOW - 1 letters beyond the postings that its own windows choose; what
    # lies beyond those was chosen by windows that reach out of the stretch and need not be chosen in the document. A
    # posting that follows its neighbour moves the end, one on its own begins a run
    end = lambda c: F.least(F.col("n"), F.col(c) + GRAM + _WINDOW - 1)
    adds = F.when(F.lag("p_pos").over(line) == F.col("prev"), end("p_pos") - end("prev")).otherwise(end("p_pos") - F.greatest(F.lit(0), F.col("p_pos") - (_WINDOW - 1)))
    reached = hits.withColumn("adds", adds).groupBy("doc_id", "passage_id").agg(F.sum("adds").alias("most"), F.first("n").alias("n"), F.first("spared").alias("spared"))
    return reached.filter(F.col("most") + F.col("spared") >= SHARE * F.col("n") - 1e-9).select("doc_id", "passage_id")


def leaks(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", passage_id: str = "passage_id", passage_text: str = "text", most_bits: int = _MOST_BITS) -> DataFrame:
    """(doc_id, passage_id, share, stretches): every document that holds at least SHARE of a passage's letters and digits in
    stretches of STRETCH or more, with the stretches: their positions, in letters and digits, in passage and document and
    their length.

    Spacing, punctuation, case, digit script and invisible characters do not count. Passages with fewer than STRETCH
    letters leak nowhere; null and empty texts hold nothing; copies of a document or a passage are reported each.

    A positional inverted index, distributed by term. A term is a run of GRAM letters that is the least, by hash, of
    some window of runs: any shared stretch of STRETCH letters has at least one common term. Corpus postings are kept
    only where a fixed-size presence filter of the passages' terms lets them pass, so what is shuffled follows the
    matches, not the corpus; passages of more terms than the filter serves are taken in blocks. Per passage the terms are taken from the rarest on; the most frequent ones (stock
    sentences) are left out as long as they can cover only a small share of it, which is then allowed for, so nothing
    is lost. Lists are joined by term and aligned by offset; where aligned postings could not cover the share even if
    every run of them reached a window further at both ends, the pair is dropped. Proximity is the sum over offsets. The few pairs
    that remain are compared letter by letter.
    """
    spark = docs.sparkSession
    terms = cut(_passage_terms(passages, passage_id, passage_text))
    n = terms.count()
    blocks = max(1, -(-n * _BITS_PER_TERM >> most_bits))
    pairs = None
    for i in range(blocks):
        own = terms if blocks == 1 else terms.filter(F.pmod(F.xxhash64("passage_id"), F.lit(blocks)) == i)
        part = cut(_candidates(docs, own, -(-n // blocks), doc_id, doc_text))
        pairs = part if pairs is None else pairs.unionByName(part)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, last, doc = [], None, None
            for d, q, dt, pt in zip(b["doc_id"], b["passage_id"], b["doc_text"], b["passage_text"]):
                if d != last:
                    last, doc = d, kept(dt)
                own = kept(pt)
                found = _stretches(doc, own)
                c = _covered(found)
                if c and c >= SHARE * len(own):
                    out.append((d, q, c / len(own), [{"p_pos": p, "d_pos": x, "n": m} for p, x, m in found]))
            if out:
                yield pd.DataFrame(out, columns=["doc_id", "passage_id", "share", "stretches"])

    # the candidates are few: their texts are fetched by a semi-join on the ids, never by moving the corpus
    wanted = _id_filter(spark, pairs, "doc_id")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("doc_text")).filter(F.col("doc_text").isNotNull()).filter(wanted)
    q = passages.select(F.col(passage_id).cast("long").alias("passage_id"), F.col(passage_text).alias("passage_text")).filter(F.col("passage_text").isNotNull())
    return pairs.join(q, "passage_id").join(d, "doc_id").mapInPandas(verify, "doc_id long, passage_id long, share double, stretches array<struct<p_pos:int,d_pos:int,n:int>>").distinct()


def _id_filter(spark, pairs: DataFrame, column: str):
    """A predicate that every id of the pairs meets and few others do: a Bloom filter of bounded size, so that a scan
    drops the texts of all other documents before any shuffle."""
    n = pairs.select(column).distinct().count()
    if n == 0:
        return F.lit(False)
    log2 = int(np.clip(np.ceil(np.log2(n * 16)), 10, _MOST_BITS))
    hashed = pairs.select(F.xxhash64(column).alias("h"))
    bitmap = spark.sparkContext.broadcast(_presence_filter(hashed, log2))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        u = h.to_numpy().view(_U)
        ok = np.ones(len(u), dtype=bool)
        for at in _bits(u, log2):
            ok &= _present(bitmap.value, at)
        return pd.Series(ok)

    return maybe(F.xxhash64(F.col(column)))
