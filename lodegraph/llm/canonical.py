"""Free-entered values mapped to the closest entry of a canonical list, with the values that resemble none reported."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import clean
from lodegraph.session import cut

# Words around a name that say what it is, in the order in which they are taken off.
PROVINCE_AFFIXES = (r"^province of ", r"^changwat ", r"^จังหวัด\s*", r"^จ\.\s*", r",\s*th(ailand)?$", r" province$")

# Spellings of one sound in romanised Thai, applied in order.
THAI_SOUNDS = (("ph", "p"), ("th", "t"), ("kh", "k"), ("ch", "j"), ("ee", "i"), ("oo", "u"), ("ay", "ai"), ("ae", "e"), ("ar", "a"), ("or", "o"), ("l", "r"))

#: Letters from the start of a string of which deletes are made. Two strings within k edits have starts of this length that
#: share a string after k deletes on either side, so nothing is lost and no name has more than some 500 deletes.
PREFIX = 14
#: Names up to which the dictionary is broadcast (about 1,000 entries a name at most); a longer list is joined as a table.
MOST_BROADCAST = 2_000

_TONES = set("็่้๊๋์ํ")
_VOWELS = set("aeiouyะัาำิีึืุูเแโใไ")


def letters(value: str) -> str:
    """A value's letters and marks: compatible forms, case, spacing, digits and punctuation do not count."""
    v = unicodedata.normalize("NFKC", value).casefold().replace("ํา", "ำ").replace("เเ", "แ")
    return "".join(c for c in v if unicodedata.category(c)[0] in "LM")


def bare(value: str, affixes: tuple[str, ...]) -> str:
    """A value's letters without the affixes."""
    v = unicodedata.normalize("NFKC", value).casefold()
    v = re.sub(r"[\s_\-]+", " ", "".join(c for c in v if unicodedata.category(c) != "Cf")).strip()
    for a in affixes:
        v = re.sub(a, "", v).strip()
    return letters(v)


def sound_key(s: str, sounds: tuple[tuple[str, str], ...]) -> str:
    """A coarser key: one spelling per sound, no tone marks, no doubled letters."""
    for a, b in sounds:
        s = s.replace(a, b)
    s = "".join(c for c in s if c not in _TONES)
    return re.sub(r"(.)\1+", r"\1", s)


def most_edits(length):
    """The bound of the look-up, by the longer side's length: one edit up to three letters, two up to nine, then three."""
    return np.where(np.asarray(length) <= 3, 1, np.where(np.asarray(length) <= 9, 2, 3))


def deletes(s: str, most: int) -> set[str]:
    """The first PREFIX letters of a string with up to ``most`` of them left out."""
    s = s[:PREFIX]
    out = {s}
    for k in range(1, min(most, len(s)) + 1):
        out.update("".join(c) for c in combinations(s, len(s) - k))
    return out


def keys(s: str) -> set[str]:
    """Dictionary keys of a string: deletes up to the bound that holds for the longest string within reach of it."""
    return deletes(s, int(most_edits(len(s) + 3))) if s else set()


def _codes(strings: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(strings), width), np.uint32)
    for i, x in enumerate(strings):
        out[i, : len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def damerau_levenshtein(a: list[str], b: list[str], weighted: bool = False) -> np.ndarray:
    """Optimal string alignment distances of pairs, all at once. Weighted: tone marks cost 0.3, a doubled letter 0.6, a
    vowel for a vowel 0.6, a swap of neighbours 0.7, anything else 1."""
    if not a:
        return np.zeros(0)
    la, lb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    x, y = _codes(a, max(1, la.max())), _codes(b, max(1, lb.max()))
    n, every = len(a), np.arange(len(a))

    def gaps(c: np.ndarray) -> np.ndarray:
        if not weighted:
            return np.ones(c.shape)
        double = np.zeros(c.shape, bool)
        double[:, 1:] = c[:, 1:] == c[:, :-1]
        return np.where(np.isin(c, [ord(t) for t in _TONES]), 0.3, np.where(double, 0.6, 1.0))

    vowels = [ord(v) for v in _VOWELS]
    ga, gb, va, vb = gaps(x), gaps(y), np.isin(x, vowels), np.isin(y, vowels)
    one = np.concatenate([np.zeros((n, 1)), np.cumsum(gb, axis=1)], axis=1)
    two, out = one, np.where(la == 0, one[every, lb], 0.0)
    for i in range(x.shape[1]):
        row = np.empty_like(one)
        row[:, 0] = one[:, 0] + ga[:, i]
        for j in range(y.shape[1]):
            same = x[:, i] == y[:, j]
            sub = np.where(same, 0.0, np.where(va[:, i] & vb[:, j], 0.6, 1.0) if weighted else 1.0)
            best = np.minimum(np.minimum(one[:, j] + sub, one[:, j + 1] + ga[:, i]), row[:, j] + gb[:, j])
            if i and j:
                swap = (x[:, i] == y[:, j - 1]) & (x[:, i - 1] == y[:, j]) & ~same
                best = np.where(swap, np.minimum(best, two[:, j - 1] + (0.7 if weighted else 1.0)), best)
            row[:, j + 1] = best
        two, one = one, row
        done = la == i + 1
        out[done] = row[every[done], lb[done]]
    return out


def closest(pairs: pd.DataFrame, least_agreement: float) -> pd.DataFrame:
    """Of candidate pairs (value, v, s, id, plain, sound, n) those within the bound, with their cost. A pair is within it
    when its letters or its sounds are, and the entry's letters or sounds agree with the value's by ``least_agreement``."""
    width = np.maximum(pairs["v"].str.len(), pairs["plain"].str.len()).to_numpy(), np.maximum(pairs["s"].str.len(), pairs["sound"].str.len()).to_numpy()
    apart = np.abs(pairs["v"].str.len() - pairs["plain"].str.len()).to_numpy() <= most_edits(width[0]), np.abs(pairs["s"].str.len() - pairs["sound"].str.len()).to_numpy() <= most_edits(width[1])
    some = apart[0] | apart[1]
    pairs, width = pairs[some].reset_index(drop=True), (width[0][some], width[1][some])
    v, s, plain, sound = (pairs[c].tolist() for c in ("v", "s", "plain", "sound"))
    d, e = damerau_levenshtein(v, plain), damerau_levenshtein(s, sound)
    near = (d <= most_edits(width[0])) | (e <= most_edits(width[1]))
    agree = np.maximum(1 - d / np.maximum(1, width[0]), 1 - e / np.maximum(1, width[1]))
    ok = near & (agree >= least_agreement)
    cost = damerau_levenshtein(v, plain, weighted=True) + damerau_levenshtein(s, sound, weighted=True)
    return pairs.assign(cost=np.round(cost, 6))[ok]


@dataclass
class CanonicalList:
    """A reference list with its symmetric-delete dictionary.

    ``entries`` is (id, name, how often the name occurs) for every name or code of every entry. A value and a name that
    are no more edits apart than most_edits() allows, by letters or by sounds, share a key of the dictionary.
    """

    entries: list[tuple[int, str, int]]
    affixes: tuple[str, ...] = ()
    sounds: tuple[tuple[str, str], ...] = ()
    no_entry: tuple[str, ...] = ()
    least_agreement: float = 0.5
    names: list[tuple[int, str, str, int]] = field(init=False)

    def __post_init__(self):
        self.names = [(i, letters(n), sound_key(letters(n), self.sounds), f) for i, n, f in self.entries if n and letters(n)]
        self.exact: dict[str, list[int]] = defaultdict(list)
        self.index: dict[str, list[int]] = defaultdict(list)
        for at, (_, plain, sound, _) in enumerate(self.names):
            self.exact[plain].append(at)
            for key in keys(plain) | keys(sound):
                self.index[key].append(at)
        self.no_keys = {letters(x) for x in self.no_entry}

    def find(self, values: list[str]) -> list[int]:
        """Per value the id of the entry meant, or -1: an exact name, else the least cost among the names that the
        dictionary holds within its bound, then the more frequent name, then the smaller id."""
        out, todo = [-1] * len(values), []
        for i, value in enumerate(values):
            v = letters(value)
            if v not in self.exact:
                v = bare(value, self.affixes)
            if not v or v in self.no_keys or letters(value) in self.no_keys:
                continue
            if v in self.exact:
                out[i] = min((-self.names[at][3], self.names[at][0]) for at in self.exact[v])[1]
                continue
            s = sound_key(v, self.sounds)
            near = {at for key in keys(v) | keys(s) for at in self.index.get(key, ())}
            todo += [(i, v, s, *(self.names[at][k] for k in (0, 1, 2, 3))) for at in near]
        if todo:
            pairs = pd.DataFrame(todo, columns=["value", "v", "s", "id", "plain", "sound", "n"])
            best = closest(pairs, self.least_agreement).sort_values(["value", "cost", "n", "id"], ascending=[True, True, False, True]).drop_duplicates("value")
            for i, got in zip(best["value"], best["id"]):
                out[i] = int(got)
        return out


def _spread(df: DataFrame, column: str) -> DataFrame:
    """A look-up costs far more than its few bytes tell: rows are spread by number and by a hash of their own, or planning
    would merge this exchange with an earlier one and the tasks with each other."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, F.xxhash64(column))


def look_up_broadcast(values: DataFrame, reference: CanonicalList) -> DataFrame:
    """(value, canon_id): every task looks its values up in the broadcast dictionary of a list of bounded size."""
    shared = values.sparkSession.sparkContext.broadcast(reference)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"value": b["value"], "canon_id": shared.value.find(b["value"].tolist())})

    return _spread(values, "value").mapInPandas(look_up, "value string, canon_id long")


def look_up_joined(values: DataFrame, names: DataFrame, affixes: tuple[str, ...], sounds: tuple, no_entry: tuple[str, ...], least_agreement: float) -> DataFrame:
    """(value, canon_id) by the same rules for a list of any size: keys of values and names (id, name, n) meet in a join."""
    no_keys = {letters(x) for x in no_entry}

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            plain = [letters(x) for x in b["name"]]
            yield pd.DataFrame({"id": b["id"], "plain": plain, "sound": [sound_key(x, sounds) for x in plain], "n": b["n"]})

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            whole, own = [letters(x) for x in b["value"]], [bare(x, affixes) for x in b["value"]]
            barred = [v in no_keys or w in no_keys for w, v in zip(whole, own)]
            yield pd.DataFrame({"value": b["value"], "whole": whole, "v": own, "s": [sound_key(x, sounds) for x in own], "barred": barred})

    def keyed(a: str, b: str, columns: list[str]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for x in batches:
                for part in (x.iloc[i : i + 500] for i in range(0, len(x), 500)):
                    yield part.assign(key=[list(keys(p) | keys(q)) for p, q in zip(part[a], part[b])]).explode("key")[["key", *columns]]

        return run

    n = cut(names.mapInPandas(named, "id long, plain string, sound string, n long").filter("plain <> ''"))
    q = cut(_spread(values, "value").mapInPandas(asked, "value string, whole string, v string, s string, barred boolean").filter("NOT barred"))
    top = lambda df: df.groupBy("value").agg(F.min_by("id", F.struct("cost", -F.col("n"), "id")).alias("canon_id"))
    free = F.lit(0.0).alias("cost")
    by_whole = q.join(n, q["whole"] == n["plain"]).select("value", "id", "n", F.lit(-2.0).alias("cost"))
    by_bare = q.join(n, q["v"] == n["plain"]).select("value", "id", "n", free)
    exact = cut(by_whole.unionByName(by_bare))
    rest = q.join(exact.select("value").distinct(), "value", "left_anti")
    probes = rest.mapInPandas(keyed("v", "s", ["value", "v", "s"]), "key string, value string, v string, s string")
    entries = n.mapInPandas(keyed("plain", "sound", ["id", "plain", "sound", "n"]), "key string, id long, plain string, sound string, n long")
    pairs = probes.join(entries, "key").drop("key").distinct()

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield closest(b, least_agreement)[["value", "id", "n", "cost"]]

    near = pairs.mapInPandas(ranked, "value string, id long, n long, cost double")
    found = top(exact.unionByName(near))
    return values.join(found, "value", "left").select("value", F.coalesce("canon_id", F.lit(-1).cast("long")).alias("canon_id"))


def map_column(
    df: DataFrame, row_id: str, column: str, canonical: DataFrame, id_column: str, form_column: str, name_columns: list[str], affixes: tuple[str, ...] = (), sounds: tuple[tuple[str, str], ...] = (),
    no_entry: tuple[str, ...] = (), least_agreement: float = 0.5, most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """(row_id, field, canon_id) for every row whose value is neither missing nor exactly a canonical form.

    canon_id is the entry meant by any of its names, -1 where none resembles it: where none is within the bound of the
    dictionary (most_edits(), by letters or sounds) or fewer than ``least_agreement`` of the letters agree, or the value
    is one of ``no_entry``. Missing means null, blank or a word for a missing value. Rows with equal values get equal ids
    and each distinct value is looked up once; an empty list gives -1 throughout. Names are ranked by the weighted
    distance, then by how often the name is entered exactly, then by id.

    A list of up to ``most_broadcast`` names is brought to the driver and its dictionary broadcast; a longer one is joined
    as a table, with the same result.
    """
    arrays = {f.name for f in canonical.schema if f.dataType.typeName() == "array"}
    names = [F.explode_outer(n) if n in arrays else F.col(n) for n in [form_column, *name_columns]]
    long = None
    for n in names:
        part = canonical.select(F.col(id_column).cast("long").alias("id"), n.alias("name"))
        long = part if long is None else long.unionByName(part)
    long = long.filter(clean("name").isNotNull()).distinct()
    values = df.select(F.col(row_id).alias("row_id"), F.col(column).alias("value")).filter(clean("value").isNotNull())
    counted = cut(values.groupBy("value").agg(F.count("*").alias("n")))
    # the reference frequency of a name: how often it is entered exactly
    listed = cut(long.join(counted.withColumnRenamed("value", "name"), "name", "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("n")))
    forms = canonical.select(F.col(form_column).alias("value")).filter("value IS NOT NULL").distinct()
    loose = counted.join(forms, "value", "left_anti").select("value")
    if listed.count() <= most_broadcast:
        reference = CanonicalList([(r["id"], r["name"], r["n"]) for r in listed.collect()], affixes, sounds, no_entry, least_agreement)
        mapped = look_up_broadcast(loose, reference)
    else:
        mapped = look_up_joined(loose, listed, affixes, sounds, no_entry, least_agreement)
    return values.join(mapped, "value").select("row_id", F.lit(column).alias("field"), "canon_id")
