"""Documents combined into containers of a fixed number of tokens."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.session import cut

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
CONTAINER = 2048

ITEM = "doc_id long, piece int, token_from int, tokens int"
_OUT = f"container string, open boolean, used int, items array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>"


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts tokens with a public tokenizer, by the kind of its file: a sentencepiece model or tiktoken ranks. The file
    is read here, on the driver, and travels with the function; it is as small as its vocabulary."""
    with open(path, "rb") as f:
        data = f.read()
    if path.endswith(".model"):

        def load():
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            return lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]

    elif path.endswith(".tiktoken"):

        def load():
            import base64

            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
            # Fixed value: the published pattern that splits text before merging.
            pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            enc = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [len(enc.encode_ordinary(t)) for t in texts]

    else:

        def load():
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(data.decode())
            t.encode_special_tokens = True
            return lambda texts: [len(x.ids) for x in t.encode_batch_fast(texts, add_special_tokens=False)]

    state: list = []

    def count(texts: list[str]) -> list[int]:
        if not state:
            state.append(load())
        return state[0](texts)

    return count


class OpenWindows:
    """Bounded-space best-fit packing: at most ``most`` containers are open. An item goes to the open container that it
    fills best; when it fits none, the fullest one is emitted if no more may be open, and a new one is opened."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.left: list[tuple[int, int]] = []
        self.held: dict[int, list[tuple]] = {}
        self.made = 0

    def place(self, item: tuple) -> tuple[int, list[tuple]] | None:
        size = item[3]
        at = bisect_left(self.left, (size, -1))
        done = None
        if at < len(self.left):
            room, k = self.left.pop(at)
        else:
            if len(self.left) >= self.most:
                _, full = self.left.pop(0)
                done = full, self.held.pop(full)
            room, k = self.capacity, self.made
            self.made += 1
            self.held[k] = []
        self.held[k].append(item)
        if room == size:
            # full to the brim: nothing but empty items could follow; the one that had to go waits its turn
            if done is None:
                return k, self.held.pop(k)
            insort(self.left, (0, k))
        else:
            insort(self.left, (room - size, k))
        return done

    def rest(self) -> Iterator[tuple[int, list[tuple]]]:
        for _, k in self.left:
            yield k, self.held[k]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["container", "open", "used", "items"])


def _row(prefix: str, k: int, items: list[tuple], is_open: bool) -> tuple:
    return f"{prefix}-{k}", is_open, sum(i[3] for i in items), [dict(zip(("doc_id", "piece", "token_from", "tokens"), i)) for i in items]


def pack(docs: DataFrame, doc_id: str, text: str, tokenizer: str = TOKENIZER, capacity: int = CONTAINER, windows: int = 512, merge: int = 16) -> DataFrame:
    """One row per container: (container, used, space, n_items, items), items being (doc_id, piece, token_from, tokens).

    A document is one item, undivided. One longer than ``capacity`` tokens is cut at multiples of it; its last, shorter
    piece is an item like any other. Null and empty texts are no items, nor are texts of which the tokenizer makes no
    token. Repeated rows are packed each. An empty table gives no container.

    Sizes are counted and items packed in one narrow pass over the scan: per partition ``windows`` containers are open
    at a time, and items are placed as they come (sorted ones would close the large ones' containers before the small
    ones that fill them arrive). What is open at a partition's end is merged: the items of every ``merge`` partitions' open containers are packed again by one task, from the largest down, in rounds, until one
    task holds the last ones. A round's input is at most ``windows`` containers per partition, so no task's grows with the
    data. Texts never leave their partition.
    """
    count = token_counter(tokenizer)

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefix = f"0-{TaskContext.get().partitionId()}"
        held = OpenWindows(capacity, windows)
        full = 0
        for b in batches:
            rows, items = [], []
            ids, texts = b["doc_id"].tolist(), b["text"].tolist()
            for d, n in zip(ids, count(texts)):
                for piece in range(-(-n // capacity)):
                    size = min(capacity, n - piece * capacity)
                    item = (d, piece, piece * capacity, size)
                    if size == capacity:
                        rows.append(_row(f"{prefix}-full", full, [item], False))
                        full += 1
                    else:
                        items.append(item)
            for item in items:
                done = held.place(item)
                if done:
                    rows.append(_row(prefix, *done, False))
            if rows:
                yield _frame(rows)
        rest = [_row(prefix, k, items, True) for k, items in held.rest()]
        if rest:
            yield _frame(rest)

    present = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL AND text <> ''")
    packed = cut(present.mapInPandas(first, _OUT))
    parts = max(1, packed.rdd.getNumPartitions())
    closed = [packed.filter("NOT open")]
    left, level = packed.filter("open"), 0
    while True:
        level += 1
        parts = -(-parts // merge)
        left = cut(_merge(left, capacity, windows, parts, level, last=parts == 1))
        closed.append(left.filter("NOT open"))
        if parts == 1:
            break
        left = left.filter("open")
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return out.select("container", "used", (F.lit(capacity) - F.col("used")).alias("space"), F.size("items").alias("n_items"), "items")


def _merge(left: DataFrame, capacity: int, windows: int, parts: int, level: int, last: bool) -> DataFrame:
    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prefix = f"{level}-{TaskContext.get().partitionId()}"
        items = sorted(((i["doc_id"], i["piece"], i["token_from"], i["tokens"]) for b in batches for own in b["items"] for i in own), key=lambda i: (-i[3], i[0], i[1]))
        held = OpenWindows(capacity, len(items) + 1 if last else windows)
        rows = [_row(prefix, *done, False) for done in map(held.place, items) if done]
        rows += [_row(prefix, k, own, not last) for k, own in held.rest()]
        if rows:
            yield _frame(rows)

    return left.repartition(parts).mapInPandas(again, _OUT)


def fill_report(containers: DataFrame) -> DataFrame:
    """The fill of all containers: how many there are, tokens held, space left, the share filled and the least fill."""
    return containers.agg(
        F.count("*").alias("n_containers"),
        F.coalesce(F.sum("n_items"), F.lit(0)).alias("n_items"),
        F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"),
        F.coalesce(F.sum("space"), F.lit(0)).alias("space"),
        (F.sum("used") / F.sum(F.col("used") + F.col("space"))).alias("fill"),
        F.min("used").alias("least_used"),
    )
