"""Best-fit packing of tokenised documents into sequences, planned on a histogram of lengths."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._common import bounded_batches, lean, ranked_within, written

#: Most tokens of a sequence.
SEQUENCE = 2048
#: Written after each document's ids.
END_ID = 0

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The ids that tokenizers gives for a byte-level BPE file (add_special_tokens=False), by tiktoken's faster merge.

    The file's vocabulary is read as ranks: in these files an id is the order of its merge. Special tokens that stand
    in a text get their ids, as in tokenizers. Files of another kind are left to tokenizers itself.
    """

    def __init__(self, path: str):
        import json

        import numpy as np

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if plain:
            import tiktoken

            # bytes are written as printable characters: those that are one, then the rest from 256 on
            printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
            byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
            ranks = {bytes(byte[c] for c in word): i for word, i in model["vocab"].items() if word not in special}
            pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
            own = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
            self.encode = lambda text: own.encode_to_numpy(text, allowed_special="all")
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            self.encode = lambda text: np.array(t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def pieces(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32.

    Null and empty texts are a document of the end id alone. Whatever else docs holds is not read.
    """
    path = path or tokenizer_path()
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        encode = Encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END_ID)).astype("<u4")
                first = len(ids) % size or size
                for i, start in enumerate([0, *range(first, len(ids), size)]):
                    part = ids[start : first if i == 0 else start + size]
                    for column, value in zip(out, (doc, i, start, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), PIECES)


def plan(histogram: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, sequences, pieces a sequence, first sequence, offset).

    Sequences with the same contents are one group with a count. Each length goes, longest first, to the groups with
    the least room that still fits, and to new sequences at last; a group is cut in two where a length runs out. So
    there are at most a few thousand groups of at most 63 lengths, whatever the number of documents.
    """
    groups: dict[int, list[tuple[int, tuple]]] = {}
    final: list[tuple[int, tuple]] = []

    def put(room: int, count: int, content: tuple) -> None:
        if count and room:
            groups.setdefault(room, []).append((count, content))
        elif count:
            final.append((count, content))

    for length in sorted((x for x, c in histogram.items() if c), reverse=True):
        left = histogram[length]
        for room in sorted(r for r in groups if r >= length):
            if not left:
                break
            fit, waiting = room // length, groups.pop(room)
            for at, (count, content) in enumerate(waiting):
                full = min(count, left // fit)
                put(room - fit * length, full, (*content, (length, fit)))
                count, left = count - full, left - full * fit
                if count and left:  # fewer are left than fit
                    put(room - left * length, 1, (*content, (length, left)))
                    count, left = count - 1, 0
                put(room, count, content)
                if not left:
                    for other in waiting[at + 1 :]:
                        put(room, *other)
                    break
        fit = size // length
        put(size - fit * length, left // fit, ((length, fit),))
        put(size - left % fit * length, int(left % fit > 0), ((length, left % fit),))
    rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, content in [*final, *(g for room in sorted(groups) for g in groups[room])]:
        offset = 0
        for length, each in content:
            out.append((length, rank.get(length, 0), count, each, sequence, offset))
            rank[length] = rank.get(length, 0) + count * each
            offset += length * each
        sequence += count
    return out


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Packs every row of docs (doc_id, text) into sequences of at most size tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset for each piece. A document longer than a
    sequence is cut into whole sequences, its first piece taking what is over. Null or empty text: the end id alone.
    Repeated rows and doc_ids are packed each by itself; a null doc_id stays null; no rows give no rows; other columns
    are ignored. The driver holds the histogram (at most size counts) and the plan of plan(), which no input enlarges;
    pieces take their places by their rank within their length.
    """
    spark = docs.sparkSession
    table = written(pieces(docs, path, size), "pieces")
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(histogram, size))
    ranked = ranked_within(table, ["length"], F.xxhash64("doc_id", "piece"), ["doc_id", "piece", "start", "ids_crc32"], sum(histogram.values()))

    def place(batches: Iterator) -> Iterator:
        import numpy as np

        p = np.array(slots.value, dtype=np.int64).reshape(-1, 6)
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        limits = {int(n): (int(a), int(b)) for n, a, b in zip(*(lambda u, i: (u, i, [*i[1:], len(p)]))(*np.unique(p[:, 0], return_index=True)), strict=True)}
        for pdf in batches:
            sequence, offset = np.empty(len(pdf), np.int64), np.empty(len(pdf), np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for n in np.unique(lengths):
                a, b = limits[int(n)]
                rows = np.flatnonzero(lengths == n)
                at = a + np.searchsorted(p[a:b, 1], ranks[rows], side="right") - 1
                nth = ranks[rows] - p[at, 1]
                sequence[rows] = p[at, 4] + nth // p[at, 3]
                offset[rows] = p[at, 5] + nth % p[at, 3] * n
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(lean(place), f"{PIECES}, sequence_id long, offset long")
