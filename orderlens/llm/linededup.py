"""Line dedup by content-defined line chunks: repeated chunks go, the first stays.

Texts are cut into lines: at line breaks and ends of sentences, and a longer line at words,
where a hash of the WINDOW bytes before is lowest within REACH bytes. So lines depend on
nearby bytes only, and those of a repeated passage are the same wherever it stands, inside a
longer line too. Each line is hashed; a hash rolling over the hashes of two neighbouring lines
ends a chunk where it is lower than one line before and after. Chunks hold several lines and
fall into step again after any shift.

Chunks of two lines or more are counted over all documents by their bytes, not by their hash.
Where one occurs more than once, its first occurrence in the document with the smallest doc_id
stays. Elsewhere it is removed after its bytes were compared with the kept ones, if it is part
of a stretch of at least MIN_RUN repeated bytes, so that a phrase in common stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import pieces, sized, stored

SPACE = b" \t\r\n\f\v"
BLANK, STOP = (np.isin(np.arange(256), list(marks)) for marks in (SPACE, b".!?"))
WINDOW, REACH = 8, 12
MOST_LINES = 32  # of a chunk, where the same line follows itself
MIN_RUN = 100  # bytes of repeated chunks in a row
STEP = 1 << 17  # bytes of text cut together
GAP = b" " * 32  # between texts that are cut together; more than WINDOW and REACH


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _line_ends(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Where the lines of all texts end, without and with white space, whose they are, 
    where each text begins after white space, and the hash of each line, the sum of those
    of its words."""
    blank, tail = BLANK[data], (data & 0xC0) == 0x80
    word = ~blank[1:-1] & blank[2:]  # or the end of a character of three bytes or more
    ends = np.flatnonzero(word | (tail[:-2] & tail[1:-1] & ~tail[2:])) + 2
    owner = np.searchsorted(first, ends, "right") - 1
    solid = np.flatnonzero(~blank)
    seen_solid = np.cumsum(~blank, dtype=np.int32)
    after = np.append(solid, len(data))[seen_solid[ends - 1]]
    after = np.minimum(after, (first + sizes)[owner])
    breaks = np.cumsum(data == 10, dtype=np.int32)
    line = breaks[ends - 1] < breaks[after - 1]
    line |= STOP[data[ends - 1]] & blank[ends]
    seen = np.lib.stride_tricks.sliding_window_view(np.where(blank, np.uint8(32), data), WINDOW)
    marks = _mixed(seen[ends - WINDOW].view("<u8").ravel() * np.uint64(0x9E3779B97F4A7C15))
    rank = np.where(line, np.uint64(0), marks)
    beaten = np.zeros(len(ends), bool)
    for step in range(1, len(ends)):
        near = ends[step:] - ends[:-step] <= REACH
        if not near.any():
            break
        beaten[step:] |= near & (rank[:-step] <= rank[step:])
        beaten[:-step] |= near & (rank[step:] < rank[:-step])
    last = np.diff(owner, append=-1) != 0
    stays = np.flatnonzero(~beaten | line | last)
    begins = np.append(solid, len(data))[seen_solid[first - 1]]
    lines = np.diff(np.cumsum(marks)[stays], prepend=np.uint64(0))
    return ends[stays], after[stays], owner[stays], begins, lines


def cuts_of(many: list[bytes]) -> list[list[tuple[int, int, int]]]:
    """Per text its chunks as (start, end of content, end with white space); the content end
    is -1 for a chunk of one line. Together they are the text."""
    whole = GAP + GAP.join(many) + GAP
    data = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, many), np.int64, len(many))
    first = np.cumsum(sizes + len(GAP)) - sizes
    ends, after, owner, begins, lines = _line_ends(data, first, sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in many]
    if len(ends):
        head = np.diff(owner, prepend=-1) != 0
        starts = np.append(0, after[:-1])
        starts[head] = begins[owner[head]]
        before = np.append(np.uint64(0), lines[:-1])
        before[head] = 0
        rolled = _mixed(before * np.uint64(0x9E3779B97F4A7C15) ^ lines)
        high = np.uint64(np.iinfo(np.uint64).max)
        last = np.append(head[1:], True)
        earlier = np.where(head, high, np.append(high, rolled[:-1]))
        later = np.where(last, high, np.append(rolled[1:], high))
        cut = ((rolled < earlier) & (rolled <= later)) | last
        place = np.arange(len(cut))
        since = place - np.maximum.accumulate(np.where(np.append(True, cut[:-1]), place, 0))
        cut |= since % MOST_LINES == MOST_LINES - 1
        stop = np.flatnonzero(cut)
        start = np.append(0, stop[:-1] + 1)
        for a, b, c, n, row, new in zip(
            starts[start].tolist(), ends[stop].tolist(), after[stop].tolist(),
            (stop - start).tolist(), owner[stop].tolist(), head[start].tolist(),
        ):
            base = int(first[row])
            if new and a > base:
                out[row].append((0, -1, a - base))
            out[row].append((a - base, b - base if n else -1, c - base))
    for row, size in enumerate(sizes.tolist()):
        if size and not out[row]:
            out[row].append((0, -1, size))
    return out


def chunks(text: str) -> list[tuple[str, str | None]]:
    """(chunk with its white space, its content if it can be a repeat, else None)."""
    data = text.encode("utf-8", "surrogatepass")
    return [
        (data[a:c].decode("utf-8", "surrogatepass"), data[a:b].decode("utf-8", "surrogatepass") if b >= 0 else None)
        for a, b, c in cuts_of([data])[0]
    ]


def _digest(content: bytes) -> int:
    return xxhash.xxh64_intdigest(content) - (1 << 63)


def _bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of a string column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _listed(plain: DataFrame, with_content: bool) -> DataFrame:
    """One row per chunk that can be a repeat: by content, or by hash and document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sized(batches, 2, STEP):
            rows, found = [], []
            many = _bytes(batch.column(2))
            for row, (data, cut) in enumerate(zip(many, cuts_of(many))):
                own = [data[a:b] for a, b, _ in cut if b >= 0]
                own = own if with_content else list({_digest(c) for c in own})
                rows += [row] * len(own)
                found += own
            at = pa.array(rows, pa.int64())
            if with_content:
                columns = [batch.column(0).take(at), pa.array(found, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "content"])
            else:
                columns = [batch.column(0).take(at), batch.column(1).take(at)]
                columns.append(pa.array(found, pa.int64()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "print", "digest"])

    kind = plain.schema["id"].dataType.simpleString()
    wanted = "content binary" if with_content else "print bigint, digest bigint"
    return plain.mapInArrow(run, f"id {kind}, {wanted}")


def removed(
    data: bytes, cut: list[tuple[int, int, int]], found: dict[bytes, bool]
) -> list[tuple[int, int]]:
    """The parts (start, end) of a text to cut out.

    ``found`` holds the content of its repeated chunks, and whether this document keeps the
    first of them. Chunks in a row go together, if they have MIN_RUN bytes.
    """
    kept, runs = dict(found), []
    for a, b, c in cut:
        content = data[a:b] if b >= 0 else None
        if content not in kept or kept[content]:  # compares the bytes
            kept.update({content: False} if content in kept else {})
        elif runs and runs[-1][1] == a:
            runs[-1] = (runs[-1][0], c)
        else:
            runs.append((a, c))
    return [(a, c) for a, c in runs if c - a >= MIN_RUN]


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = True
) -> DataFrame:
    """The rows of ``docs`` with repeated chunks cut out of ``text``.

    With ``counts`` there are two more columns, which replace columns of those names:
    n_removed counts the stretches cut out, removed_chars their characters with the white
    space after them. Every row comes back: a null text stays null, an empty one empty,
    and a text that only repeats others becomes empty. Rows with one doc_id and one text
    count as one document, so repeated rows come back alike. A null doc_id never keeps a
    chunk that a document with an id also has; chunks that only documents without id share
    stay in all of them.
    """
    added = ["n_removed", "removed_chars"] if counts else []
    docs = docs.drop(*added)
    names = docs.columns
    plain = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(F.col(text).cast("string")).alias("print"),
        F.col(text).cast("string").alias("text"),
    )
    counted = _listed(plain, True).groupBy("content").agg(
        F.count("*").alias("n"), F.min("id").alias("keeper")
    )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            seen = pa.array([_digest(c) for c in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [seen, batch.column(0), batch.column(1)], ["digest", "content", "keeper"]
            )

    kind = plain.schema["id"].dataType.simpleString()
    repeated = counted.filter("n > 1").select("content", "keeper")
    repeated = stored(
        repeated.mapInArrow(digests, f"digest bigint, content binary, keeper {kind}"), "repeats"
    )
    where = _listed(plain, False).join(repeated, "digest")
    # A set: rows that repeat a document bring the same entries.
    found = where.groupBy("id", "print").agg(
        F.collect_set(
            F.struct(
                "content",
                F.coalesce(F.col("keeper") == F.col("id"), F.col("keeper").isNull()).alias("own"),
            )
        ).alias("found")
    )
    whole, held = (_free(n, names) for n in ("whole", "held"))
    left = docs.withColumn(whole, F.xxhash64(F.col(text).cast("string")))
    right = found.withColumnRenamed("found", held)
    joined = left.join(
        right, left[key].eqNullSafe(right["id"]) & (left[whole] == right["print"]), "left"
    ).select(*[left[n] for n in names], right[held])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            at = batch.schema.get_field_index(text)
            known = batch.column(batch.num_columns - 1)
            new, told = batch.column(at).to_pylist(), [(0, 0)] * batch.num_rows
            rows = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False)).tolist()
            many = [str(new[row]).encode("utf-8", "surrogatepass") for row in rows]
            for row, data, cut in zip(rows, many, cuts_of(many)):
                parts = removed(data, cut, {m["content"]: m["own"] for m in known[row].as_py()})
                if parts:
                    edges = [0, *(e for part in parts for e in part), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    gone = sum(len(data[a:b].decode("utf-8", "surrogatepass")) for a, b in parts)
                    new[row] = kept.decode("utf-8", "surrogatepass")
                    told[row] = (len(parts), gone)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            columns[at] = pa.array(new, batch.schema.field(at).type)
            columns += [pa.array([c[i] for c in told], pa.int64()) for i in range(len(added))]
            yield pa.RecordBatch.from_arrays(columns, [*names, *added])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(rewrite, schema + "".join(f", {a} bigint" for a in added))


def _free(name: str, taken: list[str]) -> str:
    """A column name that the table doesn't have yet."""
    used = {t.lower() for t in taken}
    while name in used:
        name += "_"
    return name


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, digest of the kept text) of every document."""
    return remove_repeats(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_removed",
        "removed_chars",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )
