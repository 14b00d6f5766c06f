"""Removal of repeated byte strings with difference-cover suffix sorting.

Every byte covered by a string of ``LENGTH`` bytes that starts anywhere else as well is removed.
The work is dealt out so that equal strings meet: each window of LENGTH bytes has an anchor, the
GRAM-byte gram with the smallest hash in it, which its content alone determines. Grams are counted
over all texts; a window whose anchor gram occurs as an anchor only once is unique and goes no further. The rest is cut to segments (windows with one anchor gram, next to each other), equal segments
are merged before the shuffle and keep their number, and segments of one anchor gram come to one task.
A gram whose segments exceed RUN_BYTES is split: its windows are dealt out by bands of the anchor's offset in the
window and the bytes that all windows of a band hold around it, with bands of half the width in each further round until
every key is bounded; a band of one offset knows its windows whole, so equal windows always meet.
A task sorts the suffixes of its segments by the difference-cover method: the triples at positions
1 and 2 modulo 3 are sorted and named, names are sorted recursively until they differ, the suffixes at 0 modulo 3 are merged in by one symbol and the next rank.
Neighbours in suffix order are compared over their first LENGTH bytes; a class of equal strings
with two or more occurrences is repeated.

Cases: a NULL text is empty; texts shorter than LENGTH lose nothing; repeated rows and equal texts
are copies of each other; NULL and repeated ids are harmless, as texts are named by their content;
an empty table gives an empty table. Other columns are not taken over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import content_key, map_texts, slices, stored, table, whole_text
from .tokens import BASE_INVERSE, U, joined, mix, powers_upto, prefix_hashes

LENGTH, GRAM = 200, 64
REACH = LENGTH - GRAM  # a window at s holds the grams that start at s .. s + REACH
#: A task's segments are sorted together in runs of about so many bytes; equal keys stay in one run, and keys of more are split.
RUN_BYTES = 1_000_000
PLACE_BITS = 24
#: Grams of long texts are hashed in pieces of so many.
PIECE = 1 << 21
#: Rows of a batch of split segments.
PIECES = 20_000


def gram_hashes(data: np.ndarray) -> np.ndarray:
    n = len(data) - GRAM + 1
    out = np.empty(n, dtype=U)
    for a in range(0, n, PIECE):
        s = prefix_hashes(data[a:a + PIECE + GRAM - 1])
        k = len(s) - GRAM
        with np.errstate(over="ignore"):
            out[a:a + k] = mix((s[GRAM:] - s[:k]) * powers_upto(BASE_INVERSE, k))
    return out


def window_anchors(h: np.ndarray) -> np.ndarray:
    """For every window start the place of its smallest gram, the leftmost of equals. Places are packed behind the
    hashes relative to pieces that overlap by REACH grams, so that they fit in PLACE_BITS however long a text is."""
    step = (1 << PLACE_BITS) - REACH
    return np.concatenate([a + piece_anchors(h[a:a + step + REACH]) for a in range(0, max(1, len(h) - REACH), step)])


def piece_anchors(h: np.ndarray) -> np.ndarray:
    v = (h >> U(PLACE_BITS) << U(PLACE_BITS)) | np.arange(len(h), dtype=U)
    width = 1
    while 2 * width <= REACH + 1:
        v = np.minimum(v[:-width], v[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        v = np.minimum(v[:-rest], v[rest:])
    return (v & U((1 << PLACE_BITS) - 1)).astype(np.int64)


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Joined bytes, text starts, gram hashes, starts of the windows that lie in one text, their anchors."""
    data, starts = joined(texts, lower=False)
    empty = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return data, starts, np.empty(0, U), empty, empty
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    h = gram_hashes(data)
    anchors = window_anchors(h)
    at = np.arange(len(anchors))
    inside = at + LENGTH <= np.repeat(starts + lens, lens + 1)[:len(anchors)]
    return data, starts, h, at[inside], anchors[inside]


def runs(at: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of neighbouring windows with one key (in periodic text the places of
    a gram follow each other closely; its windows are one run all the same)."""
    if not len(at):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])])
    return first, np.r_[first[1:], len(at)] - 1


def long_texts(docs: DataFrame) -> DataFrame:
    return docs.where(F.octet_length("text") >= LENGTH).select("node", "text")


def anchors(docs: DataFrame) -> DataFrame:
    """(gram, node, place, size) of the anchors: one of each run of windows, two where the run has several places;
    ``size``: bytes of the run."""
    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        _, starts, h, at, anchor = windows([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
        first, last = runs(at, h[anchor])
        more = np.flatnonzero(anchor[last] != anchor[first])
        size = np.r_[at[last] + LENGTH - at[first], np.zeros(len(more), np.int64)]
        anchor = np.r_[anchor[first], anchor[last][more]]
        order = np.argsort(anchor, kind="stable")
        anchor, size = anchor[order], size[order]
        text = np.searchsorted(starts, anchor, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(h[anchor].view(np.int64)) if len(anchor) else pa.array([], pa.int64()), b.column(0).take(pa.array(text)),
                                           pa.array((anchor - starts[text]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["gram", "node", "place", "size"])

    return map_texts(long_texts(docs), run, "gram long, node binary, place int, size int")


def segments(suspects: DataFrame) -> DataFrame:
    """(gram, node, start, segment) of the windows whose anchor is repeated; ``suspects``: node, text,
    places (of the repeated anchors)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for b in slices([wide], 1):
                data, starts, h, at, anchor = windows([t.encode("utf-8", "surrogatepass") for t in b.column(1).to_pylist()])
                places = b.column(2)
                known = np.repeat(starts, places.value_lengths().to_numpy(zero_copy_only=False)) + places.flatten().to_numpy()
                key = h[anchor]
                good = np.isin(key, h[known])
                at, key = at[good], key[good]
                if not len(at):
                    continue
                first, last = runs(at, key)
                begin, end = at[first], at[last] + LENGTH
                text = np.searchsorted(starts, begin, side="right") - 1
                raw = data.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(key[first].view(np.int64)), b.column(0).take(pa.array(text)), pa.array((begin - starts[text]).astype(np.int32)),
                                                  pa.array([raw[i:j] for i, j in zip(begin.tolist(), end.tolist(), strict=True)], pa.binary())], names=["gram", "node", "start", "segment"])

    return suspects.select("node", "text", "places").mapInArrow(run, "gram long, node binary, start int, segment binary")


def dense(parts: list[np.ndarray]) -> np.ndarray:
    """Order-preserving names (from 1) of the rows of equally long non-negative columns."""
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        top = int(p.max(initial=0)) + 1
        if (int(key.max(initial=0)) + 1) * top >= 1 << 62:
            key = dense([key])
        key = key * top + p
    order = np.argsort(key)
    new = np.r_[True, key[order][1:] != key[order][:-1]]
    out = np.empty(len(key), dtype=np.int64)
    out[order] = np.cumsum(new)
    return out


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix order of the positive numbers ``s`` by the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    p = np.r_[s, 0, 0, 0].astype(np.int64)
    one, two, zero = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3), np.arange(0, n, 3)
    sample = np.r_[one, two]
    name = dense([p[sample], p[sample + 1], p[sample + 2]])
    if name.max() < len(sample):
        order = suffix_array(name)
        name[order] = np.arange(1, len(sample) + 1)
    rank, wide = np.zeros(n + 3, dtype=np.int64), n + 3
    rank[sample] = name
    placed = np.empty(len(sample), dtype=np.int64)
    placed[name - 1] = sample
    placed = placed[placed < n]
    one, two = placed[placed % 3 == 1], placed[placed % 3 == 2]
    # a suffix at 0 compares with one at 1 by a symbol and the next rank, with one at 2 by two symbols and a rank
    zero = zero[np.argsort(p[zero] * wide + rank[zero + 1])]
    both = np.r_[zero, two]
    far = dense([p[both], p[both + 1]]) * wide + rank[both + 2]
    before = np.searchsorted(p[one] * wide + rank[one + 1], p[zero] * wide + rank[zero + 1]) + np.searchsorted(far[len(zero):], far[:len(zero)])
    mine = before + np.arange(len(zero))
    order = np.empty(n, dtype=np.int64)
    order[mine] = zero
    other = np.ones(n, dtype=bool)
    other[mine] = False
    order[other] = placed
    return order


def repeated_windows(parts: list[bytes], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, first, last): runs of window starts in the parts whose strings occur twice or more."""
    lens = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"\0".join([*parts, b""]), dtype=np.uint8)
    begin = np.cumsum(lens + 1) - lens - 1
    part = np.repeat(np.arange(len(parts)), lens + 1)
    numbers = data.astype(np.int64) + 1
    numbers[begin[1:] - 1] = numbers[-1] = 1
    valid = np.arange(len(data)) + LENGTH <= (begin + lens)[part]
    order = suffix_array(numbers)
    order = order[valid[order]]
    wide = np.zeros(len(data), dtype=np.uint64)
    padded = np.r_[data, np.zeros(8, np.uint8)]
    for k in range(8):
        wide = wide << U(8) | padded[k:k + len(data)]
    same = np.arange(len(order) - 1)
    for k in range(0, LENGTH, 8):  # adjacent prefixes, eight bytes at a time
        same = same[wide[order[same] + k] == wide[order[same + 1] + k]]
    group = np.zeros(len(order), dtype=np.int64)
    group[1:] = 1
    group[same + 1] = 0
    group = np.cumsum(group)
    total = np.bincount(group, weights=weights[part[order]])
    hit = np.sort(order[total[group] >= 2])
    first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (part[hit[1:]] != part[hit[:-1]])]) if len(hit) else np.empty(0, np.int64)
    last = np.r_[first[1:], len(hit)] - 1 if len(hit) else first
    return part[hit[first]], hit[first] - begin[part[hit[first]]], hit[last] - begin[part[hit[first]]]


def split(parts: list[bytes], width: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], list[bytes]]:
    """Hits (part, first, last) and pieces (part, start, key, copies) with their bytes: the windows of the parts, dealt out
    by bands of ``width`` offsets of the anchor in the window and the bytes that all windows of a band hold. Bands of one
    offset hold windows whole: each different one of a part is a piece, and those that stand twice in the part are hits."""
    data, starts, _, at, anchor = windows(parts)
    low = (anchor - at) // width * width
    begin, end = anchor - low, anchor + LENGTH - np.minimum(low + width - 1, REACH)
    key = np.empty(len(at), dtype=U)
    for a in range(0, len(at), PIECE):
        i, j, base = begin[a:a + PIECE], end[a:a + PIECE], int(at[a])
        s = prefix_hashes(data[base:int(j.max())])
        with np.errstate(over="ignore"):
            key[a:a + PIECE] = mix((s[j - base] - s[i - base]) * powers_upto(BASE_INVERSE, len(s))[i - base] + mix(low[a:a + PIECE].astype(U)))
    part = np.searchsorted(starts, at, side="right") - 1
    none = np.empty(0, np.int64)
    hits, copies = (none, none, none), np.ones(len(at), dtype=np.int64)
    if width == 1:
        order = np.lexsort((key, part))
        new = np.r_[True, (part[order][1:] != part[order][:-1]) | (key[order][1:] != key[order][:-1])]
        lead = np.empty(len(at), dtype=np.int64)
        lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        wide = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
        twice = np.flatnonzero(lead != np.arange(len(at)))
        twice = twice[[bool((wide[at[i]] == wide[at[lead[i]]]).all()) for i in twice.tolist()]] if len(twice) else twice
        copies += np.bincount(lead[twice], minlength=len(at))
        hit = copies > 1
        hit[twice] = True
        where = np.flatnonzero(hit)
        first, last = runs(at[where], part[where])
        hits = tuple(x.astype(np.int64) for x in (part[where[first]], at[where[first]] - starts[part[where[first]]], at[where[last]] - starts[part[where[first]]]))
        first = last = np.setdiff1d(np.arange(len(at)), twice)
    else:
        first, last = runs(at, key)
    raw = data.tobytes()
    pieces = [raw[i:j] for i, j in zip(at[first].tolist(), (at[last] + LENGTH).tolist(), strict=True)]
    return hits, (part[first], at[first] - starts[part[first]], key[first], copies[first]), pieces


def sort_segments(distinct: DataFrame, width: int) -> DataFrame:
    """Rows without ``piece``: (name, first, last) of the repeated windows of the segments that are not ``hot``. Rows with it: the
    pieces, by bands of ``width``, of the hot ones, ``first`` being where a piece starts. ``distinct``: gram, name, segment, n, hot."""
    columns = ["name", "first", "last", "gram", "n", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, names, parts, n, size = [], [], [], [], 0

        def batch(names, first, last, gram=None, n=None, piece=None) -> pa.RecordBatch:
            k = len(names)
            return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                                               *(pa.nulls(k, pa.int64()) if x is None else pa.array(x.view(np.int64)) for x in (gram, n)),
                                               pa.nulls(k, pa.binary()) if piece is None else pa.array(piece, pa.binary())], names=columns)

        def flush(upto: int) -> pa.RecordBatch:
            part, first, last = repeated_windows(parts[:upto], np.array(n[:upto], dtype=np.int64))
            out = batch([names[i] for i in part.tolist()], first, last)
            for x in (grams, names, parts, n):
                del x[:upto]
            return out

        for wide in batches:
            for b in slices([wide], 2):
                hot = b.column(4)
                cold, large = b.filter(pc.invert(hot)), b.filter(hot)
                if large.num_rows:
                    of, weights = large.column(1).to_pylist(), large.column(3).to_numpy()
                    (part, first, last), (owner, start, key, copies), pieces = split(large.column(2).to_pylist(), width)
                    if len(part):
                        yield batch([of[i] for i in part.tolist()], first, last)
                    for i in range(0, len(pieces), PIECES):
                        j = slice(i, i + PIECES)
                        yield batch([of[k] for k in owner[j].tolist()], start[j], start[j], key[j], weights[owner[j]] * copies[j], pieces[j])
                for g, name, segment, k in zip(*(cold.column(i).to_pylist() for i in range(4)), strict=True):
                    if size >= RUN_BYTES and g != grams[-1]:
                        yield flush(len(parts))
                        size = 0
                    grams.append(g)
                    names.append(name)
                    parts.append(segment)
                    n.append(k)
                    size += len(segment)
        if parts:
            yield flush(len(parts))

    place = F.when(F.col("hot"), F.xxhash64("name")).otherwise(F.col("gram"))
    dealt = distinct.select("gram", "name", "segment", "n", "hot").repartition(place).sortWithinPartitions("gram")
    return dealt.mapInArrow(run, "name binary, first int, last int, gram long, n long, piece binary")


def merged(cuts: DataFrame, n) -> DataFrame:
    """(gram, name, segment, n) of the different segments."""
    return cuts.groupBy("gram", "name").agg(F.first("segment").alias("segment"), n.alias("n"))


def too_large(sizes: DataFrame) -> DataFrame | None:
    """(gram, hot) of the grams of more than RUN_BYTES; ``sizes``: gram, size. None if there are none."""
    hot = stored(sizes.where(F.col("size") > RUN_BYTES).select("gram", F.lit(True).alias("hot")))
    return None if hot.isEmpty() else hot


def repeated_parts(distinct: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(name, first, last) of the repeated windows; ``distinct``: gram, name, segment, n; ``hot``: its grams to split."""
    rounds, width = [], REACH + 1
    while True:
        width = -(-width // 2)
        marked = distinct.withColumn("hot", F.lit(False)) if hot is None else distinct.join(hot, "gram", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
        rounds.append(stored(sort_segments(marked, width)))
        if hot is None:
            break
        pieces = rounds[-1].where("piece IS NOT NULL").select("gram", F.unhex(F.md5("piece")).alias("name"), F.col("piece").alias("segment"), "n")
        distinct = merged(pieces, F.sum("n"))
        sizes = pieces.groupBy("gram", "name").agg(F.first(F.octet_length("segment")).alias("size")).groupBy("gram").agg(F.sum("size").alias("size"))
        hot = too_large(sizes) if width > 1 else None
    hits = rounds.pop().select("name", "first", "last")
    for found in reversed(rounds):  # what is repeated in a piece is so in the segments that hold it
        inner = hits.select(F.col("name").alias("of"), F.col("first").alias("f"), F.col("last").alias("l"))
        outer = found.where("piece IS NOT NULL").select("name", F.col("first").alias("start"), F.unhex(F.md5("piece")).alias("of")).join(inner, "of")
        hits = (outer.select("name", (F.col("start") + F.col("f")).alias("first"), (F.col("start") + F.col("l")).alias("last"))
                .unionByName(found.where("piece IS NULL").select("name", "first", "last")))
    return stored(hits) if rounds else hits


def cut(texts: DataFrame) -> DataFrame:
    """(node, n_removed, n_spans, kept_sha256, kept) of texts with ``spans`` (array of starts and ends)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wide in batches:
            for b in slices([wide], 1):
                out = []
                for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw, kept, at, removed, n = text.encode("utf-8", "surrogatepass"), [], 0, 0, 0
                    end = -1
                    for x in sorted((s["start"], s["stop"]) for s in spans):
                        if x[0] > end:
                            kept.append(raw[max(at, 0):x[0]])
                            n += 1
                            removed += x[1] - x[0]
                        else:
                            removed += max(0, x[1] - end)
                        end = max(end, x[1])
                        at = end
                    kept.append(raw[max(at, 0):])
                    rest = b"".join(kept)
                    out.append((removed, n, hashlib.sha256(rest).hexdigest(), rest))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))],
                                                 names=["node", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.select("node", "text", "spans").mapInArrow(run, "node binary, n_removed long, n_spans long, kept_sha256 string, kept binary")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(node, text, spans): texts with the windows that occur elsewhere, equal texts counted once. ``docs``: node, text."""
    found = stored(anchors(docs))
    occurrence = F.xxhash64("node", "place")
    repeated = stored(found.groupBy("gram").agg(F.min(occurrence).alias("a"), F.max(occurrence).alias("b"), F.sum("size").alias("size"))
                      .where("a <> b").select("gram", "size"))
    hot = too_large(repeated)  # equal segments count each here, so no other gram has more
    places = stored(found.join(repeated.select("gram").hint("shuffle_hash"), "gram", "left_semi").groupBy("node").agg(F.sort_array(F.collect_set("place")).alias("places")))
    suspects = stored(long_texts(docs).join(places.hint("shuffle_hash"), "node").dropDuplicates(["node"]))
    cuts = segments(suspects).withColumn("name", F.unhex(F.md5("segment")))
    hits = repeated_parts(merged(cuts, F.count(F.lit(1))), hot)
    spans = (cuts.select("node", "start", "name").join(hits, "name")
             .groupBy("node").agg(F.collect_list(F.struct((F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + LENGTH).alias("stop"))).alias("spans")))
    return suspects.select("node", "text").join(stored(spans).hint("shuffle_hash"), "node")


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, node, n_bytes, n_removed, n_spans, kept_sha256 for every row of ``docs`` (doc_id, text)."""
    d = docs.select("doc_id", whole_text().alias("text")).withColumn("node", content_key())
    between = stored(cut(repeated_spans(d)).drop("kept"))
    rows = stored(d.select("doc_id", "node", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole")))
    copies = rows.groupBy("node").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    out = rows.join(copies, "node", "left").join(between, "node", "left")
    gone = F.col("copies").isNotNull() & (F.col("n_bytes") >= LENGTH)  # every window of a copied text starts elsewhere, too
    return out.select("doc_id", "node", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
                      F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
                      F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).drop("node")
