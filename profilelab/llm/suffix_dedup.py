"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by interleave refinement.

Every byte that lies in a `span`-byte string which also starts earlier (smaller id, or same document and earlier) is
removed; strings are judged on the input and never cross documents.

1. Documents equal to an earlier one are settled by their digest. The others are cut into blocks, written once to the
   shared folder as frames; later tasks read a block by its place, so texts are never shuffled.
2. Each span start belongs to one anchor, the least of the 16-byte grams inside its span; equal spans have equal anchors.
   Anchors found once in the corpus settle their spans. The others are kept with their surroundings as segments.
3. Segments are dealt by anchor. A shard is the segments of one block with their BWT: symbols are the names of
   `step`-byte grams, so a segment is `step` interleaved strings and span / step symbols make a span. Shards are merged
   without sorting their suffixes together: an interleave of shard numbers is refined symbol by symbol, as the stable
   order of the BWT symbols in the interleave before; places where it splits bound the common prefixes. After
   span / step rounds the intervals between bounds hold the equal spans, and all but the earliest are repeats.
4. The segments of a part are merged at once, a shard for each row: what one task cut from a run of blocks, at most `ROW_BYTES`. A part of more than `team_bytes`
   or `fan_in` shards is merged in teams; only spans that are first in their team go on to the next level, so a passage that
   a third of all documents share goes on once per team. There they are dealt anew by ever wider surroundings of the
   anchor: spans are told apart by the place of the anchor in them, in twice as many classes a level, and a class deals by
   the bytes that all its spans share. In the end a key is the whole span and its spans are equal, which a team thins to one;
   so an anchor that very many different spans share never meets in one task.

Null texts are empty. Rows of one id and text are one document and get the same result; a null id comes after all
others. Extra columns are not carried. Names are 64-bit hashes of grams, compared inside one merge.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilelab.llm.common import drop, shared_dir, staged, table
from profilelab.llm.near_dups import bounded_broadcast
from profilelab.llm.words import mix, prefix_hashes, row_groups, span_hashes, string_parts

SPAN, STEP, GRAM, FAN_IN, BLOCK_BYTES = 100, 50, 16, 4096, 2 << 20
TEAM_BYTES, CUT_BLOCKS, MOST_PARTS = 4 << 20, 16, 1 << 15
ROW_BYTES, CUT_BYTES = 1 << 16, 16 << 20  # teams are dealt by rows, so a row is a small part of a team
_LAST = (1 << 63) - 1
BLOCKS = "block long, path string, start long, size long, hashes binary"
RESULT = "doc long, fp long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@dataclass
class Block:
    ids: np.ndarray
    fps: np.ndarray
    offsets: np.ndarray
    data: np.ndarray

    def pack(self) -> bytes:
        head = np.array([len(self.ids)], np.int64).tobytes() + self.ids.tobytes() + self.fps.tobytes() + self.offsets.tobytes()
        return zstandard.ZstdCompressor(level=3).compress(head + self.data.tobytes())


def read_block(path: str, start: int, size: int) -> Block:
    system, name = fs.FileSystem.from_uri(path)
    with system.open_input_file(name) as f:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(f.read_at(size, start)), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    cut = 8 + 8 * n
    ids, fps = raw[8:cut].view(np.int64), raw[cut : cut + 8 * n].view(np.int64)
    cut += 8 * n
    return Block(ids, fps, raw[cut : cut + 8 * (n + 1)].view(np.int64), raw[cut + 8 * (n + 1) :])


@dataclass
class Runs:
    """Runs of span starts with one anchor: its hash and place, first start (in the block), number of starts."""

    hashes: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray


def anchor_runs(data: np.ndarray, offsets: np.ndarray, span: int) -> Runs:
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < span:
        return Runs(none.view(np.uint64), none, none, none)
    at = np.arange(n - GRAM + 1)
    h = span_hashes(prefix_hashes(data), at, at + GRAM)
    key = (h >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    width, have = span - GRAM + 1, 1
    while have * 2 <= width:  # the least key of ever wider windows
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    if width > have:
        key = np.minimum(key[: len(key) - (width - have)], key[width - have :])
    ends = np.repeat(offsets[1:], np.diff(offsets))
    valid = np.flatnonzero(ends[: len(key)] - np.arange(len(key)) >= span)
    if not len(valid):
        return Runs(none.view(np.uint64), none, none, none)
    place = (key[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (valid[1:] != valid[:-1] + 1))))
    return Runs(h[place[head]], place[head], valid[head], np.diff(head, append=len(valid)))


SEGMENTS = ("block", "row", "doc", "at", "run", "lead")  # lead: bytes from the first span start to the anchor


def pack_segments(cols: dict[str, np.ndarray], data: np.ndarray) -> bytes:
    body = np.array([len(cols["run"])], np.int64).tobytes() + b"".join(np.asarray(cols[c], np.int64).tobytes() for c in SEGMENTS) + data.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def unpack_segments(packed: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    return {c: raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)].view(np.int64) for i, c in enumerate(SEGMENTS)}, raw[8 + 8 * n * len(SEGMENTS) :]


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [start, start + length), one after another."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)


def _pieces(chosen: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """The chosen segments in rows of at most ROW_BYTES."""
    for a, b in row_groups(np.concatenate(([0], np.cumsum(lengths[chosen]))), ROW_BYTES):
        yield chosen[a:b]


@dataclass
class Shard:
    """Sorted suffixes (numbers of suffixes, the empty ones first) and the symbol before each; 0 where a string begins."""

    order: np.ndarray
    bwt: np.ndarray


def by_name(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by name, equal names by place; rank of each name from 1)."""
    bits = np.uint64(max(1, len(names)).bit_length())
    top = names if not len(names) or int(names.max()) >> (64 - int(bits)) else names << bits  # small names are shifted, large ones cut
    order = top >> bits
    order <<= bits
    order |= np.arange(len(names), dtype=np.uint64)
    order.sort()
    order &= (np.uint64(1) << bits) - np.uint64(1)
    order = order.view(np.int64)
    inner = names[order]
    split = inner[1:] != inner[:-1]
    if (split & (top[order[1:]] >> bits == top[order[:-1]] >> bits)).any():  # two names that agree where they were cut
        order = np.argsort(names, kind="stable")
        inner = names[order]
        split = inner[1:] != inner[:-1]
    rank = np.empty(len(names), np.int64)
    rank[order] = np.cumsum(np.concatenate(([1], split))) if len(names) else 0
    return order, rank


def build_shard(codes: np.ndarray, following: np.ndarray, before: np.ndarray, last: np.ndarray, empties: np.ndarray, longest: int) -> Shard:
    """Sort the suffixes of one shard by doubling. `following`: number of the suffix one symbol later, -1 at the end;
    `before`: code of the symbol one earlier; `last`: code of each string's last symbol; `empties`: numbers of the empty suffixes."""
    rank, have, jump = codes.astype(np.int64), 1, following
    order = np.argsort(rank, kind="stable") if longest <= 1 else rank
    while have < longest:
        later = np.where(jump >= 0, rank[jump], 0)
        order, rank = by_name((rank * (int(rank.max(initial=0)) + 1) + later).view(np.uint64))  # equal suffixes by place
        jump = np.where(jump >= 0, following[jump] if have == 1 else jump[jump], -1)
        have *= 2
    return Shard(np.concatenate((empties, order)), np.concatenate((last, before[order])))


def merge_shards(shards: list[Shard], n_empty: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix, interval) in merged order: suffixes with an equal interval agree in their first `rounds` symbols."""
    sizes, number = [len(s.order) for s in shards], np.arange(len(shards), dtype=np.uint16)
    z = np.concatenate([np.repeat(number, n_empty), np.repeat(number, np.array(sizes) - n_empty)])
    fixed = int(np.sum(n_empty))
    bwt = np.concatenate([s.bwt for s in shards])
    interval = np.zeros(len(z), np.int32)  # no symbol compared yet: the empty suffixes are like the others
    for _ in range(rounds):
        symbol = np.empty(len(z), np.int32)
        symbol[np.argsort(z, kind="stable")] = bwt  # each shard's symbols in turn, where the interleave names it
        at = np.flatnonzero(symbol)
        source = symbol[at].astype(np.int64)
        source <<= 32
        source |= at
        del at
        source.sort()  # stable by symbol
        source &= 0xFFFFFFFF
        s, g = symbol[source], interval[source]
        split = np.concatenate(([True], (s[1:] != s[:-1]) | (g[1:] != g[:-1]))) if len(s) else np.zeros(0, bool)
        del symbol, s, g
        z = np.concatenate((z[:fixed], z[source]))
        del source
        interval = np.concatenate((np.zeros(fixed, np.int32), np.cumsum(split, dtype=np.int32)))
    suffix = np.empty(len(z), np.int32)
    suffix[np.argsort(z, kind="stable")] = np.concatenate([s.order for s in shards])
    return suffix, interval


def _symbol_names(data: np.ndarray, offsets: np.ndarray, n_real: np.ndarray, real_at: np.ndarray, step: int, size: int = 1 << 18) -> np.ndarray:
    """Names of the symbols of all suffixes, a few segments at a time."""
    names = np.empty(int(real_at[-1]), np.uint64)
    for a, b in row_groups(offsets, size):
        place = _ranges(offsets[a:b] - offsets[a], n_real[a:b])
        names[real_at[a] : real_at[b]] = span_hashes(prefix_hashes(data[offsets[a] : offsets[b]]), place, place + step)
    return names


def repeated_starts(parts: list[tuple[dict[str, np.ndarray], np.ndarray]], span: int, step: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """All segments of the shards, their bytes, offsets, and whether each span start (in segment order) has an earlier equal."""
    cols = {c: np.concatenate([p[0][c] for p in parts]) for c in SEGMENTS}
    data = np.concatenate([p[1] for p in parts])
    lengths = cols["run"] + span - 1
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    shard_of = np.repeat(np.arange(len(parts)), [len(p[0]["run"]) for p in parts])
    # Suffixes: byte places with a whole symbol, segment by segment; then the empty suffix of each of the step strings.
    # Numbers of suffixes fit 32 bits: a team is far smaller than that.
    n_real = lengths - step + 1
    real_at = np.concatenate(([0], np.cumsum(n_real)))
    total = int(real_at[-1])
    codes = by_name(_symbol_names(data, offsets, n_real, real_at, step))[1].astype(np.int32)
    inside = (np.arange(total) - np.repeat(real_at[:-1], n_real)).astype(np.int32)
    following = np.where(inside + step < np.repeat(n_real, n_real), np.arange(total) + step, -1).astype(np.int32)
    before = np.where(inside >= step, codes[np.maximum(np.arange(total) - step, 0)], 0).astype(np.int32)
    shards, n_empty, longest = [], [], -(-int(n_real.max(initial=1)) // step)
    for k in range(len(parts)):
        segs = np.flatnonzero(shard_of == k)
        if not len(segs):
            continue
        a, b = real_at[segs[0]], real_at[segs[-1] + 1]
        ends = (real_at[segs + 1][:, None] - step + np.arange(step)).reshape(-1)  # the last symbol of each string
        part = build_shard(codes[a:b], np.where(following[a:b] >= 0, following[a:b] - a, -1), before[a:b], codes[ends],
                           total + segs[0] * step + np.arange(len(segs) * step) - a, longest)
        shards.append(Shard((part.order + a).astype(np.int32), part.bwt.astype(np.int32)))
        n_empty.append(len(segs) * step)
    del codes, following, before
    suffix, interval = merge_shards(shards, n_empty, span // step)
    del shards
    # Span starts among the suffixes, with their order in the corpus: segments by (id, place), then place inside.
    real = suffix < total
    suffix, interval = suffix[real], interval[real]
    seg = np.repeat(np.arange(len(lengths), dtype=np.int32), n_real)[suffix]
    into = inside[suffix]
    is_start = into < cols["run"][seg]
    interval, seg, into = interval[is_start], seg[is_start], into[is_start]
    del suffix, inside, is_start, real
    by = np.lexsort((cols["at"], cols["doc"]))
    fresh = np.concatenate(([0], (np.diff(cols["doc"][by]) != 0) | (np.diff(cols["at"][by]) != 0)))
    rank = np.empty(len(by), np.int64)
    rank[by] = np.cumsum(fresh)  # the same place in repeated rows ranks the same
    order = rank[seg] * (1 << 20) + into
    heads = np.flatnonzero(np.concatenate(([True], interval[1:] != interval[:-1]))) if len(interval) else np.zeros(0, np.int64)
    least = np.minimum.reduceat(order, heads) if len(heads) else order
    repeat = order > np.repeat(least, np.diff(heads, append=len(order)))
    start_at = np.concatenate(([0], np.cumsum(cols["run"])))
    flags = np.zeros(int(start_at[-1]), bool)
    flags[start_at[seg] + into] = repeat
    return cols, data, offsets, flags


def _flag_runs(cols: dict[str, np.ndarray], flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first start, starts) of the runs of flagged starts inside segments."""
    begin = np.concatenate(([0], np.cumsum(cols["run"])))
    edge = np.zeros(len(flags) + 1, bool)
    edge[begin] = True
    before = np.concatenate(([False], flags[:-1])) & ~edge[:-1]
    after = np.concatenate((flags[1:], [False])) & ~edge[1:]
    a, b = np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1
    seg = np.searchsorted(begin, a, side="right") - 1
    return seg, a - begin[seg], b - a


MERGED = "kind int, block long, part long, size long, packed binary"


def dealt(anchors: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, indexes) of the anchors, by part."""
    to = (mix(anchors.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
    by = np.argsort(to, kind="stable")
    return [(int(to[g[0]]), g) for g in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(g)]


def _cut_classes(cols: dict[str, np.ndarray], first: np.ndarray, data: np.ndarray, span: int, classes: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Segments cut where the anchor's place in the span changes its class; first bytes; hashes of what all spans of a piece share.
    Equal spans have their anchor at the same place, so they are in equal classes and have equal hashes."""
    widest = span - GRAM
    width = -(-(widest + 1) // classes)
    top = cols["lead"] // width
    n = top - (cols["lead"] - cols["run"] + 1) // width + 1
    seg = np.repeat(np.arange(len(n)), n)
    kind = np.repeat(top, n) - _ranges(np.zeros(len(n), np.int64), n)
    lead, least, most = cols["lead"][seg], kind * width, np.minimum(kind * width + width - 1, widest)
    lo, hi = np.maximum(0, lead - most), np.minimum(cols["run"][seg] - 1, lead - least)
    anchor = first[seg] + lead
    keys = span_hashes(prefix_hashes(data), anchor - least, anchor + span - most) ^ mix(kind.astype(np.uint64))
    out = {c: cols[c][seg] for c in SEGMENTS} | {"at": cols["at"][seg] + lo, "run": hi - lo + 1, "lead": lead - lo}
    return out, first[seg] + lo, keys


def _merge_group(rows: pa.Table, span: int, step: int, classes: int, level: int) -> pa.Table:
    """Marks of repeats for each block (kind 0) and, where the part has other teams, the segments whose spans go on (kind 1),
    dealt anew to as many parts, one shard each."""
    cols, data, offsets, flags = repeated_starts([unpack_segments(x) for x in rows.column("packed").to_pylist()], span, step)
    out: list[tuple] = []
    seg, at, n = _flag_runs(cols, flags)
    home = cols["block"][seg]
    by = np.argsort(home, kind="stable")
    for own in np.split(by, np.flatnonzero(np.diff(home[by])) + 1) if len(by) else []:
        marks = np.stack([cols["row"][seg[own]], cols["at"][seg[own]] + at[own], n[own]]).astype(np.int64)
        out.append((0, int(home[own[0]]), 0, 0, zstandard.ZstdCompressor(level=1).compress(marks.tobytes())))
    part, teams = rows.column("part")[0].as_py(), rows.column("teams")[0].as_py()
    seg, at, n = _flag_runs(cols, ~flags) if teams > 1 else (np.zeros(0, np.int64),) * 3
    if len(seg):
        new = {c: cols[c][seg] for c in SEGMENTS} | {"at": cols["at"][seg] + at, "run": n, "lead": cols["lead"][seg] - at}
        new, first, keys = _cut_classes(new, offsets[seg] + at, data, span, classes)
        for to, g in dealt(mix(keys + np.uint64(level)), teams):  # another deal at every level
            name = int(mix(mix(np.array([part], np.int64).view(np.uint64)) + np.uint64(to)).view(np.int64)[0])
            for some in _pieces(g, new["run"] + span - 1):
                mine = data[_ranges(first[some], new["run"][some] + span - 1)]
                out.append((1, 0, name, len(mine), pack_segments({c: new[c][some] for c in SEGMENTS}, mine)))
    kinds, blocks, parts, sizes, packed = zip(*out) if out else ((),) * 5
    return pa.table({"kind": pa.array(kinds, pa.int32()), "block": pa.array(blocks, pa.int64()), "part": pa.array(parts, pa.int64()),
                     "size": pa.array(sizes, pa.int64()), "packed": pa.array(packed, pa.binary())})


def _merger(span: int, step: int, classes: int, level: int):
    return lambda rows: _merge_group(rows, span, step, classes, level)


def _write_blocks(docs: DataFrame, folder: str, span: int) -> DataFrame:
    """Write the blocks; one row per block with its distinct anchors."""
    def batches(it):
        out, at, path = None, 0, f"{folder}/{uuid.uuid4().hex}.blocks"
        for batch in it:
            data, offsets = string_parts(batch.column(2))
            ids, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for a, b in row_groups(offsets, BLOCK_BYTES):
                block = Block(ids[a:b], fps[a:b], offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                packed = block.pack()
                if out is None:
                    system, name = fs.FileSystem.from_uri(path)
                    system.create_dir(fs.FileSystem.from_uri(folder)[1], recursive=True)
                    out = system.open_output_stream(name, compression=None)
                out.write(packed)
                number = int.from_bytes(hashlib.blake2b(f"{path}:{at}".encode(), digest_size=8).digest(), "little", signed=True)
                own = np.unique(anchor_runs(block.data, block.offsets, span).hashes)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([path]), pa.array([at]), pa.array([len(packed)]), pa.array([own.tobytes()], pa.binary())],
                                                 ["block", "path", "start", "size", "hashes"])
                at += len(packed)
        if out is not None:
            out.close()

    return staged(docs.mapInArrow(batches, BLOCKS))


def _shared_anchors(rows: pa.Table) -> pa.Table:
    """Which anchors of each block also occur in another block; rows are all anchors of one part."""
    sets = [np.frombuffer(x, np.uint64) for x in rows.column("hashes").to_pylist()]
    every = np.concatenate(sets)
    order = np.argsort(every)
    same = every[order[1:]] == every[order[:-1]]
    flag = np.zeros(len(every), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    ends = np.cumsum([len(s) for s in sets])
    bits = [np.packbits(flag[e - len(s) : e]).tobytes() for s, e in zip(sets, ends)]
    return pa.table({"block": rows.column("block"), "part": rows.column("part"), "bits": pa.array(bits, pa.binary())})


def dedup_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", span: int = SPAN, step: int = STEP, fan_in: int = FAN_IN,
                team_bytes: int = TEAM_BYTES) -> DataFrame:
    """(doc, fp, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    if span % step or span < 2 * step or span < GRAM:
        raise ValueError("span must be a multiple of step, at least two of them, and no shorter than an anchor")
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(t).alias("fp"), t.alias("text"))
    digests = rows.select("doc", "fp", F.xxhash64(F.lit("second"), "text").alias("fp2"), F.octet_length("text").cast("long").alias("n_bytes"))
    equal = digests.groupBy("fp", "fp2", "n_bytes").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("fp", "fp2", "n_bytes", "first")
    equal = staged(equal)
    listed = bounded_broadcast(equal, equal.count())
    copy = (F.col("first").isNotNull() & (F.col("doc") > F.col("first")))
    copies = digests.join(listed, ["fp", "fp2", "n_bytes"]).where(copy & (F.col("n_bytes") >= span))
    own = rows.select("*", F.xxhash64(F.lit("second"), "text").alias("fp2"), F.octet_length("text").cast("long").alias("n_bytes")).join(listed, ["fp", "fp2", "n_bytes"], "left")
    own = own.where(~(copy & (F.col("n_bytes") >= span))).select("doc", "fp", "text")
    blocks = _write_blocks(own, shared_dir(spark), span)
    places = blocks.select("block", "path", "start", "size")
    n_blocks = places.count()
    # Parts grow with the number of blocks: a few blocks' anchors each, and half a block's bytes of segments or so, which is one team.
    anchor_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_blocks // 4)
    parts = max(1, min(4 * n_blocks, MOST_PARTS))

    def by_part(it):
        for batch in it:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(raw, np.uint64)
                for part, g in dealt(own, anchor_parts):
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part]), pa.array([own[g].tobytes()], pa.binary())], ["block", "part", "hashes"])

    split = blocks.select("block", "hashes").mapInArrow(by_part, "block long, part long, hashes binary")
    bits = split.groupBy("part").applyInArrow(_shared_anchors, "block long, part long, bits binary")
    flags = bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits")).alias("flags"))

    def cut(row: dict) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        block = read_block(row["path"], row["start"], row["size"])
        runs = anchor_runs(block.data, block.offsets, span)
        own, inverse, count = np.unique(runs.hashes, return_inverse=True, return_counts=True)
        shared, of = count > 1, dict(dealt(own, anchor_parts))
        for f in row["flags"]:
            mine = of[f["part"]]
            shared[mine] |= np.unpackbits(np.frombuffer(f["bits"], np.uint8), count=len(mine)).astype(bool)
        chosen = np.flatnonzero(shared[inverse])
        start, n = runs.starts[chosen], runs.lengths[chosen]
        d = np.searchsorted(block.offsets, start, side="right") - 1
        cols = {"block": np.full(len(chosen), row["block"]), "row": d, "doc": block.ids[d], "at": start - block.offsets[d], "run": n, "lead": runs.places[chosen] - start}
        return cols, runs.hashes[chosen], block.data[_ranges(start, n + span - 1)]

    def segments(it):
        rows = (row for batch in it for row in batch.to_pylist())
        for row in rows:
            block, cuts = row["block"], [cut(row)]
            while len(cuts) < CUT_BLOCKS and sum(len(x[2]) for x in cuts) < CUT_BYTES and (row := next(rows, None)):
                cuts.append(cut(row))
            cols = {c: np.concatenate([x[0][c] for x in cuts]) for c in SEGMENTS}
            anchors, data = (np.concatenate([x[i] for x in cuts]) for i in (1, 2))
            lengths = cols["run"] + span - 1
            first = np.cumsum(lengths) - lengths
            for part, chosen in dealt(anchors, parts):
                for g in _pieces(chosen, lengths):
                    mine = data[_ranges(first[g], lengths[g])]
                    yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([block]), pa.array([part]), pa.array([len(mine)]),
                                                      pa.array([pack_segments({c: cols[c][g] for c in SEGMENTS}, mine)], pa.binary())], ["kind", "block", "part", "size", "packed"])

    # Few bytes a row but much work: a counted number of tasks instead of what adaptive execution makes of the bytes.
    tasks = max(1, min(n_blocks, max(2 * spark.sparkContext.defaultParallelism, n_blocks // CUT_BLOCKS)))
    current = staged(places.join(flags, "block").repartition(tasks).mapInArrow(segments, MERGED))
    marks, classes, level, before = None, 1, 0, None
    while True:
        left = current.where("kind = 1")
        load = staged(left.groupBy("part").agg(F.sum("size").alias("bytes"), F.greatest(F.ceil(F.sum("size") / team_bytes), F.ceil(F.count("*") / fan_in)).cast("long").alias("teams")))
        n_parts, most, heaviest = load.agg(F.count("*"), F.max("teams"), F.max("bytes")).first()
        if classes > span - GRAM and before is not None and heaviest is not None and heaviest >= before:
            load, most = load.withColumn("teams", F.lit(1).cast("long")), 1  # only rows of one id and text are left: none is earlier, so none thins
        classes, level, before = min(2 * classes, span - GRAM + 1), level + 1, heaviest
        by_team = left.join(bounded_broadcast(load.drop("bytes"), n_parts), "part").withColumn("team", F.pmod(F.xxhash64("block", "packed"), "teams"))
        merged = staged(by_team.groupBy("part", "team").applyInArrow(_merger(span, step, classes, level), MERGED))
        if marks is None:
            drop(current)
        current = merged
        found = merged.where("kind = 0").select("block", "packed")
        marks = found if marks is None else marks.union(found)
        if (most or 0) <= 1:
            break

    def results(it):
        for batch in it:
            for row in batch.to_pylist():
                block = read_block(row["path"], row["start"], row["size"])
                change = np.zeros(len(block.data) + 1, np.int32)
                for packed in row["marks"] or ():
                    d, at, n = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.int64).reshape(3, -1)
                    np.add.at(change, block.offsets[d] + at, 1)
                    np.add.at(change, block.offsets[d] + at + n + span - 1, -1)
                gone = np.cumsum(change)[:-1] > 0
                kept = np.concatenate(([0], np.cumsum(~gone)))
                left = block.data[~gone].tobytes()
                opens = gone & ~np.concatenate(([False], gone[:-1]))
                heads = block.offsets[:-1][np.diff(block.offsets) > 0]
                opens[heads] = gone[heads]  # a run never crosses documents
                spans = np.concatenate(([0], np.cumsum(opens)))
                a, b = block.offsets[:-1], block.offsets[1:]
                n = b - a
                sha = [hashlib.sha256(left[x:y]).hexdigest() for x, y in zip(kept[a].tolist(), kept[b].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(block.ids), pa.array(block.fps), pa.array(n), pa.array(n - (kept[b] - kept[a])), pa.array(spans[b] - spans[a]), pa.array(sha)],
                                                 ["doc", "fp", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    every = places.join(marks.groupBy("block").agg(F.collect_list("packed").alias("marks")), "block", "left").mapInArrow(results, RESULT)
    whole = copies.select("doc", "fp", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return every.union(whole)


def op5_suffix_array_dedup(spark, sf: str) -> DataFrame:
    return dedup_spans(table(spark, sf, "documents").select("doc_id", "text")).select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
